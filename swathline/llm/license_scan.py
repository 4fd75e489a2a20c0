"""License scans by canonical digest: whole texts that are a known licence but for case, marks, names and spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, NOTICES

#: Equivalent spellings, each pair of whole words after lower-casing.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("merchantibility", "merchantability"), ("noninfringement", "non infringement"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("https", "http"), ("ver", "version"), ("v", "version")]
#: Patterns that Spark and other SQL engines read alike: a notice that a licence follows on the same line; a line that is
#: a notice, with a year or its placeholder; a version's number; what stands between words of any script.
_SIGN = "(?:copyright|\\(c\\)|©)"
NOTICE = f"(?i){_SIGN}[^\\n]{{0,24}}[0-9]{{4}}[^\\n]{{0,160}}?(permission is hereby granted|permission to use|redistribution and use in source|licensed under|released under|this program is free software)"
COPYRIGHT_LINE = f"(?im)^[ \\t#*/;%!-]*(?:(?:portions )?{_SIGN}(?:[ \\t]*{_SIGN})*[ \\t,:]*(?:[0-9]{{4}}|<year>|<yyyy>|\\[year\\]|\\[yyyy\\]|yyyy)[^\\n]{{0,160}}|all rights reserved[.]?[ \\t]*)$"
VERSION = "(^|[^a-z0-9])v([0-9])"
MARKS = "[^\\p{L}\\p{M}\\p{N}]+"


def canonical(text: Column) -> Column:
    """Without copyright notices; the words of any script in lower case, one spelling for equivalent ones, one space between."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), NOTICE, " $1")
    x = F.regexp_replace(x, COPYRIGHT_LINE, " ")
    x = F.regexp_replace(F.lower(x), VERSION, "$1version $2")
    # Two spaces between words, so that neighbours share none.
    x = F.concat(F.lit(" "), F.trim(F.regexp_replace(x, MARKS, "  ")), F.lit(" "))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] = NOTICES, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(license, canonical digest) of each known text, and the digests of long texts that are listed as such."""
    own = spark.createDataFrame(texts, "license string, text string").select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return own.unionByName(spark.createDataFrame(digests, "license string, digest string"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, canonical_sha256, license (null if the whole text is no known licence).

    A null or empty text, or one of copyright lines only, has the digest of the empty text and no licence. Rows are judged
    one by one, so null and repeated ids are as good as others; an empty table gives no rows. The known digests are as
    many as the list that was passed in has; of several licences with one digest the first by name counts. Letters of
    every script belong to the text: a notice within a text of another language is no licence.
    """
    known = known if known is not None else known_licenses(docs.sparkSession)
    empty = F.sha2(F.lit(""), 256)
    known = known.filter(F.col("digest") != empty).groupBy("digest").agg(F.min("license").alias("license"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256"))
    return rows.join(known, F.col("canonical_sha256") == F.col("digest"), "left").select("doc_id", "canonical_sha256", "license")
