"""The queries of this package's operators over the input tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, license_scan, near_dedup, packing, sharding, substring_dedup, token_counts, url_filter
from ._common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


#: Which urls are blocked, and which of those are allowed all the same.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the documents, by their ids, from which nothing is learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame) -> dict[str, list[str]]:
    return language_id.sample(docs, F.col("doc_id").isNotNull() & ~held_out())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.withColumn("held_out", held_out()), training_texts(docs), keep=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", counts.n_tokens > 4096)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


_EXACT = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY sha) AS kept, sha AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS sha FROM documents)
"""


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
wins AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 33), lambda i: {{'i': i, 's': array_to_string(ws[i:i + 34], ' ')}})) AS x FROM w WHERE len(ws) >= 35),
again AS (SELECT x.s AS s FROM wins GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(x.i, x.i + 35)))) AS g FROM wins JOIN again ON x.s = s GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(g), 0) AS r, CASE WHEN g IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(g, i)) END AS k FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n AS n_words, r AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.node),
c AS (SELECT node, min(root) AS component_id FROM walk GROUP BY node)
SELECT node AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, node = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = node
"""
_RULES = ", ".join(f"('{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in URL_RULES)
_URLS = f"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {_RULES}),
rows AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1) AS raw,
                regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM rows),
fits AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
                row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS r
         FROM hosts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE r = 1
"""


def _canonical_sql(text: str) -> str:
    x = f"regexp_replace(coalesce({text}, ''), '{license_scan.NOTICE}', ' \\1', 'g')"
    x = f"regexp_replace({x}, '{license_scan.COPYRIGHT_LINE}', ' ', 'g')"
    x = f"regexp_replace(regexp_replace(lower({x}), '{license_scan.VERSION}', '\\1version \\2', 'g'), '{license_scan.MARKS}', '  ', 'g')"
    x = f"' ' || trim({x}) || ' '"
    for old, new in license_scan.SPELLINGS:
        x = f"replace({x}, ' {old} ', ' {new} ')"
    return f"trim(replace({x}, '  ', ' '))"


_KNOWN = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in license_scan.NOTICES)
_LISTED = ", ".join(f"('{name}', '{digest}')" for name, digest in license_scan.DIGESTS)
_LICENSES = f"""
WITH texts AS (SELECT sha256({_canonical_sql("text")}) AS digest, license FROM (VALUES {_KNOWN}) t(license, text) UNION ALL SELECT digest, license FROM (VALUES {_LISTED}) d(license, digest)),
known AS (SELECT digest, min(license) AS license FROM texts GROUP BY 1),
rows AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license FROM rows LEFT JOIN known ON canonical_sha256 = digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _SUBSTRING, "op2_near_dedup": _NEAR, "op4_url_filter": _URLS, "op5_exact_dedup": _EXACT, "op6_license_scan": _LICENSES}
