"""Benchmark decontamination by template canonicalisation: the same question with other numbers, names or units."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import without

#: Windows of a benchmark up to this many (some 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
#: Marks of the typed placeholders, and the unit words that may follow a number.
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
UNITS = (
    "%|°C|°F|percent|mg|kg|g|lb|lbs|oz|mm|cm|km|m|in|ft|mi|inches|feet|miles|metres|meters|kilometres|kilometers|ml|l|litres|liters|"
    "ms|s|min|h|seconds|minutes|hours|days|weeks|months|years|mph|kmh|dollars|cents|euros|pounds|degrees"
)


def template_tokens(text: Column) -> Column:
    """Words in lower case, and placeholders: a mark followed by what it stands for.

    Numbers with their separators are numbers; unit words right after one are units; capitalised words that follow a
    word or a comma, and so don't begin a sentence, are names. Punctuation and line breaks say nothing else.
    """
    x = F.coalesce(text, F.lit(""))
    for mark in (NUMBER, UNIT, NAME):
        x = F.replace(x, F.lit(mark), F.lit(" "))
    x = F.regexp_replace(x, rf"([+-]?\d+(?:[.,:/]\d+)*)(?:\s*({UNITS})(?![\p{{L}}\p{{M}}]))?", f" {NUMBER}$1 {UNIT}$2 ")
    x = F.regexp_replace(x, rf"(?<=[\p{{L}}\p{{M}},;] )\p{{Lu}}[\p{{Ll}}\p{{M}}]++", f" {NAME}$0 ")
    return F.regexp_extract_all(F.lower(x), F.lit(rf"[{NUMBER}-{NAME}]\S++|[\p{{L}}\p{{M}}]++"), F.lit(0))


def _is_slot(token: Column) -> Column:
    return F.ascii(token) <= 3


def _windows(rows: DataFrame, sizes: list[int], literals: int) -> DataFrame:
    """rows (with `tokens`) for every window of each size: at (from 0), size, hash.

    The hash is that of the template, where placeholders of a kind are alike, or of the very values where the window
    has fewer than `literals` words. Neighbouring tokens stand side by side as columns, so a window is hashed in generated code.
    """
    top = max(sizes)
    hashes = F.transform("tokens", lambda t: F.xxhash64(F.when(_is_slot(t), F.left(t, F.lit(1))).otherwise(t)))
    rows = rows.withColumn("__h", hashes)
    n = F.size("tokens")
    beside = F.arrays_zip(*[(F.slice("__h", k + 1, F.greatest(n - k, F.lit(0))) if k else F.col("__h")).alias(f"h{k}") for k in range(top)])
    rows = rows.withColumn("__n", n).select("*", F.posexplode(beside).alias("at", "z")).drop("__h")
    slot = [F.xxhash64(F.lit(m)) for m in (NUMBER, UNIT, NAME)]

    def key(size: int) -> Column:
        parts = [F.col(f"z.h{k}") for k in range(size)]
        words = sum((F.when((p == slot[0]) | (p == slot[1]) | (p == slot[2]), 0).otherwise(1) for p in parts), F.lit(0))
        values = F.xxhash64(F.lit(-size), F.slice("tokens", F.col("at") + 1, size))
        return F.when(words < min(literals, size), values).otherwise(F.xxhash64(F.lit(size), *parts))

    if len(sizes) == 1:
        rows = rows.filter(F.col("at") + top <= F.col("__n")).select("*", F.lit(top).alias("size"), key(top).alias("hash"))
    else:
        each = F.array(*[F.when(F.col("at") + s <= F.col("__n"), F.struct(F.lit(s).alias("size"), key(s).alias("hash"))) for s in sizes])
        rows = rows.select("*", F.explode(each).alias("w")).filter("w IS NOT NULL").select("*", "w.size", "w.hash").drop("w")
    return rows.drop("z", "__n")


def _literal(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: ~_is_slot(t)))


def _keys(benchmark: DataFrame, window: int, literals: int, item_col: str, item_text: str) -> tuple[DataFrame | None, list[int]]:
    """(item_id, item_at, hash, item_values, windows, counts) for every window that is searched for, and the window sizes.

    counts: whether the window is one of the `windows` that an item's share is taken of.
    """
    # Inside a document an item's first word, if capitalised, can stand where names do; so its first window has two forms.
    forms = F.explode(F.array_distinct(F.array(*[template_tokens(F.concat(F.lit(before), F.col(item_text))) for before in ("", ", ")])))
    items = benchmark.select(F.col(item_col).alias("item_id"), template_tokens(F.col(item_text)).alias("plain"), forms.alias("tokens")).distinct()
    items = items.withColumn("inner", F.col("tokens") != F.col("plain")).drop("plain")
    items = items.withColumn("own", F.least(F.size("tokens"), F.lit(window))).filter("own > 0")
    sizes = sorted(r["own"] for r in items.select("own").distinct().collect())  # at most `window` values
    if not sizes:
        return None, sizes
    keys = _windows(items, sizes, literals).filter("size = own AND (NOT inner OR at = 0)")
    keys = keys.select("item_id", F.col("at").alias("item_at"), "hash", F.slice("tokens", F.col("at") + 1, F.col("size")).alias("item_values"))
    keys = keys.filter(F.exists("item_values", lambda t: t.rlike(r"\p{L}")))
    keys = keys.withColumn("template", _literal(F.col("item_values")) >= F.least(F.lit(literals), F.size("item_values")))
    both = keys.groupBy(F.col("item_id").alias("of")).agg(F.countDistinct(F.when(F.col("template"), F.col("item_at"))).alias("templates"), F.countDistinct("item_at").alias("all"))
    keys = keys.join(both, F.col("item_id").eqNullSafe(F.col("of"))).withColumn("windows", F.when(F.col("templates") > 0, F.col("templates")).otherwise(F.col("all")))
    return keys.withColumn("counts", F.col("template") | (F.col("templates") == 0)).drop("of", "template", "templates", "all"), sizes


def unsearched(benchmark: DataFrame, window: int = 8, literals: int = 5, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id) of the items that aren't blank and yet never searched for, as they have no letter."""
    keys, _ = _keys(benchmark, window, literals, item_col, item_text)
    there = benchmark.filter(F.col(item_text).rlike(r"\S")).select(F.col(item_col).alias("item_id")).distinct()
    return there if keys is None else there.join(keys.select(F.col("item_id").alias("of")).distinct(), F.col("item_id").eqNullSafe(F.col("of")), "left_anti")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, literals: int = 5, cover: float = 0.3, run: int = 16, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, matched, windows, reparameterised, contaminated) for every document that holds a benchmark item.

    A window of `window` template tokens, of which at least `literals` are words, matches wherever its hash occurs; one
    with fewer words matches where its very values occur. An item of fewer tokens is one window of them all, and needs
    `literals` words or no placeholder at all to match as a template. A document holds an item if consistent placements
    match at least `cover` of the item's windows: of its template windows, or of all where it has none of those. A
    placement (document position less item position) is consistent if equal slot values of the item always have equal
    values in the document. reparameterised: some slot's value differs.

    However long the item, a document also holds it from `run` consecutive tokens with the item's very values on (two
    windows end to end; 13, a tail that templates with other slots share, is no leak by the tests).
    matched counts windows of consistent placements and of such runs.

    Null and empty texts hold nothing; windows and items without a letter match nothing, and a warning says how many
    such items there are (`unsearched` names them). Rows are judged by id and text: those that repeat both are one, those
    that share an id, or have none, are each judged alone and may each give a row. Empty tables give no rows. Only
    matches leave the task that reads a document while the keys are few; otherwise windows with their values do, never
    whole documents.
    """
    return _held(docs, benchmark, window, literals, cover, run, id_col, text_col, item_col, item_text).drop("text_hash")


def _held(docs: DataFrame, benchmark: DataFrame, window: int = 8, literals: int = 5, cover: float = 0.3, run: int = 16, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """As contaminated, with the hash of the text by which rows of one id are told apart."""
    keys, sizes = _keys(benchmark, window, literals, item_col, item_text)
    lost = unsearched(benchmark, window, literals, item_col, item_text).count()
    if lost:
        warnings.warn(f"{lost} benchmark items have no letter and aren't searched for", stacklevel=3)
    row = "doc_id", "text_hash"
    out = *row, "item_id", "matched", "windows", "reparameterised", "contaminated"
    if keys is None:
        none = "0L text_hash", f"CAST(NULL AS {benchmark.schema[item_col].dataType.simpleString()}) item_id", "0L matched", "0L windows", "false reparameterised", "true contaminated"
        return docs.select(F.col(id_col).alias("doc_id")).limit(0).selectExpr("doc_id", *none)
    few = keys.count() <= BROADCAST_WINDOWS

    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), template_tokens(F.col(text_col)).alias("tokens"))
    seen = _windows(texts, sizes, literals)
    values = F.slice("tokens", F.col("at") + 1, F.col("size")).alias("values")
    if few:
        met = seen.join(F.broadcast(keys), "hash").select("*", values)
    else:
        met = seen.select(*row, "at", "hash", values).join(keys, "hash")
    pairs = F.filter(F.arrays_zip(F.col("item_values").alias("was"), F.col("values").alias("is")), lambda p: _is_slot(p["was"]))
    met = met.select(*row, "item_id", "windows", "counts", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), pairs.alias("slots"))
    same = F.forall("slots", lambda p: p["was"] == p["is"])
    placed = met.groupBy(*row, "item_id", "windows", "shift").agg(
        F.collect_set(F.when(F.col("counts"), F.col("item_at"))).alias("found"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
        F.array_sort(F.collect_set(F.when(same, F.col("item_at")))).alias("exact"), F.collect_set(F.when(same & F.col("counts"), F.col("item_at"))).alias("exact_found"),
    )
    # A run of `run` tokens is so many windows one after the other: in sorted order, the last stands as far ahead.
    more = max(run - window, 0)
    quoted = F.when(F.size("exact") > more, F.exists(F.sequence(F.lit(0), F.size("exact") - 1 - more), lambda i: F.get("exact", i + more) - F.get("exact", i) == more)).otherwise(False) & F.lit(window in sizes)
    placed = placed.withColumn("fits", F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda p: p["was"])))).withColumn("quoted", quoted).filter("fits OR quoted")
    other = F.col("fits") & F.exists("slots", lambda p: p["was"] != p["is"])
    found = F.when(F.col("fits"), F.col("found")).otherwise(F.col("exact_found"))
    held = placed.groupBy(*row, "item_id", "windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list(found)))).cast("long").alias("matched"), F.bool_or(other).alias("reparameterised"), F.bool_or("quoted").alias("quoted"))
    return held.filter(F.col("quoted") | (F.col("matched") >= F.lit(cover) * F.col("windows"))).withColumn("contaminated", F.lit(True)).select(*out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kinds) -> DataFrame:
    """docs without the rows that hold a benchmark item; every other column as it was, whatever its name.

    A row goes by its own text, also where others share its id or none has one.
    """
    gone = _held(docs, benchmark, id_col=id_col, text_col=text_col, **kinds).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text_hash")).distinct()
    return without(docs, gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__text_hash")))
