"""MinHash near-dedup: banded signatures, links confirmed on full shingle sets, and connected components.

1. Each document becomes its set's size, its digest and a signature: 128 minima of universal hashes, 16 bits each, in 32
   bands of 4. Documents with equal sets are one class, linked without a look; classes go on.
2. Classes that share a band meet in its bucket. Each is tested against one pivot, the smallest class of the bucket
   that it shares the most bands with; these stars join nearly all of a group of near copies.
3. In every bucket that still holds several components, the classes outside its largest one are compared with all of the
   bucket, in blocks of bounded size: first the signatures of those of other components, each pair in the first band
   that it shares only, then the full sets of those whose signatures agree. Only links leave a block, one a class and
   component. So no link is lost to a bucket's size, nothing is compared that shares no band, and the pairs of a large
   group of copies are never made.

All links are confirmed on full sets. A pair at the threshold shares no band with a chance of 5e-8, and has signatures
that agree too little with one of 1e-11.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, join_counted, without, written
from ._hashing import Words, mix
from ._segments import release, slices
from .components import components

BANDS, ROWS_A_BAND = 32, 4
HASHES = BANDS * ROWS_A_BAND
#: Equal minima, of HASHES, from which on a pair goes to its full sets: over seven deviations below a similarity of 0.8.
AGREE = 70
#: Classes and shingles of a block of a bucket.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1_500_000
#: Rows of signatures that a task takes at once.
TASK_ROWS = 16_384

_rng = np.random.Generator(np.random.PCG64(7))
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.int64).astype(np.uint32)
_SHORT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; a shorter text's whole sequence is its one shingle."""
    words = Words(texts, lower=True)
    at, hashes = words.windows(size)
    cuts = np.searchsorted(at, words.bounds).tolist()
    counts = np.diff(words.bounds).tolist()
    out = []
    for i, n in enumerate(counts):
        if n >= size:
            out.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
        elif n:
            whole = mix(np.full(1, n, np.uint64) * _SHORT)
            for h in words.hashes[words.bounds[i] : words.bounds[i + 1]]:
                whole = mix((whole ^ h) * _SHORT)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash a * x + b modulo 2^32 over the set; its upper 16 bits are the signature."""
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        best = np.minimum(best, (x[i : i + 2048, None] * _A + _B).min(axis=0))
    return best


def _sign(shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text")):
                sizes, digests, signatures = [], [], []
                for s in shingle_sets(part, shingle):
                    sizes.append(len(s))
                    if len(s):
                        digests.append(blake2b(s.tobytes(), digest_size=16).digest())
                        # A minimum over n values is below 2^32 / n, mostly: its bits are mixed before some are taken.
                        signatures.append((mix(minima(s).astype(np.uint64)) >> np.uint64(48)).astype("<u2").tobytes())
                    else:
                        digests.append(None), signatures.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(part)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "signature"],
                )
        release()

    return sign


def _band_keys(signature: Column) -> Column:
    """A key for each band: the hash of its number and its four minima."""
    return F.array(*[F.xxhash64(F.lit(b), F.substring(signature, 2 * ROWS_A_BAND * b + 1, 2 * ROWS_A_BAND)) for b in range(BANDS)])


def _agreement(a: Column, b: Column) -> Column:
    """How many minima of two signatures are equal."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(HASHES - 1)), F.lit(0), lambda n, i: n + (F.substring(a, 2 * i + 1, F.lit(2)) == F.substring(b, 2 * i + 1, F.lit(2))).cast("int"))


def _with_sets(docs: DataFrame, needs: DataFrame, shingle: int) -> DataFrame:
    """Rows of needs, a table, with the packed shingle set of document `need`: its sorted hashes, the upper six bytes of each."""
    rest = [c for c in needs.columns if c != "need"]
    few = needs.count() <= BROADCAST_ROWS
    found = docs.join(F.broadcast(needs) if few else needs, F.col("doc_id") == F.col("need")).select("doc_id", "text", *rest)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text")):
                packed = [s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for s in shingle_sets(part, shingle)]
                kept = [batch.column(c).slice(first, len(part)) for c in ("doc_id", *rest)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(packed, pa.binary())], names=["doc_id", *rest, "shingles"])
        release()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in needs.schema if f.name != "need")
    return found.mapInArrow(sets, f"doc_id long, {fields}, shingles binary")


def _unpack(packed: bytes) -> np.ndarray:
    s = np.zeros((len(packed) // 6, 8), np.uint8)
    s[:, 2:] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return s.view("<u8").ravel()


class _Against:
    """Full sets to compare others with: postings of all their shingles in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def linked(self, own: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets have 100 * |both| >= percent * |either|."""
        lo, n = np.searchsorted(self.values, own), 0
        n = np.searchsorted(self.values, own, side="right") - lo
        ends = np.cumsum(n)
        at = np.repeat(lo - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return 100 * both >= percent * (len(own) + self.sizes - both)


def _stars(docs: DataFrame, tests: DataFrame, classes: DataFrame, shingle: int, percent: int, group: int) -> DataFrame:
    """Of tests (x, pivot y), a table, the links (u, v): signatures first, then full sets."""
    rows = tests.count()
    of = tests.groupBy("y").agg(F.count(F.lit(1)).alias("n")).join(classes.select(F.col("rep").alias("y"), F.col("signature").alias("its")), "y")
    own = tests.join(classes.select(F.col("rep").alias("x"), "signature"), "x")
    near = join_counted(own, of.groupBy("y").agg(F.max("n").alias("n"), F.first("its").alias("its")), ["y"], "n", rows)
    tests = written(near.filter(_agreement(F.col("signature"), F.col("its")) >= AGREE).select("x", "y").distinct(), "tests")
    # Each partner goes to one of a pivot's groups, the pivot to all of them.
    sizes = tests.groupBy("y").agg(F.count(F.lit(1)).alias("n")).withColumn("groups", F.ceil(F.col("n") / group).cast("int"))
    partners = join_counted(tests, sizes, ["y"], "n", rows).select(F.col("x").alias("need"), "y", F.pmod(F.xxhash64("x"), "groups").cast("int").alias("part"), F.lit(False).alias("pivot"))
    pivots = sizes.select(F.col("y").alias("need"), "y", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(True).alias("pivot"))

    def compare(table: pa.Table) -> pa.Table:
        ids, pivot = table["doc_id"].to_pylist(), table["pivot"].to_pylist()
        sets = table["shingles"]
        out: list[int] = []
        for k in (k for k, p in enumerate(pivot) if p):
            against = _Against([_unpack(sets[k].as_py())])
            out += [ids[i] for i, p in enumerate(pivot) if not p and against.linked(_unpack(sets[i].as_py()), percent)[0]]
        return pa.table({"u": pa.array(out, pa.int64()), "v": pa.array([table["y"][0].as_py()] * len(out), pa.int64())})

    found = _with_sets(docs, written(partners.unionByName(pivots), "needs"), shingle)
    return found.groupBy("y", "part").applyInArrow(compare, "u long, v long").distinct()


def _blocks(table: pa.Table) -> Iterator[np.ndarray]:
    """The rows of each block (key, i, j) of a task."""
    key, i, j = (table[c].to_numpy() for c in ("key", "i", "j"))
    order = np.lexsort((j, i, key))
    cut = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
    yield from np.split(order, cut)


def _close(asks: np.ndarray, there: np.ndarray, band: int, differ: np.ndarray) -> np.ndarray:
    """Which pairs of signatures agree in AGREE minima, and in no whole band before this one."""
    out = np.zeros(differ.shape, bool)
    step = max(1, (1 << 22) // max(1, there.size))
    for k in range(0, len(asks), step):
        equal = asks[k : k + step, None, :] == there[None, :, :]
        close = (equal.sum(axis=2) >= AGREE) & differ[k : k + step]
        if band:
            close &= ~equal[:, :, : band * ROWS_A_BAND].reshape(*close.shape, band, ROWS_A_BAND).all(axis=3).any(axis=2)
        out[k : k + step] = close
    return out


def _bucket_links(docs: DataFrame, met: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (u, v) between components that share a bucket; met, a table: rep, key, band, component, n_shingles."""
    each = met.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    split = each.groupBy("key").agg(F.max_by(F.struct("component", "n", "s"), F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("parts"))
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK_CLASSES), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    split = split.filter("parts > 1").select("key", "n", F.col("main.component").alias("main"), blocks(F.col("n"), F.col("s")).alias("all"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("out"))
    rows = join_counted(met, written(split, "split"), ["key"], "n", met.count()).drop("n")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    # Block (i, j) of a bucket: the i-th part of those outside its main component asks about the j-th part of all.
    asks = rows.filter("component <> main").select("rep", "key", "band", "component", "n_shingles", own("out").alias("i"), spread("all").alias("j"), F.lit(True).alias("asks"))
    given = rows.select("rep", "key", "band", "component", "n_shingles", spread("out").alias("i"), own("all").alias("j"), F.lit(False).alias("asks"))
    placed = written(asks.unionByName(given), "placed")
    count = placed.count()
    if not count:
        return placed.selectExpr("rep AS u", "component AS v")
    signed = placed.join(classes.select("rep", "signature").dropDuplicates(["rep", "signature"]), "rep")
    dealt = lambda n: F.pmod(F.xxhash64("key", "i", "j"), F.lit(n)).cast("int")

    def look(table: pa.Table) -> pa.Table:
        """The rows of pairs of other components whose signatures agree."""
        asks, component, band = table["asks"].to_numpy(zero_copy_only=False).astype(bool), table["component"].to_numpy(), table["band"].to_numpy()
        signature = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u2").reshape(-1, HASHES)
        wanted = np.zeros(len(asks), bool)
        for at in _blocks(table):
            a, b = at[asks[at]], at[~asks[at]]
            if len(a) and len(b):
                close = _close(signature[a], signature[b], int(band[a[0]]), component[a][:, None] != component[b][None, :])
                wanted[a] |= close.any(axis=1)
                wanted[b] |= close.any(axis=0)
        release()
        return table.filter(pa.array(wanted)).select(["need", "key", "i", "j", "component", "n_shingles", "asks"])

    wanted = signed.withColumn("need", F.col("rep")).groupBy(dealt(-(-count // TASK_ROWS))).applyInArrow(look, "need long, key long, i int, j int, component long, n_shingles long, asks boolean")
    wanted = written(wanted.distinct(), "needs")
    shingles = wanted.agg(F.sum("n_shingles")).first()[0] or 0

    def compare(table: pa.Table) -> pa.Table:
        ids, component = table["doc_id"].to_numpy(), table["component"].to_numpy()
        asks, sets = table["asks"].to_numpy(zero_copy_only=False).astype(bool), table["shingles"]
        us, vs = [], []
        for at in _blocks(table):
            there = at[~asks[at]]
            if not len(there):
                continue
            against = _Against([_unpack(sets[int(k)].as_py()) for k in there])
            for k in at[asks[at]].tolist():
                good = there[against.linked(_unpack(sets[k].as_py()), percent) & (component[there] != component[k])]
                good = good[np.unique(component[good], return_index=True)[1]]
                us += [ids[k]] * len(good)
                vs += ids[good].tolist()
        release()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    found = _with_sets(docs, wanted, shingle)
    return found.groupBy(dealt(1 + shingles // BLOCK_SHINGLES)).applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", group: int = 256) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of `shingle`-word shingles (A-Z lower-cased) have a Jaccard similarity of at
    least percent / 100, and are one component when links lead from one to the other; kept marks its smallest id.
    A text without words, or null, has an empty set and no link. Rows that repeat an id are one document with the
    links of all their texts. A row without an id is linked with nothing, has no component and is kept.
    percent below 80 needs more bands; it is refused.
    """
    if percent < 80:
        raise ValueError("bands and signatures are laid out for similarities from 0.8 on")
    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = written(flat.mapInArrow(_sign(shingle), "doc_id long, n_shingles long, digest binary, signature binary"), "signatures")
    full = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    rows = signed.count()
    # Equal sets have equal signatures.
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = written(classes, "classes")
    bands = classes.select("rep", "n_shingles", F.posexplode(_band_keys(F.col("signature"))).alias("band", "key"))
    pivots = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).filter("pivot <> last").drop("last")
    # From here on only classes that share a band with another one.
    shared = written(join_counted(bands, written(pivots, "pivots"), ["key"], "n", BANDS * rows).drop("n"), "shared")
    meets = shared.filter("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("n"))
    tests = meets.groupBy("rep").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("y")).select(F.col("rep").alias("x"), "y")
    links = written(_stars(flat, written(tests, "tests"), classes, shingle, percent, group), "links")
    stars = components(links)
    met = shared.select("rep", "key", "band", "n_shingles").join(stars.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = written(_bucket_links(flat, written(met, "met"), classes, shingle, percent), "more-links")
    edges = stars.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
    labels = written(components(edges), "labels") if not more.isEmpty() else stars
    # Classes of one id are one document; ids of a class hang on its smallest.
    member = join_counted(full.select("doc_id", "digest"), classes.select("digest", "rep", "n"), ["digest"], "n", rows)
    member = member.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    split = member.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if split:  # ids repeat with other texts: members join the links
        labels = written(components(edges.unionByName(member)), "labels")
    found = member.groupBy("u").agg(F.min("v").alias("rep"))
    sizes = found.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).join(labels, F.col("rep") == F.col("node"))
    found = join_counted(written(found, "members"), sizes.select("rep", "component", "n"), ["rep"], "n", rows, "left")
    found = found.select(F.col("u").alias("__id"), F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("__id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component; every other column as it was. Rows that repeat a kept id all stay."""
    found = near_duplicates(docs, shingle, percent, id_col, text_col)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return without(docs, gone, F.col(id_col) == F.col("__gone"))
