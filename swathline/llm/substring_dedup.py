"""Substring dedup: rolling hashes of every window of words, counted in Spark, merged into removal intervals.

Documents are dealt to blocks by their id. A block sends each bucket of hashes its own distinct hashes in sorted
order, some 7 bytes each, and whether it has one several times; a bucket says back, a bit for each, which of them
occur again anywhere; the block then works its hashes out once more and reads the bits in the same order. No
window carries a position, no key meets more than one entry a block however often it occurs, and a
block or bucket that is lost with its executor is worked out again from its documents alone.

Equality is 64 bits of one rolling hash and the bucket, which comes from a second one: 64 + log2(buckets) bits, so with
the input grow the bits. Every block has a message for every bucket; larger blocks (block_bytes) keep that
grid small for very large inputs.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import Words

class _Block:
    """The windows of a block of documents, as distinct hashes in the order of (bucket, hash)."""

    def __init__(self, texts: pa.Array, size: int, buckets: int):
        self.words = Words(texts)
        self.at, hashes = self.words.windows(size)
        distinct, first, self.which, self.times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        # The bucket comes from a hash of its own: windows are only counted as equal when they agree in both.
        bucket = (self.words.windows(size, other=True)[1][first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.distinct, self.times = distinct[order], self.times[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))


def _pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes: how many begin with each byte, and the other seven bytes of each."""
    top = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256).astype("<u4")
    return top.tobytes() + hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes() if len(hashes) >= 256 else hashes.astype("<u8").tobytes()


def _unpack(packed: bytes, n: int) -> np.ndarray:
    if n < 256:
        return np.frombuffer(packed, "<u8")
    out = np.zeros((n, 8), np.uint8)
    out[:, :7] = np.frombuffer(packed, np.uint8, offset=1024).reshape(n, 7)
    out[:, 7] = np.repeat(np.arange(256, dtype=np.uint8), np.frombuffer(packed, "<u4", 256))
    return out.view("<u8").ravel()


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, removed (intervals of word numbers); kept text on request.

    A word goes when it stands in a window of `window` words whose sequence of words also starts anywhere else.
    Overlapping windows make one maximal interval [from, to). A text of fewer words, an empty or a null one
    loses nothing; of repeated rows each counts as a document, so they lose all their windows. Null ids are dealt
    by text. Memory of a task follows block_bytes, or the longest document where that is more.
    """
    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = flat.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = blocks
    flat = flat.withColumn("block", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(blocks)))

    def send(table: pa.Table) -> pa.Table:
        block = _Block(_column(table, "text"), window, buckets)
        rows = [
            (b, _pack(block.distinct[i:j]), np.packbits(block.times[i:j] > 1).tobytes(), j - i)
            for b, (i, j) in enumerate(zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True))
            if j > i
        ]
        bucket, packed, several, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "block": pa.array([table["block"][0].as_py()] * len(rows), pa.int64()), "n": pa.array(n, pa.int32()), "hashes": pa.array(packed, pa.binary()), "several": pa.array(several, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_numpy()
        parts = [_unpack(p, n) for p, n in zip(table["hashes"].to_pylist(), sizes.tolist(), strict=True)]
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n).astype(bool) for s, n in zip(table["several"].to_pylist(), sizes.tolist(), strict=True)])
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        again = np.zeros(len(hashes), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        again |= several
        bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(_column(table, "text"), window, buckets)
        again = np.zeros(len(block.distinct), bool)
        for b, bits in zip(told["bucket"].to_pylist(), told["bits"].to_pylist(), strict=True):
            i, j = block.bounds[b], block.bounds[b + 1]
            again[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i)
        words = block.words
        starts = block.at[again[block.place[block.which]]] if len(block.at) else block.at
        steps = np.zeros(len(words.starts) + window + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + window, -1)
        gone = np.cumsum(steps)[: len(words.starts)] > 0
        return _results(table, words, gone, with_text)

    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<`from`:int,`to`:int>>"
    sent = flat.groupBy("block").applyInArrow(send, "bucket long, block long, n int, hashes binary, several binary")
    told = sent.groupBy("bucket").applyInArrow(count, "block long, bucket long, bits binary")
    return flat.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, out + (", kept string" if with_text else ""))


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _results(table: pa.Table, words: Words, gone: np.ndarray, with_text: bool) -> pa.Table:
    """Kept words of each text with one space between, their digest, and the intervals that went."""
    keep = ~gone
    sizes = np.where(keep, words.sizes + 1, 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(words.starts - ends[:-1], sizes) + np.arange(ends[-1])
    kept = words.data[at]
    kept[ends[1:][keep] - 1] = 0x20
    kept = kept.tobytes()
    cut = ends[words.bounds].tolist()
    texts = [kept[i : max(i, j - 1)] for i, j in zip(cut[:-1], cut[1:], strict=True)]
    counts = np.concatenate([[0], np.cumsum(gone)])[words.bounds]
    edge = np.ones(len(gone) + 1, bool)
    edge[1:-1] = gone[1:] != gone[:-1]
    edge[words.bounds] = True  # an interval ends with its text
    runs = np.flatnonzero(edge)
    runs = runs[:-1][gone[runs[:-1]]], runs[1:][gone[runs[:-1]]]
    first = np.searchsorted(runs[0], words.bounds)
    base = np.repeat(words.bounds[:-1], np.diff(first))
    spans = pa.StructArray.from_arrays([pa.array((r - base).astype(np.int32)) for r in runs], ["from", "to"])
    columns = {
        "doc_id": table["doc_id"],
        "n_words": pa.array(np.diff(words.bounds).astype(np.int64)),
        "n_removed": pa.array(np.diff(counts).astype(np.int64)),
        "kept_sha256": pa.array([sha256(t).hexdigest() for t in texts], pa.string()),
        "removed": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), spans),
    }
    return pa.table(columns | ({"kept": pa.array([t.decode() for t in texts], pa.string())} if with_text else {}))
