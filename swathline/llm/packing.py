"""Shortest-pack-first packing of token sequences over their length histogram."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import with_rank, written
from ._segments import Memory, Segmented, release, slices

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
#: White space before white space or the end, by which a space need not start a pre-token.
_ODD = " ([\\t-\\r\\x1c-\\x1f\\x{85}\\p{Z}]|$)"
_CUT = re.compile(r"(?= \S)")


#: Fixed value: how byte-level files of this kind split a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteEncoder:
    """Token ids of whole texts as the tokenizers library gives them for a byte-level BPE file, without added ids.

    Where a file's ids are in the order of its merges, as ranks are, and it splits by PATTERN, segments go through the
    rank-based encoder, which gives the same ids in a third of the time; texts with special strings, and files of
    another kind, go through tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.full.get_vocab_size() < 1 << 16 else "<u4")
        self.ranked = _ranked(json.loads(self.full.to_str()), self.special)
        # Single words: with and without the space before them.
        self.inner = Memory(lambda words: self._bytes([" " + w for w in words]))
        self.first = Memory(self._bytes)

    def _bytes(self, texts: list[str]) -> list[bytes]:
        if self.ranked:
            return [np.array(self.ranked.encode_ordinary(t), self.kind).tobytes() for t in texts]
        return [np.array(e.ids, self.kind).tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        plain = ~np.array([any(s in t for s in self.special) for t in texts.to_pylist()], bool)
        seg = Segmented(texts.filter(pa.array(plain)), _ODD, _CUT)
        inner = self.inner(seg.words.to_pylist())
        heads = self.first(seg.firsts())
        sizes = np.fromiter(map(len, inner), np.int64, len(inner)) // self.kind.itemsize
        pool = np.frombuffer(b"".join(inner) + b"".join(heads), self.kind)
        head_sizes = np.fromiter(map(len, heads), np.int64, len(heads)) // self.kind.itemsize
        starts = np.concatenate([[0], np.cumsum(np.concatenate([sizes, head_sizes]))])
        codes = seg.codes.astype(np.int64)
        codes[seg.bounds[:-1]] = len(inner) + np.arange(len(heads))
        sizes = np.concatenate([sizes, head_sizes])[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(starts[codes] - ends[:-1], sizes) + np.arange(ends[-1])
        ids, doc_bounds = pool[at], ends[seg.bounds]
        pieces: list = [None] * len(texts)
        for k, i in enumerate(np.flatnonzero(plain)[seg.order]):
            pieces[i] = ids[doc_bounds[k] : doc_bounds[k + 1]]
        for i in np.flatnonzero(~plain):
            pieces[i] = np.array(self.full.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, self.kind)
        return pieces


def _ranked(file: dict, special: list[str]):
    """The rank-based encoder of the same vocabulary, or None where it isn't proven to be the same."""
    import tiktoken

    model, split = file["model"], file.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or file.get("normalizer"):
        return None
    # Bytes that print stand for themselves, the others for code points from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != sorted(merged) or model.get("ignore_merges") or model.get("dropout"):
        return None
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens={})


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and `end_id`, cut into pieces of `capacity` and a rest; null texts count as empty.

    Repeated rows are documents each. Only lengths and checksums leave the tokenizer, so a row is some tens of bytes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for first, part in slices(batch.column("text")):
                rows: list[tuple] = []
                for i, ids in enumerate(encoder(part), first):
                    ids = np.append(ids, end_id).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        rows.append((i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                at, start, length, crc, tokens = np.array(rows, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc), pa.array(tokens)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )
        release()

    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return flat.mapInArrow(cut, PIECES)


_encoders: dict[str, ByteEncoder] = {}


def _encoder(path: str) -> ByteEncoder:
    """A worker's own encoder of this file, kept for its later tasks."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Shortest-pack-first: (length, first rank, end rank, first sequence, offset) of every placement.

    Lengths go longest first, each onto the pack that is shortest so far, into a new one where it fits none.
    Packs with equal contents are one entry, an interval of sequence numbers with its fill, so the work follows the
    number of lengths and not of sequences: a placement deals consecutive ranks to consecutive sequences.
    """
    open_packs: list[tuple[int, int, int]] = []  # fill, first sequence, sequences: a heap, shortest first
    placed, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if open_packs and open_packs[0][0] + length <= capacity:
                fill, first, n = heapq.heappop(open_packs)
            else:  # as full as whole packs of this length alone get in one step
                fill, first, n = 0, sequences, -(-left // (capacity // length))
                sequences += n
            take = min(n, left)
            placed.append((length, rank, rank + take, first, fill))
            if take < n:
                heapq.heappush(open_packs, (fill, first + take, n - take))
            if fill + length < capacity:
                heapq.heappush(open_packs, (fill + length, first, take))
            rank, left = rank + take, left - take
    return placed


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The histogram has at most `capacity` lengths, whatever the corpus, and is all that the driver sees; each
    placement is an interval of ranks within a length, and pieces take theirs by rank. Null and empty texts
    are documents of one id; an empty table gives no rows; repeated rows are packed each.
    """
    spark: SparkSession = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = pack_histogram(counts, capacity)
    ranked = with_rank(pieces, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], sum(counts.values()))
    schema = "p_length int, rank_from long, rank_to long, first_sequence long, offset long"
    places = spark.createDataFrame(placed, schema)
    # At most `capacity` lengths with a few placements each: bounded by the capacity alone.
    at = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    joined = ranked.join(F.broadcast(places), at)
    return joined.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset"
    )
