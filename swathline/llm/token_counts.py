"""Exact token counts by a sentencepiece model; huge documents in overlapping chunks, spliced where both agree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._segments import Memory, Segmented, slices

COUNTS = "doc_id long, n_bytes long, n_tokens long"
#: Two spaces in a row, or one at an end: segments that aren't just a word.
_ODD = "  |^ | $"
_CUT = re.compile(r"(?<=[^ ])(?= )")
_BYTE = re.compile("<0x[0-9A-F]{2}>")
_SPACE = "▁"


class PieceCounter:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        #: No piece goes from another character on to a space, so no merge ever crosses there: a stable boundary.
        self.stable = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces)
        self.words = Memory(lambda words: list(map(len, self.model.encode(words, num_threads=1))))

    def short(self, texts: pa.Array) -> np.ndarray:
        """Counts of many texts, each distinct segment encoded once."""
        # A literal U+2581 is a space to the model.
        texts = pc.replace_substring(texts, _SPACE, " ")
        if not self.stable:
            return np.array([len(x) for x in self.model.encode(texts.to_pylist(), num_threads=1)], np.int64)
        seg = Segmented(texts, _ODD, _CUT)
        each = np.array(self.words(seg.words.to_pylist()), np.int64)
        sums = np.concatenate([[0], np.cumsum(each[seg.codes])])[seg.bounds]
        out = np.empty(len(texts), np.int64)
        out[seg.order] = np.diff(sums)
        # A single space at the end is a segment without a word, and a piece.
        return out + pc.match_substring_regex(texts, "[^ ] $").to_numpy(zero_copy_only=False)

    def long(self, text: str, chunk: int, overlap: int) -> int:
        """The count of one huge text, from chunks that overlap.

        Two neighbours are spliced at a place of the overlap where both have a piece boundary before a space that
        follows another character; from there on both must agree, as no merge crosses it. If the overlap
        has no such place it is doubled, up to the end of the text, where one chunk holds the rest.
        """
        text, total, start = text.replace(_SPACE, " "), 0, 0
        while True:
            span = overlap
            while True:
                stop = start + chunk + span
                part = text[start:stop]
                begins = self._begins(part)
                if stop >= len(text):
                    return total + len(begins) - int(np.searchsorted(begins, 1 if start else 0))
                nxt = self._begins(text[start + chunk : stop]) + chunk
                both = np.intersect1d(begins, nxt[nxt > chunk])
                # Bytes that go on a character at the chunk's end begin past it: no place to cut.
                cuts = [p for p in both[::-1].tolist() if p < len(part) and part[p] == " " and part[p - 1] != " "] if self.stable else []
                if cuts:
                    break
                span *= 2
            cut = cuts[0]
            # A later chunk starts one character early, before its first stable boundary.
            total += int(np.searchsorted(begins, cut)) - int(np.searchsorted(begins, 1 if start else 0))
            start = start + cut - 1

    def _begins(self, text: str) -> np.ndarray:
        """Where the pieces of the text begin, in characters."""
        pieces = self.model.encode(text, out_type=str, num_threads=1)
        # A byte piece is a character if it can begin one; the first piece has a space that the text has not.
        sizes = np.array([len(p) if not _BYTE.fullmatch(p) else int(p[3:5], 16) & 0xC0 != 0x80 for p in pieces], np.int64)
        return np.maximum(np.cumsum(sizes) - sizes - 1, 0)


_counters: dict[str, PieceCounter] = {}


def _counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, chunk: int = 1 << 16, overlap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs, whole texts, without begin, end or added tokens.

    Texts of over `chunk` characters go the way of overlapping chunks. A null text counts as empty: 0 tokens.
    Ids may be null or repeated; each row is counted alone; no row moves between tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            texts = batch.column("text")
            out = np.zeros(len(texts), np.int64)
            huge = pc.greater(pc.utf8_length(texts), chunk).to_numpy(zero_copy_only=False)
            small = np.flatnonzero(~huge)
            for first, part in slices(texts.filter(pa.array(~huge))):
                out[small[first : first + len(part)]] = counter.short(part)
            for i in np.flatnonzero(huge):
                out[i] = counter.long(texts[int(i)].as_py(), chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(out)], names=["doc_id", "n_bytes", "n_tokens"])

    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return flat.mapInArrow(count, COUNTS)
