"""Splits texts at spaces where a tokenizer provably cuts, so that each distinct segment is encoded once a batch.

For the byte-level vocabularies every space before a character that isn't white space starts a new pre-token.
For the piece vocabulary no piece holds a space after another character, so each space after a non-space cuts.
Segments that are single words are kept without their space; a text with any other segment is split apart by
a pattern. Both give the same segments; the first way only is faster.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text that are handled at once, so that memory doesn't follow the size of a batch.
SLICE_BYTES = 4 << 20
_LIBC = ctypes.CDLL(None) if hasattr(ctypes, "CDLL") else None
#: Segments remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 200_000


def release() -> None:
    """Gives a worker's unused memory back, so that it isn't held beside that of the next stage's kernels."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about `size` bytes, each with the index of its first text; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


class Segmented:
    """The distinct segments of some texts, and per text the codes of its segments.

    words: distinct segments without their leading space; codes, bounds: text i has codes[bounds[i]:bounds[i + 1]];
    the first segment of each text has no leading space before it in the text.
    """

    def __init__(self, texts: pa.Array, odd: str, cut: re.Pattern):
        self.n = len(texts)
        is_odd = pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False).astype(bool)
        self.order = np.concatenate([np.flatnonzero(~is_odd), np.flatnonzero(is_odd)])
        plain = pc.split_pattern(texts.filter(pa.array(~is_odd)), " ")
        parts = [[s[1:] if i else s for i, s in enumerate(cut.split(x))] for x in texts.filter(pa.array(is_odd)).to_pylist()]
        values = pa.concat_arrays([plain.flatten(), pa.array([s for p in parts for s in p], pa.string())])
        lengths = np.concatenate([pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(p) for p in parts], np.int64)])
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        coded = values.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary

    def firsts(self) -> list[str]:
        return self.words.take(pa.array(self.codes[self.bounds[:-1]])).to_pylist()


class Memory:
    """Encodings of segments, by `encode` for those not remembered; bounded."""

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode, self.known = encode, {}

    def __call__(self, words: list[str]) -> list:
        known = self.known
        if new := [w for w in words if w not in known]:
            if len(known) + len(new) > REMEMBERED:
                known = dict.fromkeys(words)
                new, self.known = words, known
            known.update(zip(new, self.encode(new), strict=True))
        out = [known[w] for w in words]
        if len(known) > REMEMBERED:
            self.known = {}
        return out
