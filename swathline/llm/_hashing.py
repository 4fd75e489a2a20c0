"""Word and window hashes of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The low n bytes of a little-endian word of eight.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: The multipliers of the 64-bit finalizer of splitmix, and an odd base for windows.
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

_OTHER = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix's finalizer: a bijection of 64 bits in which every bit decides every other."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of texts without nulls.

    data: the UTF-8 bytes of all texts and eight more; starts, sizes: bytes of each word; bounds: text i has words
    bounds[i] to bounds[i + 1]; hashes: 64 bits a word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        n = int(offsets[-1] - offsets[0])
        self.data = np.zeros(n + 8, np.uint8)
        if n:
            self.data[:n] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if lower:
            self.data = _LOWER[self.data]
        word = ~_SPACE[self.data[:n]]
        edge = np.ones(n + 1, bool)  # a word can't go on from the byte before
        edge[1:n] = ~word[:-1]
        edge[offsets[:-1]] = True
        self.starts = np.flatnonzero(word & edge[:n])
        edge = np.ones(n + 1, bool)
        edge[:n] = ~word
        edge[offsets[:-1]] = True
        self.sizes = np.flatnonzero(word & edge[1:]) + 1 - self.starts
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        eights = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        h = mix(self.sizes.astype(np.uint64))
        active, at, left = slice(None), self.starts, self.sizes
        while len(at):
            h[active] = mix((h[active] ^ (eights[at] & _MASK[np.minimum(left, 8)])) * _BASE)
            more = np.flatnonzero(left > 8)
            active = more if isinstance(active, slice) else active[more]
            at, left = at[more] + 8, left[more] - 8
        return h

    def windows(self, size: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First words, and hashes, of all windows of `size` words of one text each.

        Rabin and Karp's rolling hash from prefix sums of word hash times a power of the base, modulo 2^64. `other`
        gives a second one over remixed word hashes, which tells nothing of the first.
        """
        hashes = mix(self.hashes ^ _OTHER) if other else self.hashes
        per_text = np.maximum(np.diff(self.bounds) - size + 1, 0)
        at = np.repeat(self.bounds[:-1], per_text) + _within(per_text)
        powers, inverse = _powers(len(self.hashes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[: len(hashes)], dtype=np.uint64)])
        return at, mix((sums[at + size] - sums[at]) * inverse[at])


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


_known = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    global _known
    if len(_known[0]) < n:
        size = 1 << (n - 1).bit_length()
        _known = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))
    return _known
