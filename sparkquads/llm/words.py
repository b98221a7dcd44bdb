"""Words of many texts at once: positions, rolling hashes, and samples of positions that depend on the words alone.

A word is a run of bytes other than ASCII white space. All hashes are of 64 bits and of the words' bytes, so that
equal words hash alike in any text, task and run.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import text_buffer

U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The lowest so many bytes of a number.
_MASKS = np.array([2 ** (8 * i) - 1 for i in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, log: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    n = 1 << log
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, b & (2**64 - 1), U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = _powers(base, max(16, int(n).bit_length()))
    return p[:n], q[:n]


class Words:
    """buf: the bytes; begin, end: of each word; first: of each text the number of its first word, and one more."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        n = len(buf)
        inner = off[:-1][off[:-1] < n]
        if n:
            solid = ~SPACE[buf]
            edge = np.empty(n, bool)
            edge[0] = True
            np.logical_not(solid[:-1], out=edge[1:])
            edge[inner] = True
            self.begin = np.flatnonzero(solid & edge)
            edge[-1] = True
            np.logical_not(solid[1:], out=edge[:-1])
            last = off[1:][off[1:] > 0] - 1
            edge[last] = True
            self.end = np.flatnonzero(solid & edge) + 1
        else:
            self.begin = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.begin, off)
        self._hash = None

    @classmethod
    def of(cls, texts) -> "Words":
        return cls(*text_buffer(texts))

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def doc(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))

    @property
    def hash(self) -> np.ndarray:
        """Of each word: pieces of 8 bytes, scattered twice with their places in between, added up with the length."""
        if self._hash is None:
            size = self.end - self.begin
            pieces = (size + 7) // 8
            first = np.cumsum(pieces) - pieces
            word = np.repeat(np.arange(len(size)), pieces)
            place = np.arange(len(word)) - first[word]
            at = self.begin[word] + 8 * place
            padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
            raw = np.ndarray((len(self.buf) + 1,), "<u8", padded.data, strides=(1,))[at] & _MASKS[np.minimum(self.end[word] - at, 8)]
            scattered = mix(mix(raw) + (place.astype(U) + U(1)) * U(_STEP))
            total = np.add.reduceat(scattered, first) if len(first) else scattered
            self._hash = mix(total + size.astype(U) * U(_BASE))
        return self._hash

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on. Those that reach beyond their text are the caller's to leave out."""
        n = len(self)
        out = max(0, n - k + 1)
        if not hasattr(self, "_sums"):
            p, self._inverse = powers(_STEP, n + 1)
            self._sums = np.zeros(n + 1, U)
            np.cumsum(self.hash * p[:n], out=self._sums[1:])
        return mix((self._sums[k : k + out] - self._sums[:out]) * self._inverse[:out])

    def whole(self, k: int) -> np.ndarray:
        """For each gram of k words, whether it lies in one text."""
        n = max(0, len(self) - k + 1)
        stop = np.repeat(self.first[1:], np.diff(self.first))[:n]
        return np.arange(n) + k <= stop


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive numbers."""
    if len(a) < w:
        return a[:0]
    have = 1
    while have * 2 <= w:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (w - have)], a[w - have :]) if have < w else a


def anchors(words: Words, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and hashes of the k-grams that are closed syncmers: the least of their s-grams' hashes is the first's or
    the last's. That depends on the k words alone, and of any k - s consecutive k-grams at least one is such."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    small = words.grams(s)
    least = sliding_min(small, k - s + 1)
    chosen = np.flatnonzero(((least == small[:n]) | (least == small[k - s : k - s + n])) & words.whole(k))
    return chosen, words.grams(k)[chosen]
