"""Hashing of words and word n-grams.

Every distinct word has a 128-bit BLAKE2b digest of its bytes, as two lanes of
64 bits, made once for each process. The hash of a sequence is built by doubling:
two halves (which may overlap) are combined by a mixer that is not linear, so
there is no algebra by which different sequences of the same words could cancel
out. Hashes depend on the words alone, never on their place, so equal sequences
agree on every executor.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C13 // 8 * 8 + 3
_powers: dict[int, np.ndarray] = {}
_LEFT, _RIGHT, _HALF = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next batch."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Names of values[begin:end] for estimates: a polynomial, which sequences made for it can defeat. Exact operators use spans()."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    back = powers(pow(base, -1, 2**64), len(values) + 1)
    return mixed((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))


class Vocabulary(dict):
    """Number of each word seen, and the digests of all by number. Forgotten beyond ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit, self.new, self.lanes = limit, [], np.zeros((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.new.append(hashlib.blake2b(word, digest_size=16).digest())
        n = self[word] = len(self)
        return n

    def digests(self, words: list[bytes]) -> np.ndarray:
        """2 x len(words): the two lanes of each word's digest."""
        if len(self) > self.limit:
            self.__init__(self.limit)
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.lanes = np.concatenate((self.lanes, np.frombuffer(b"".join(self.new), np.uint64).reshape(-1, 2)))
            self.new = []
        return np.ascontiguousarray(self.lanes[at].T)


_vocabulary = Vocabulary()


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words of the texts (2 lanes), and len(texts)+1 offsets of each text's words."""
    parts: list[bytes] = []
    offsets = [0]
    for t in texts:
        parts += (t.lower() if lower else t).split()
        offsets.append(len(parts))
    return _vocabulary.digests(parts), np.array(offsets)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in this order."""
    return mixed(a * _LEFT ^ (b << _HALF | b >> _HALF) * _RIGHT)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each position on, across text borders too; empty if there are fewer. One lane."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    x, width = hashes, 1
    while 2 * width <= n:
        x = pair(x[: len(x) - width], x[width:])
        width *= 2
    return x if width == n else pair(x[: len(hashes) - n + 1], x[n - width :])


def spans(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of hashes[begin:end] for each pair (none empty), with its length. One lane."""
    size = end - begin
    out = np.zeros(len(begin), np.uint64)
    level = np.frexp(size.astype(np.float64))[1] - 1
    x = hashes
    for k in range(int(level.max(initial=-1)) + 1):
        here = np.flatnonzero(level == k)
        out[here] = pair(x[begin[here]], x[end[here] - (1 << k)])
        x = pair(x[: max(len(x) - (1 << k), 0)], x[1 << k :])
    return pair(out, size.astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x
