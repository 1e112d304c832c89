"""Vectorised words, word hashes and shingle hashes over the bytes of many texts at once.

A word's hash is a polynomial over its bytes modulo 2**64, taken from one running sum over the chunk, then mixed. Words
never cross texts. Hashes of 64 bits stand for words and shingles in candidate search and in set sizes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: Multipliers of the words of a shingle.
MULTIPLIERS = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}

WHITE = frozenset(b" \t\n\x0b\x0c\r")


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:  # at least a million, so that one table serves almost all chunks
        size = max(n, (1 << 20) + 1)
        table = np.empty(size, np.uint64)
        table[0] = 1
        done = 1
        step = base
        while done < size:  # doubling: table[done:2 done] = table[:done] * base**done
            more = min(done, size - done)
            np.multiply(table[:more], U(step), out=table[done : done + more])
            done += more
            step = step * step % (1 << 64)
        if size > 1 << 22:
            return table[:n]  # one very long text: not kept
        _powers[name] = have = table
    return have[:n]


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range, case and all; the length is part of it."""
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[data] * _power("up", _BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", _INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64) * MULTIPLIERS[6])


class Words:
    """Finds words: maximal runs of bytes that `is_word` accepts. ASCII letters are lower-cased where `lower` is set."""

    def __init__(self, is_word, lower: bool = False):
        self.is_word = np.array([bool(is_word(b)) for b in range(256)])
        self.values = _VALUES.copy()
        if lower:
            self.values[65:91] = self.values[97:123]

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(starts, ends, hashes, first): byte ranges and hashes of all words, and each text's first word (n + 1)."""
        n = len(data)
        if not n:
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        mask = self.is_word[data]
        start, end = mask.copy(), mask.copy()
        start[1:] &= ~mask[:-1]
        end[:-1] &= ~mask[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        start[inner] = mask[inner]
        end[inner - 1] = mask[inner - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.values[data] * _power("up", _BASE, n), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * _power("down", _INVERSE, n)[starts])
        return starts, ends, hashes, np.searchsorted(starts, offsets)


WHITE_WORDS = Words(lambda b: b not in WHITE, lower=True)
#: Letters, digits and everything beyond ASCII.
ALNUM_WORDS = Words(lambda b: b >= 0x80 or chr(b).isalnum(), lower=True)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, also across texts: the caller leaves those out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * MULTIPLIERS[0]
    for j in range(1, k):
        out = out + hashes[j : j + n] * MULTIPLIERS[j]
    return mix(out)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; with fewer words the whole sequence is one; without words none."""
    all_grams, out = grams(hashes, k), []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            u = np.sort(all_grams[lo : hi - k + 1])
            out.append(u[np.concatenate(([True], u[1:] != u[:-1]))] if len(u) > 1 else u)
        elif hi > lo:
            h = hashes[lo:hi]
            out.append(mix((h * MULTIPLIERS[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + U(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def long_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Like grams, from one running sum: for many words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power("up", _BASE, len(hashes)), out=total[1:])
    return mix((total[k:] - total[:-k]) * _power("down", _INVERSE, n))
