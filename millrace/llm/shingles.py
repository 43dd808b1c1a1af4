"""Sets of hashed word shingles of whole texts, computed for many texts at a time on byte arrays.

A-Z are lower-cased, words are runs without space, tab, line feed, vertical tab, form feed and carriage
return, a shingle is N words in a row; a text of fewer words is one shingle, a text without words none.
Hashes have 64 bits: two different shingles share one with probability of about 2^-64 a pair.
"""

from __future__ import annotations

import functools

import numpy as np

N = 5
#: Bytes of text handled at a time, unless one text alone is longer.
PIECE = 1 << 20
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(1010)
_VALUE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_CASED = _VALUE.copy()
_VALUE[65:91] = _VALUE[97:123]
_MARK = np.zeros(256, bool)
_MARK[[0x2C, 0x2E]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PLACE = _RNG.integers(1, 1 << 62, N, np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _RNG.integers(1, 1 << 62, N, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, 2^bits of each."""
    n = 1 << bits
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)))) for b in (_BASE, _BACK))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, set_apart: bool = False, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a byte array, A-Z as a-z if `fold`.

    With set_apart, a full stop or comma between an ASCII letter or digit and a separator is a word of its own.
    """
    letter = np.concatenate((np.zeros(1, bool), ~_SEP[data], np.zeros(1, bool)))
    if set_apart:
        apart = np.zeros(len(letter) + 1, bool)
        apart[2:-2] = _MARK[data[1:]] & _ALNUM[data[:-1]] & ~letter[3:] if len(data) > 1 else False
        inner = letter[1:-1]
        starts = np.flatnonzero(inner & (~letter[:-2] | apart[1:-2]))
        ends = np.flatnonzero(inner & (~letter[2:] | apart[2:-1])) + 1
    else:
        edge = np.flatnonzero(letter[1:] != letter[:-1])
        starts, ends = edge[::2], edge[1::2]
    up, down = _powers(max(21, len(data).bit_length()))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_VALUE if fold else _CASED)[data] * up[: len(data)], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    encoded = [(t or "").encode() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(encoded):
        end, size = at + 1, len(encoded[at])
        while end < len(encoded) and size + len(encoded[end]) < PIECE:
            size += len(encoded[end]) + 1
            end += 1
        group = encoded[at:end]
        starts, _, words = word_hashes(np.frombuffer(b"\n".join(group), np.uint8))
        begins = np.concatenate(([0], np.cumsum([len(g) + 1 for g in group])))
        bounds = np.searchsorted(starts, begins).tolist()
        placed = [words * p for p in _PLACE[:n]]
        if len(words) >= n:
            total = placed[0][: len(words) - n + 1].copy()
            for k in range(1, n):
                total += placed[k][k : len(words) - n + 1 + k]
            total = mixed(total)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= n:
                s = np.sort(total[a : b - n + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif b > a:
                one = sum((int(placed[k][a + k]) for k in range(b - a)), int(_SHORT[b - a - 1])) % (1 << 64)
                out.append(mixed(np.array([one], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
        at = end
    return out
