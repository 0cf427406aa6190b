"""Vectorised text kernels: word bounds, polynomial hashes, packed sorted integers.

All work on one buffer of UTF-8 bytes with the offsets of its documents. Hashes are
64-bit and depend on the bytes and the seed alone, so any task that is run again
gives the same ones.
"""

from __future__ import annotations

import functools

import numpy as np
import zstandard

_GOLDEN = 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers with well spread output (the splitmix64 finaliser)."""
    x = x + np.uint64((seed * _GOLDEN + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=8)
def _letters(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), seed + 101)


_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _powers[name] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each span of bytes, from one running polynomial over the buffer."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_letters(seed)[data] * _power(n, _BASE, "b"), out=total[1:])
    h = (total[ends] - total[starts]) * _power(n + 1, _INVERSE, "i")[starts]
    return mix(h + (ends - starts).astype(np.uint64), seed)


def split_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without separator bytes, none across documents: starts, ends, and where each document's begin."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~separator[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return split_spans(data, offsets, _SPACE)


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive word hashes; n - 1 fewer than words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    h = words[:m].copy()
    for k in range(1, n):
        h *= _BASE
        h += words[k : k + m]
    return mix(h, seed + n)


def gram_starts(doc_words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers at which a window of n words of one document starts, and how many each document has."""
    counts = np.maximum(np.diff(doc_words) - n + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64), counts
    shift = np.repeat(doc_words[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + shift, counts


def fold_case(data: np.ndarray) -> np.ndarray:
    """ASCII upper case to lower, and ASCII marks to spaces; other bytes unchanged."""
    return _FOLD[data]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed byte planes of their differences."""
    v = np.ascontiguousarray(values, np.uint64)
    d = v.copy()
    d[1:] -= v[:-1]
    planes = d.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_raw(values: np.ndarray) -> bytes:
    """Small unsigned integers in any order."""
    v = np.ascontiguousarray(values, np.uint32)
    planes = v.view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_raw(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()
