"""Vectorised hashing of many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)              # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def sums(a: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers; [i, j) hashes to (s[j] - s[i]) * BASE^-i."""
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[a] * powers(len(a))[0], out=out[1:])
    return out


def lowered(buf: bytes) -> np.ndarray:
    a = np.frombuffer(buf, np.uint8)
    return np.where((a >= 65) & (a <= 90), a | 32, a)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes (a longer text is alone)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text (whitespace words, A-Z lower-cased).

    A text of fewer words is one shingle, one without words has none."""
    out: list[np.ndarray] = []
    weights = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for lo, hi in chunks(texts):
        part = texts[lo:hi]
        a = lowered(b" ".join(part) + b" ")
        sep = np.ones(len(a) + 1, np.int8)
        sep[1:] = (a == 32) | ((a >= 9) & (a <= 13))
        edge = np.diff(sep)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        s = sums(a)
        w = mix((s[ends] - s[starts]) * powers(len(a))[1][starts])
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        first = np.searchsorted(starts, begin)
        n = len(w) - width + 1
        sh = np.zeros(max(n, 0), np.uint64)
        for k in range(width if n > 0 else 0):
            sh += w[k:k + n] * weights[k]
        sh = mix(sh)
        for i, j in zip(first[:-1], first[1:]):
            if j - i >= width:
                out.append(np.unique(sh[i:j - width + 1]))
            elif j > i:
                out.append(mix((w[i:j] * weights[:j - i]).sum(keepdims=True, dtype=np.uint64) + np.uint64(j - i)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
