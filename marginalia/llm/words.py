"""Hashes of the words of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: 2**64 wraps: the inverse of an odd number undoes a multiplication by it.
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_FORTH = _powers(_ODD, 1 << 16)
_BACK = _powers(_INVERSE, 1 << 16)


def _table(which: str, n: int) -> np.ndarray:
    global _FORTH, _BACK
    if len(_FORTH) < n:
        size = 1 << (n - 1).bit_length()
        _FORTH, _BACK = _powers(_ODD, size), _powers(_INVERSE, size)
    return (_FORTH if which == "forth" else _BACK)[:n]


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, starts and ends of all words, and per text the number
    of the first word (one more entry than texts)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return buf, starts, ends, first


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and per text the number of its first
    word (one more entry than texts).  Equal words have equal hashes everywhere."""
    buf, starts, ends, first = word_spans(texts)
    n = len(buf)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * _table("forth", n))))
    return mix((sums[ends] - sums[starts]) * _table("back", n + 1)[starts] + (ends - starts).astype(np.uint64)), first


def groups(texts: list[bytes], most: int = 1 << 19):
    """Slices of texts of bounded total size; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield slice(lo, len(texts))
