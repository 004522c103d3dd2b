"""Vectorised word, line and byte hashing over blocks of texts.

A prefix sum of ``table[byte] * P**i`` modulo 2**64 gives the hash of any byte range in one subtraction and one
multiplication by the inverse power of its start. A final mix spreads the bits. Words are maximal runs without
the characters 0x20 and 0x09 to 0x0D.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_power, _inverse = np.ones(1, U), np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 2 * len(_power), 1 << 16)
        step = np.full(size, U(_P), U)
        step[0] = 1
        back = np.full(size, U(_PINV), U)
        back[0] = 1
        _power, _inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)
    return _power, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums for :func:`range_hash`."""
    power, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(_TABLE[buf] * power[: len(buf)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range ``[start, end)``."""
    _, inverse = _powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


def bytes_hash(word: bytes) -> int:
    """The hash that :func:`range_hash` gives to these bytes."""
    buf = np.frombuffer(word, np.uint8)
    return int(range_hash(prefix(buf), np.array([0]), np.array([len(buf)]))[0])


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more than texts)."""
    return runs(~SPACE[buf], offsets)


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words that stay within a text, and for each text the index of its first run."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(len(bounds), np.int64)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(0xD6E8FEB86659FD93) + hashes[j : j + n]
    whole = np.ones(n, bool)
    for j in range(1, k):
        cut = bounds[1:-1] - j
        whole[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(whole)
    return mix(out[at]), np.searchsorted(at, bounds)


LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin letters that UTF-8 writes with the lead byte 0xC3."""
    out = _LOWER[buf]
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1
    tail = buf[after]
    out[after[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)]] += 32
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` that stay within a text, and the first run of each text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text, whose first value is at ``bounds``."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
