"""Vectorised hashes of words and of stretches of bytes.

A stretch's hash is a polynomial over the bytes modulo 2**64, read off one running sum: the
difference of two sums times an inverse power of the (odd) base.  It only deals rows out: what is
equal is told by other hashes as well, or by the bytes themselves.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Rows: byte values; columns: their bits, as -1 and 1.
SIGNS = ((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2.0 - 1


def powers(n: int, kept: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; those made stay, if they are `kept` at most."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    size, made = max(n, min(2 * n, kept), 1 << 12), []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= kept:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stretches(raw: np.ndarray, starts, ends) -> np.ndarray:
    """Hashes of raw[starts:ends] for arrays (or slices' bounds) of positions."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space."""
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_BLANK[raw]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def signed_votes(hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For each bit of the 64-bit hashes, the sum of weights of those that set it minus the others."""
    own = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(own[:, k], weights, 256) @ SIGNS for k in range(8)])


def bits_to_bytes(bits: np.ndarray) -> bytes:
    """The bits, least significant first, as a big-endian number."""
    return np.packbits(bits, bitorder="little").tobytes()[::-1]
