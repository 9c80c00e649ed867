"""Words of many documents at once: byte-level numpy, no loop over words."""

from __future__ import annotations

import functools

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words (letters, digits, all bytes of characters beyond ASCII), and a random value for each byte, equal for upper and lower case."""
    word = np.zeros(256, bool)
    word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    value = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
    value[65:91] = value[97:123]
    return word, value


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for p in (_P, _P_INV):
        a = np.full(n, p, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a))
    return out[0], out[1]


def hashed(data: np.ndarray, offsets: np.ndarray, spaces: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, document) of every word, in order.

    Words are runs of letters and digits, case folded for ASCII; with spaces=True they are runs of anything
    but ASCII white space, as they stand.
    """
    from panelwright.llm.common import mix64

    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word, value = _tables()
    if spaces:
        word = np.ones(256, bool)
        word[[32, *range(9, 14)]] = False
        value = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)
    inside = word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    with np.errstate(over="ignore"):
        up, down = _powers(max(16, (n + 1).bit_length()))
        total = np.cumsum(value[data] * up[:n])
        h = (total[b] - np.where(a > 0, total[a - 1], np.uint64(0))) * down[a]
    return mix64(h), np.searchsorted(offsets, a, "right") - 1
