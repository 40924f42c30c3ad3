"""A keyed permutation of 0 .. n-1: Feistel rounds with cycle walking."""

from __future__ import annotations

import numpy as np

ROUNDS = 6
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)   # splitmix64's constants (fixed values)


def _mixed(values: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = values + np.uint64((key * _MIX[2]) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
        return x ^ (x >> np.uint64(31))


def permuted(positions: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each of ``positions`` (all below ``n``) goes. For one ``n`` and
    ``key`` this is a bijection of 0 .. n-1.

    The Feistel network permutes 2^(2h) >= n numbers; a number that lands at n
    or above goes through it again until it lands below. As at least a quarter
    of the numbers lie below n, few rounds of walking are needed.
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = positions.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, key * ROUNDS + r + 1) & mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)
