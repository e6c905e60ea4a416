"""Hashes of any substring of a byte buffer, without a loop over bytes in Python."""

from __future__ import annotations

import numpy as np

#: Prefix sums use tables of powers; they are made for buffers of this size at once and grow when a longer one comes.
USUAL_BYTES = (1 << 19) + 512

_BASE = 0xD6E8FEB86659FD93
_LETTERS = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a buffer, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(_powers.get("up", ())) < n:
            size = max(n, USUAL_BYTES)
            _powers["up"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]))
            _powers["down"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_LETTERS[data] * _powers["down"][: n - 1], out=self.sums[1:])

    def of(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[begin + length] - self.sums[begin]) * _powers["up"][begin])
