"""A 64-bit permuted congruential generator for small draws on the driver; tables use ``rand(seed)`` or hashes."""

from __future__ import annotations

import math

_MASK = (1 << 64) - 1
# Fixed values of the public generator: the multiplier and the stream's increment.
_MULTIPLIER, _INCREMENT = 6364136223846793005, 1442695040888963407


class PCG64:
    def __init__(self, seed: int = 0):
        self.seed(seed)

    def seed(self, seed: int) -> None:
        self.state = 0
        self._next()
        self.state = (self.state + seed) & _MASK
        self._next()

    def _next(self) -> int:
        """32 bits: the old state, shifted by itself and rotated by its top bits."""
        old = self.state
        self.state = (old * _MULTIPLIER + _INCREMENT) & _MASK
        word = (((old >> 18) ^ old) >> 27) & 0xFFFFFFFF
        turn = old >> 59
        return ((word >> turn) | (word << (-turn & 31))) & 0xFFFFFFFF

    def uniform(self, low: float = 0.0, high: float = 1.0) -> float:
        return low + (high - low) * self._next() / 4294967296.0

    def normal(self, mean: float = 0.0, std: float = 1.0) -> float:
        while True:
            u, v = self.uniform(-1, 1), self.uniform(-1, 1)
            s = u * u + v * v
            if 0 < s < 1:
                return mean + std * u * math.sqrt(-2 * math.log(s) / s)

    def randint(self, low: int, high: int) -> int:
        """From low to under high."""
        if high <= low:
            raise ValueError("high must be over low")
        return low + self._next() % (high - low)
