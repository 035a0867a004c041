"""Bitvectors with rank and select, packed eight bits a byte, over a directory of counts."""

from __future__ import annotations

import numpy as np

#: Bytes of packed bits to each entry of the directory: 512 bits.
BLOCK = 64


class Bits:
    """A packed bitvector; ``ones`` before each block of BLOCK bytes are kept, so either question reads one block."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits)
        self.packed = np.concatenate([packed, np.zeros(-len(packed) % BLOCK, np.uint8)])
        counts = np.bitwise_count(self.packed).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place; a place may be the end."""
        at = np.asarray(at, np.int64)
        block, rest = np.divmod(at, 8 * BLOCK)
        out = self.before[block]
        inside = np.flatnonzero(rest)
        for lo in range(0, len(inside), 4096):
            i = inside[lo : lo + 4096]
            bits = np.unpackbits(self.packed.reshape(-1, BLOCK)[block[i]], axis=1)
            out[i] += (bits & (np.arange(8 * BLOCK) < rest[i, None])).sum(axis=1, dtype=np.int64)
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has k others before it; the length where there is none."""
        k = np.asarray(k, np.int64)
        out = np.full(len(k), self.n, np.int64)
        there = np.flatnonzero(k < self.ones)
        for lo in range(0, len(there), 4096):
            i = there[lo : lo + 4096]
            block = np.searchsorted(self.before, k[i], "right") - 1
            bits = np.unpackbits(self.packed.reshape(-1, BLOCK)[block], axis=1)
            seen = np.cumsum(bits, axis=1, dtype=np.int16)
            out[i] = block * 8 * BLOCK + (seen <= (k[i] - self.before[block])[:, None]).sum(axis=1)
        return out
