"""Looks up the pieces of a vocabulary at every place of many words at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_MUL = 1_099_511_628_211
_FACTORS = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)
_SHIFT = np.uint64(46)


class PieceTable:
    """Pieces, as sequences of signs (bytes or code points), by a 64-bit polynomial hash."""

    def __init__(self, pieces: Sequence[Sequence[int]]):
        self.longest = max(map(len, pieces))
        self.lengths = {len(p) for p in pieces}
        hashes = np.asarray([self._hash(p) for p in pieces], dtype=np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have the same hash")
        # slots by the high bits of different products; a piece stands in the first level where its slot is free
        self.levels, left = [], np.arange(len(pieces))
        for factor in _FACTORS:
            slot = (hashes[left] * factor >> _SHIFT).astype(np.int64)
            _, at = np.unique(slot, return_index=True)
            held, of = np.zeros(1 << 18, dtype=np.uint64), np.full(1 << 18, -1, dtype=np.int32)
            held[slot[at]], of[slot[at]] = hashes[left[at]], left[at]
            self.levels.append((factor, held, of))
            left = np.delete(left, at)
            if not len(left):
                return
        raise ValueError("the vocabulary is too large for its table")

    @staticmethod
    def _hash(piece: Sequence[int]) -> int:
        h = 0
        for b in piece:
            h = (h * _MUL + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def of(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int32)
        for factor, held, of in self.levels:
            slot = (h * factor >> _SHIFT).astype(np.int64)
            hit = held[slot] == h
            out[hit] = of[slot[hit]]
        return out

    def arcs(self, grid: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """start, end and each word's piece there (or -1), for words of one length as the rows of a grid; by rising end,
        then by rising start."""
        n, length = grid.shape
        prefix = np.zeros((length + 1, n), dtype=np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * np.uint64(_MUL) + grid[:, i].astype(np.uint64) + np.uint64(1)
        power = np.cumprod(np.asarray([1] + [_MUL] * length, dtype=np.uint64))
        for end in range(1, length + 1):
            for start in (s for s in range(max(0, end - self.longest), end) if end - s in self.lengths):
                yield start, end, self.of(prefix[end] - prefix[start] * power[end - start])
