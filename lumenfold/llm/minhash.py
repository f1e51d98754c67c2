"""Word-shingle sets and their minima under many universal hash functions."""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P2
    return x ^ (x >> np.uint64(29))


class Shingler:
    """64-bit hashes of the distinct shingles of ``width`` words; words are parted by ASCII spaces, A-Z lower-cased.

    A text with fewer words has its whole word sequence as one shingle; one without words has none."""

    def __init__(self, width: int, cache_entries: int = 500_000):
        self.width, self.cache_entries = width, cache_entries
        self.words: dict[bytes, int] = {}

    def sets(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        held = self.words
        if len(held) > self.cache_entries:
            held.clear()
        hashes = []
        for w in words:
            h = held.get(w)
            if h is None:
                h = held[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        h = np.asarray(hashes, dtype=np.uint64)
        n = max(1, len(h) - self.width + 1)
        width = min(self.width, len(h))
        out = h[:n].copy()
        for i in range(1, width):
            out = _mixed(out * _P1 + h[i : i + n])
        return np.unique(_mixed(out + np.uint64(width)))


class Minima:
    """``bands * rows`` minima of a set under (a * x + b) mod 2**64 >> 32 with odd a, drawn from a fixed seed."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(shingles), 4096):
            part = shingles[at : at + 4096]
            for i in range(0, len(self.a), 32):  # 32 functions at a time stay in the cache
                low = ((self.a[i : i + 32, None] * part + self.b[i : i + 32, None]) >> np.uint64(32)).min(1)
                out[i : i + 32] = np.minimum(out[i : i + 32], low.astype(np.uint32))
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key a band; different bands never share keys but by chance."""
        rows = minima.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * _P1
        for j in range(self.rows):
            key = _mixed(key * _P1 + rows[:, j])
        return key.view(np.int64)

    @staticmethod
    def signature(minima: np.ndarray) -> bytes:
        """A byte of each minimum: enough to estimate the share of equal ones."""
        return (minima & np.uint32(0xFF)).astype(np.uint8).tobytes()


def equal_minima(similarity: float, n: int, sigmas: float = 5.0) -> int:
    """Fewest equal bytes of n that a pair at ``similarity`` shows, but for chances beyond ``sigmas`` deviations."""
    return max(0, int(n * similarity - sigmas * (n * similarity * (1 - similarity)) ** 0.5))


def enough_in_common(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
