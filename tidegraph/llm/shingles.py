"""Words, word shingles and MinHash signatures of one text (small numpy helpers)."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and the five ASCII controls 9-13, A-Z lower-cased."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``width``-word shingles.

    A text with fewer words has one shingle, its whole word sequence; a text
    without words (or null) has none.
    """
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    k = min(width, len(tokens))
    out = hashes[: len(hashes) - k + 1].copy()
    for i in range(1, k):
        out *= _MUL
        out += hashes[i : len(hashes) - k + 1 + i]
    out += np.uint64(k)
    out ^= out >> _HALF
    out *= _MIX
    out ^= out >> _HALF
    return np.unique(out)


class MinHasher:
    """``n`` universal hash functions ``a*x + b`` over 64-bit words, high half kept."""

    def __init__(self, n: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**63, n, np.uint64) * np.uint64(2)
        self.block = 1024

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """The ``n`` minima as uint32; ``shingles`` must not be empty."""
        best = None
        for at in range(0, len(shingles), self.block):
            part = np.multiply.outer(self.a, shingles[at : at + self.block])
            part += self.b[:, None]
            low = part.min(axis=1)
            best = low if best is None else np.minimum(best, low)
        return (best >> _HALF).astype(np.uint32)
