"""Character statistics of whole texts with numpy, for the linear classifiers."""

from __future__ import annotations

import numpy as np

#: Characters taken at once, so that a very long text needs bounded memory.
CHUNK = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def ngram_counts(text: str, bits: int, longest: int = 3) -> np.ndarray:
    """Counts of the character n-grams of lengths 1 to ``longest``, hashed to 2**bits places."""
    c = codes(text)
    out = np.zeros(1 << bits, dtype=np.int64)
    shift = np.uint32(32 - bits)
    for at in range(0, len(c), CHUNK):
        part = c[at : at + CHUNK + longest - 1]
        h = np.full(len(part), 0x27D4EB2F, dtype=np.uint32)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * _MIX[(n - 1) % 3]
            h ^= h >> np.uint32(15)
            own = h[:CHUNK] * np.uint32(0x165667B1) >> shift
            out += np.bincount(own, minlength=1 << bits)
    return out


def utf8_histogram(text: str) -> np.ndarray:
    """Counts of the 256 byte values of the text's UTF-8."""
    return np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
