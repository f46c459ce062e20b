"""Sets of five-word shingles as sorted 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
SEGMENT = 1 << 20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the base and of its inverse."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def _segment_hashes(b: np.ndarray) -> np.ndarray:
    gap = _GAP[b]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    up, down = _power_tables(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_FOLD[b]] * up[: len(b)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word, with A-Z in lower case. Long texts go by segments that end at a gap."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(b) <= SEGMENT:
        return _segment_hashes(b)
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + SEGMENT)
        while end < len(b):
            gaps = np.nonzero(_GAP[b[end : end + SEGMENT]])[0]
            end += int(gaps[0]) if len(gaps) else min(SEGMENT, len(b) - end)
            if len(gaps):
                break
        out.append(_segment_hashes(b[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words, their whole sequence is the one shingle."""
    w = word_hashes(text or "")
    if not len(w):
        return np.zeros(0, np.uint64)
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = mix(h * _M2 + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def class_number(s: np.ndarray) -> int:
    """A signed 64-bit number that stands for a set."""
    a, b = np.add.reduce(mix(s), dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ _M3))
    both = mix(np.array([a], np.uint64) * _M2 ^ mix(np.array([b + np.uint64(len(s))], np.uint64)))
    return int(both.view(np.int64)[0])
