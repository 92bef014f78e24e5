"""Words, shingles and their hashes, shared by the near-duplicate operators.

A word is a lower-cased run of letters and digits. Words are hashed from the text's code points with whole-array numpy
operations (a polynomial in a fixed odd base, finished by a mix), so no Python object is made for each word.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
#: Code points hashed at once; longer texts are cut between words.
BLOCK = 1 << 20
#: Odd multipliers of the polynomials and of the final mix (public splitmix64 constants).
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; a null text has none."""
    return WORD.findall(text.lower()) if text else []


def mix(values: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer over a uint64 array."""
    values = (values ^ (values >> np.uint64(30))) * _MIX1
    values = (values ^ (values >> np.uint64(27))) * _MIX2
    return values ^ (values >> np.uint64(31))


@lru_cache(1)
def _word_chars() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(8)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and its inverse's, modulo 2**64."""
    up = np.full(size, np.uint64(_BASE), np.uint64)
    down = np.full(size, np.uint64(pow(_BASE, -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(1)
def letter_chars() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() and not chr(c).isdecimal() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def run_hashes(codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of code points that are inside."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.append(edge, len(codes))
    if not len(edge):
        return edge, edge, np.empty(0, np.uint64)
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(max(4096, 1 << int(len(codes)).bit_length()))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * up[: len(codes)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _block_hashes(codes: np.ndarray) -> np.ndarray:
    return run_hashes(codes, _word_chars()[codes])[2]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of the whole text, in order."""
    if not text:
        return np.empty(0, np.uint64)
    codes = code_points(text.lower())
    if len(codes) <= BLOCK:
        return _block_hashes(codes)
    parts, start, inside = [], 0, _word_chars()
    while start < len(codes):
        end = min(start + BLOCK, len(codes))
        while end < len(codes) and inside[codes[end]]:
            end += 1
        parts.append(_block_hashes(codes[start:end]))
        start = end
    return np.concatenate(parts)


def shingle_sequence(hashed: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words in text order; fewer words make one shingle, no words none."""
    count = len(hashed)
    if not count:
        return hashed
    span = min(size, count)
    rolled = hashed[: count - span + 1].copy()
    for k in range(1, span):
        rolled *= _STEP
        rolled += hashed[k : count - span + 1 + k]
    return mix(rolled + np.uint64(span))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (np.unique without its overhead on short arrays)."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return distinct(shingle_sequence(word_hashes(text), size))


def multipliers(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers, one for each min-wise hash function."""
    return np.random.default_rng(seed).integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray, factors: np.ndarray, step: int = 4096) -> np.ndarray:
    """The minimum of every hash function over a non-empty shingle set, in blocks of bounded size."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), step):
        np.minimum(best, (factors[:, None] * shingles[start : start + step]).min(axis=1), out=best)
    return best
