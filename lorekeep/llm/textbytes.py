"""Words of UTF-8 texts as numpy arrays: starts, ends and 64-bit hashes, without a Python object per word.

Every separator used here is an ASCII character, and bytes of 0x80 and above always belong to a word, so working on
bytes gives the same words as working on characters.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

ALNUM = np.zeros(256, bool)  # [0-9A-Za-z] and everything beyond ASCII
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_grown: dict[str, np.ndarray] = {"up": _powers(1 << 16, _ODD), "down": _powers(1 << 16, _INVERSE)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _grown["up"].size:
        size = 1 << int(n).bit_length()
        _grown.update(up=_powers(size, _ODD), down=_powers(size, _INVERSE))
    return _grown["up"][:n], _grown["down"][:n]


def word_bounds(raw: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of bytes in `table`."""
    inside = np.zeros(raw.size + 2, np.int8)
    inside[1:-1] = table[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word that depends on its bytes only: differences of one running polynomial, moved back to power 0."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    up, down = _tables(low.size)
    running = np.zeros(low.size + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up, out=running[1:])
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_one(word: str) -> int:
    low = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return int(word_hashes(low, np.array([0]), np.array([low.size]))[0])
