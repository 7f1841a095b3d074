"""Words of a text as 64-bit hashes, without a Python step for each word.

A word is a run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text; everything else separates words.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 16
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, 1 << 64))
        filled += more
    return out


_UP, _DOWN = _powers(_BASE, _STEP), _powers(pow(_BASE, -1, 1 << 64), _STEP)


def _grow(n: int) -> None:
    global _UP, _DOWN
    if n > len(_UP):
        size = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word; bytes are of the lower-cased UTF-8 text."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    _grow(len(raw) + 1)
    inside = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw + np.uint64(1)) * _UP[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * _DOWN[start] + (end - start).astype(np.uint64)), start, end


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of a shorter, non-empty text the one run of all its words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
    return mix(out)
