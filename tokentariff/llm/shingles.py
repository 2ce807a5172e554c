"""Words and hashed word windows of whole texts, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# An odd multiplier for each place of a window, without a linear relation between them; all 64-bit
# sums wrap.
_PLACES = np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(64)],
                   dtype=np.uint64)
_CACHE_WORDS = 400_000
_LONG_WORD = 64


def _table(kept: str | None) -> bytes:
    """ASCII lower-casing; with ``kept``, every other ASCII byte becomes a blank."""
    table = bytearray(range(256))
    for i in range(128):
        char = chr(i)
        if kept is not None and char not in kept and char.lower() not in kept:
            table[i] = 32
        elif "A" <= char <= "Z":
            table[i] = i + 32
    return bytes(table)


LOWER_ONLY = _table(None)
ALPHANUMERIC = _table("abcdefghijklmnopqrstuvwxyz0123456789")


def words_of(text: str | None, table: bytes = LOWER_ONLY) -> list[bytes]:
    """Lower-cased UTF-8 words between blanks (space, tab to carriage return)."""
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, kept for words of ordinary length; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _LONG_WORD:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums (a fixed bijection)."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for every window of ``size`` consecutive words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for place in range(size):
        total += hashes[place:place + count] * _PLACES[place]
    return mixed(total + np.uint64(size))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct windows; a shorter sequence of words is one window as a whole."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    return np.unique(windows(hashes, min(size, len(hashes))))
