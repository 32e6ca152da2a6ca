"""Distinct word shingles of texts as 64-bit hashes.

Words are runs of anything but ASCII white space, with A-Z in lower case. A
shingle is ``SIZE`` words in a row; a text with fewer words is one shingle of
all of them, a text without words has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

SIZE = 5
KEPT_WORDS = 150_000
#: Odd multipliers of a word's hash by its place, so that order counts.
_PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_SHORT = 0xE7037ED1A0B428DB


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads near ones apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self.words) < KEPT_WORDS:
            self.words[word] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes of one text."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        get = self.words.get
        hashes = np.array([get(w) or self._hash(w) for w in words], dtype=np.uint64)
        n = len(hashes) - SIZE + 1
        if n < 1:
            places = hashes * np.array(_PLACES[: len(hashes)], np.uint64)
            salt = np.uint64(_SHORT * len(hashes) % (1 << 64))
            return mixed(np.array([places.sum(dtype=np.uint64)], np.uint64) ^ salt)
        joined = np.zeros(n, np.uint64)
        for place in range(SIZE):
            joined += hashes[place : place + n] * np.uint64(_PLACES[place])
        return np.unique(mixed(joined))

    def all_of(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        for text in texts:
            yield self.of(text)


def set_id(shingles: np.ndarray) -> int:
    """64-bit hash of a set of shingles, as a signed number; equal sets have equal ids."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
