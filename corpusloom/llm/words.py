"""Words, as bytes between ASCII white space, and their 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from corpusloom.llm.workers import take_turn

#: Deletes [\x20\x09-\x0D] with bytes.translate.
SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class WordHashes(dict):
    """Word -> xxhash64. Keeps the first `limit` words that a Python worker meets in its turn; the others are hashed anew."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit and len(word) < 256:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        take_turn(self)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Hashes of the n-word shingles in order; fewer words than n: one of the whole sequence; none: empty."""
    if not words:
        return np.empty(0, np.uint64)
    h = HASHES.of(words)
    n = min(n, len(h))
    out = mixed(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out
