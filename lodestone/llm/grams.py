"""Word hashes, hashes of word runs, and winnowing, in numpy."""

import hashlib

import numpy as np

CACHE_WORDS = 200_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """A 64-bit hash of each word, the same in every process; a bounded cache."""

    def __missing__(self, word: str) -> int:
        found = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


def hashes(known: WordHash, found: list[str]) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, found), np.int64, len(found)).view(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of a polynomial hash, so that its order is as good as random."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(h: np.ndarray, n: int, odd: np.uint64 = ODD) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(h) < n or not n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * odd + h[k : k + len(out)]
    return mixed(out)


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window of neighbouring hashes; the last among equals."""
    if not len(g):
        return np.empty(0, np.int64)
    if len(g) <= window:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))])
    low, at = g[: len(g) - window + 1].copy(), np.arange(len(g) - window + 1)
    for k in range(1, window):
        other = g[k : k + len(low)]
        less = other <= low
        low = np.where(less, other, low)
        at = np.where(less, np.arange(k, k + len(low)), at)
    return np.unique(at)
