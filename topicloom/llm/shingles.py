"""Word hashes and word-run hashes of whole texts, in numpy. Used inside Arrow functions on the executors."""

from __future__ import annotations

import numpy as np
import xxhash

G = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __init__(self, most: int = 50_000) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs without ASCII white space; with ``lower``, A to Z become a to z."""
    raw = (text or "").encode()
    return (raw.translate(_LOWER) if lower else raw).split()


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words; of fewer words, one hash of all; of none, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * G + hashes[i : n - k + 1 + i] + np.uint64(i + 1))
    return out


def shingle_set(words: list[bytes], k: int, memo: Words) -> np.ndarray:
    """Sorted distinct run hashes."""
    return np.unique(runs(memo.hashes(words), k))


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def super_min_hash(flat: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n, m) of n sets: ``flat`` holds all elements, ``owner`` the set of each.

    Each element ranks the m slots by a permutation of its own, and offers slot p(j) the value j + r with r
    from [0, 1): the ranks of one element are correlated across slots, which lowers the variance against m
    independent hashes. Rounds go by j; a set is done as soon as all its slots hold less than the next j,
    for nothing later can go below. m is a power of two, and p(j) = a j + b mod m with an odd a.
    """
    out = np.full(n * m, np.inf)
    a, b = mix(flat ^ G) | np.uint64(1), mix(flat + G)
    last = np.uint64(m - 1)
    for j in range(m):
        r = (mix(flat + np.uint64(int(G) * (j + 2) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        slot = (a * np.uint64(j) + b) & last
        np.minimum.at(out, owner * m + slot.astype(np.int64), j + r)
        done = out.reshape(n, m).max(axis=1) < j + 1
        go = ~done[owner]
        if not go.any():
            break
        flat, owner, a, b = flat[go], owner[go], a[go], b[go]
    return out.reshape(n, m)
