"""Vectorised 64-bit hashes of words and word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 300_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Words:
    """Hashes of words, remembered in the worker up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> tuple[list[bytes], np.ndarray]:
        """Words between ASCII white space, unchanged, and their hashes."""
        words = text.encode("utf-8").split()
        known = self.known
        try:
            return words, np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return words, np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; fewer words, but not none, are one run."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        # doubling: a run of k words from runs of powers of two
        run, length, out, done = words, 1, None, 0
        power = BASE
        while True:
            if k & length:
                out = run[: n - k + 1] if out is None else out * power + run[done: done + n - k + 1]
                done += length
            if length * 2 > k:
                break
            run = run[: len(run) - length] * power + run[length:]
            power, length = power * power, length * 2
        return mix(out + np.uint64(k))
