"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from tidemark.llm.common import give_back

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _Words(dict):
    """Hash of a word; emptied at a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


_hash_of = _Words()


def forget() -> None:
    """Give back what hashes of words take; for the end of a task, as the worker goes on to others."""
    _hash_of.clear()
    give_back()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIERS[3]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z in lower case; of fewer words, one of all; of none, none.

    k is 8 at most. Two shingles that differ in one word never share a hash unless the words do.
    """
    words = text.encode().lower().split() if text else ()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        if n < k:
            return _mixed((w * _MULTIPLIERS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        h = w[: n - k + 1] * _MULTIPLIERS[0]
        for i in range(1, k):
            h += w[i : n - k + 1 + i] * _MULTIPLIERS[i]
        return np.unique(_mixed(h))


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist()
    return a, b
