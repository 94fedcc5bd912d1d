"""Hashing of words and shingles, many texts at a time (numpy, used inside tasks)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import xxhash

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SPACES = bytes(range(9, 14)) + b" "
_LOWER = bytes(32 if b in _SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Runs of bytes outside space and 0x09-0x0D, A-Z lower-cased."""
    return text.translate(_LOWER).split()


class _Hashes(dict):
    """Hash of each word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hash_words(
    texts: Sequence[bytes], split: Callable[[bytes], list[bytes]] = split_words
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words of each text."""
    seen = _Hashes()
    counts = np.empty(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        found = split(text)
        counts[i] = len(found)
        parts.append(np.fromiter(map(seen.__getitem__, found), U64, len(found)))
    return (np.concatenate(parts) if parts else np.empty(0, U64)), counts


def shingle_sets(texts: Sequence[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each text as 64-bit hashes, and their number for each text.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    The hashes of a text are sorted and stand together, in the order of the texts.
    """
    words, counts = hash_words(texts)
    owner = np.repeat(np.arange(len(texts)), np.where(counts >= n, counts - n + 1, (counts > 0)))
    first = np.cumsum(counts) - counts
    if not len(owner):
        return np.empty(0, U64), np.zeros(len(texts), np.int64)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    at = first[owner] + place
    length = np.minimum(counts[owner], n)
    h = np.zeros(len(owner), U64)
    for k in range(n):
        live = k < length
        h = np.where(live, mix(h * U64(0x9E3779B97F4A7C15) + words[np.where(live, at + k, 0)]), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts)).astype(np.int64)
