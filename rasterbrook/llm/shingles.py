"""Sets of word shingles as 64-bit hashes, the same on every executor."""

from __future__ import annotations

import numpy as np

_C = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64), begin, end
    size = end - begin
    longest = int(size.max())
    if len(_powers[0]) < longest:
        p = np.full(max(64, 2 * longest), _C | np.uint64(1), np.uint64)
        p[0] = 1
        _powers[0] = np.cumprod(p, dtype=np.uint64)
    kept = _LOWER[data[word]]
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    within = np.arange(len(kept)) - np.repeat(first, size)
    return mixed(np.add.reduceat(_BYTES[kept] * _powers[0][within], first) + size.astype(np.uint64)), begin, end


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """The hash of each k neighbouring words; of all words together where there are fewer."""
    n = len(words)
    if not n:
        return words
    size = min(n, k)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = mixed(h * _C + words[j : n - size + 1 + j])
    return h


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes as signed longs, in the order of a random permutation of them."""
    if not text:
        return np.zeros(0, np.int64)
    return np.unique(shingle_hashes(word_hashes(text)[0], k).view(np.int64))


_byte = np.where(_SPACE, np.uint64(0), _BYTES[_LOWER])
_raised = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def batch_shingles(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k neighbouring words of many texts, and where each text's words begin (and the last one's end).

    A text of n words has its n - k + 1 hashes there; those of its last k - 1 places run into the next text
    and mean nothing. Words are as in word_hashes, their hashes are others.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    if len(_raised[0]) < len(data):
        for i, c in enumerate((int(_C) | 1, pow(int(_C) | 1, -1, 1 << 64))):
            p = np.full(max(1 << 19, len(data)), c, np.uint64)
            p[0] = 1
            _raised[i] = np.cumprod(p, dtype=np.uint64)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    # Sums of bytes times powers of an odd number; a word's is moved to its first byte.
    sums = np.cumsum(_byte[data] * _raised[0][: len(data)], dtype=np.uint64)
    words = mixed((sums[end - 1] - sums[begin - 1]) * _raised[1][begin] + (end - begin).astype(np.uint64))
    starts = np.searchsorted(begin, np.cumsum([1, *(len(p) + 1 for p in parts)]))
    h = np.full(len(words), k, np.uint64)
    for j in range(k):
        h[: len(words) - j] = h[: len(words) - j] * _C + words[j:]
    return mixed(h), starts
