"""Sets of word shingles as sorted 64-bit hashes, and hashed bitmaps of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .kernel import LOWER, Prefix, buffers, mix, windows, word_bounds

WIDTH = 5


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word windows of each text, A-Z in lower case.

    A text with fewer words has one shingle, its whole sequence; one without
    words, or null, has none.
    """
    data, offsets = buffers(column)
    low = LOWER[data]
    starts, ends, first = word_bounds(low, offsets)
    hashes = Prefix(low).hash(starts, ends)
    grams = windows(hashes, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(windows(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set: 2 to 4 bits for each element, a power of two of 64 or more."""
    words = 1 << max(0, (max(len(hashes), 1) * 2 - 1).bit_length() - 6)
    bits = np.zeros(words * 64, np.uint8)
    bits[(hashes >> np.uint64(7)) & np.uint64(words * 64 - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set at a smaller width."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def overlap_bound(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """Upper bound of the intersection: each bit of one alone stands for an element of one alone."""
    words = min(len(a), len(b))
    a, b = fold(a, words), fold(b, words)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128-bit key of a set, as two signed 64-bit integers."""
    one = mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    two = mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Exact size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
