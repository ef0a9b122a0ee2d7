"""64-bit hashes of words and of runs of words, for whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return text.lower().encode().split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    return many_word_hashes([text])[0]


def many_word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """``word_hashes`` of each text, with every distinct word hashed once."""
    split = pc.ascii_split_whitespace(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    words_, owner = split.flatten(), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(words_), 0)
    coded = words_.filter(real).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    flat = each[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    sizes = np.bincount(owner.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(texts) else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """One hash for each run of ``size`` words; a shorter text is one run, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = out * _BASE + hashes[i : n - width + 1 + i]
    return mix(out + np.uint64(width))


def bag(hashes: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a list of word hashes, in order, and how often each occurs."""
    return np.unique(shingle_hashes(hashes, size), return_counts=True)


def multiset(text: str | None, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, in order, and how often each occurs."""
    return bag(word_hashes(text), size)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts over the sum of the larger ones."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (total - shared))
