"""Word and shingle hashes of texts with numpy, a bounded number of bytes at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

TEXT_STEP = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its tasks, and what it keeps is missing
    in the next stage.  Called after each Arrow batch."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps(texts: pa.StringArray, limit: int = TEXT_STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes each (one text at least)."""
    sizes = pc.binary_length(texts).to_pylist()
    k = 0
    while k < len(sizes):
        first, size = k, 0
        while k < len(sizes) and (k == first or size + sizes[k] <= limit):
            size += sizes[k]
            k += 1
        yield first, k


def word_codes(texts: pa.StringArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(codes of all words in order, the distinct words, words per text); words are split at
    space, tab, line feed, vertical tab, form feed and carriage return.  No text is null."""
    found = pc.ascii_split_whitespace(texts)
    coded = found.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    counts = pc.list_value_length(found).to_numpy().astype(np.int64)
    if "" in distinct:  # white space at either end of a text
        real = codes != distinct.index("")
        owner = np.repeat(np.arange(len(counts)), counts)
        codes, counts = codes[real], np.bincount(owner[real], minlength=len(counts))
    del found, coded
    pa.default_memory_pool().release_unused()
    return codes, distinct, counts


def hash_words(distinct: list[str]) -> np.ndarray:
    if not distinct:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, from the words' hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out = out * _ODD + h[j:n + j]
    return mix64(out)


def shingle_sets(texts: pa.StringArray, size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z in lower case); a text of fewer words is
    one shingle, an empty one none."""
    for first, last in steps(texts):
        codes, distinct, counts = word_codes(pc.ascii_lower(texts.slice(first, last - first)))
        h = hash_words(distinct)[codes]
        grams = gram_hashes(h, size)
        at = 0
        for n in counts.tolist():
            if n >= size:
                yield np.unique(grams[at:at + n - size + 1])
            elif n:
                yield gram_hashes(h[at:at + n], n) + np.uint64(n)
            else:
                yield np.empty(0, np.uint64)
            at += n
