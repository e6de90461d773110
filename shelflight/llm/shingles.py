"""Word shingles of many texts as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the public splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for every word of all texts in a row, and where each text's words begin and the last ends.

    A-Z are put in lower case; words are runs without space, tab, line feed, vertical tab, form feed or return.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    numbers = pd.util.hash_array(np.array([*words, ""], dtype=object), categorize=False)[:-1]
    index = coded.indices.to_numpy(zero_copy_only=False)
    real = np.array([bool(w) for w in words], dtype=bool)[index]  # a blank at either end splits off an empty word
    offsets = split.offsets.to_numpy()
    return numbers[index[real]], np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]


def shingle_numbers(words: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that begin at each word, and begins of each text's run of them.

    Every text with `size` words or more has its runs of `size` words, a shorter one its whole sequence as one
    shingle, a text without words none. Numbers of words start from the count, so lengths do not mix.
    """
    counts = np.diff(begins)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(each)])
    first = np.repeat(begins[:-1] - at[:-1], each) + np.arange(at[-1])
    number = np.repeat(np.minimum(counts, size).astype(np.uint64), each)
    padded = np.concatenate([words, np.zeros(size, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        for i in range(size):
            more = mix(number * np.uint64(0x9E3779B97F4A7C15) + padded[first + i])
            number = np.where(np.repeat(counts > i, each), more, number) if i and (counts < size).any() else more
    return number, at


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The set of shingles of each text, as a sorted array."""
    numbers, at = shingle_numbers(*word_numbers(texts), size)
    return [np.unique(numbers[a:b]) for a, b in zip(at, at[1:], strict=False)]
