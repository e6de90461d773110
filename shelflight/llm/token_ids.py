"""Token ids of many texts by a public tokenizer, each distinct word encoded once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelflight.llm.shared import CACHES

# Texts of printable ASCII without apostrophes and of composed Latin letters, where case and splits are plain.
_ODD = r"[^\t-\r -&(-~À-ÖØ-öø-ÿ]|<\|"
_MARKS = r"([!-/:-@\[-`{-~]+)"


class WordTokenizer:
    """Encodes whole texts through a memory of words, for tokenizers that split at white space and drop it.

    Plain texts are put into lower case and set apart from their punctuation first, which this tokenizer would do
    itself, so that fewer different words remain; other texts are only split at ASCII white space. Each different
    word is encoded once by the tokenizer. The memory is emptied when it holds over `words` entries, which changes
    no result.
    """

    def __init__(self, path: str, words: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), words
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.sizes, self.begins = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        # A run of Latin letters is one unit for the tokenizer, so many go in one call; each closes with a word end.
        simple, other = [], []
        for word in words:
            (simple if word.isalpha() and max(word) <= "ÿ" else other).append(word)
        texts = [" ".join(simple[i : i + 2000]) for i in range(0, len(simple), 2000)]
        ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
        sizes = np.diff(np.flatnonzero(self.ends[flat]) + 1, prepend=0)
        if len(sizes) != len(simple):
            raise ValueError("the tokenizer does not end every word with a word-end token")
        rest = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        sizes = np.concatenate([sizes, np.fromiter(map(len, rest), np.int64, len(rest))]).astype(np.int32)
        self.number.update(zip(simple + other, range(len(self.sizes), len(self.sizes) + len(sizes)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes, dtype=np.int32) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, flat, *rest])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin and the last ends."""
        odd = pc.match_substring_regex(texts, _ODD)
        plain = pc.replace_substring_regex(pc.utf8_lower(texts), _MARKS, r" \1 ")
        split = pc.ascii_split_whitespace(pc.if_else(odd, texts, plain))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.number) > self.limit:
            self._forget()
        unknown = [w for w in words if w not in self.number]
        if unknown:
            self._learn(unknown)
        entry = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        entry = entry[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.sizes[entry]
        ends = np.cumsum(lengths, dtype=np.int64)
        place = np.repeat(self.begins[entry] - (ends - lengths), lengths)
        place += np.arange(len(place))
        offsets = split.offsets.to_numpy()
        return self.ids[place], np.concatenate([[0], ends])[offsets - offsets[0]]


LOADED: dict[str, WordTokenizer] = {}
CACHES.append(LOADED)


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process and file."""
    if path not in LOADED:
        LOADED[path] = WordTokenizer(path)
    return LOADED[path]


def slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """(first, rows) of runs of texts with about `most` bytes each; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, first = [], 0
    while first < len(texts):
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + most, side="right")))
        out.append((first, last - first))
        first = last
    return out
