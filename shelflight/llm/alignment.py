"""Align the token ids of two tokenizers over the same texts, and count which ids go together.

The ends of the tokens, as byte offsets, are put in one dictionary from end to index for each tokenizer. The ends
that both dictionaries hold cut both id lists into groups. Every id of one side of a group is linked with every id of
the other.

Neither tokenizer joins a character that is no white space with a space after it, so both have an end there: a text's
alignment is that of its words, one after another. Each different word is aligned once and remembered.
"""

from __future__ import annotations

import bisect
import collections
import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.shared import CACHES, ship, stored, tidy
from shelflight.llm.token_ids import slices

SLICE = 2 << 20
LONG = 4_096  # links of a group from which they are counted by distinct ids
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the split of byte-level BPE
FREQUENT = 20  # at most 2^20 pairs are broadcast: those that more than a 2^20th of all (document, pair) rows have


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for (printable bytes stand for themselves)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sizes_of(spell: dict[int, bytes]) -> np.ndarray:
    sizes = np.zeros(max(spell) + 1, np.int64)
    sizes[list(spell)] = list(map(len, spell.values()))
    return sizes


def joiner(spell: dict[int, bytes]) -> Callable[[list[int]], bytes]:
    one = spell.__getitem__
    return lambda ids: b"".join(map(one, ids))


class ByteTokenizer:
    """Byte-level BPE from a `tokenizers` file, without its special tokens. `spell` has the bytes of every id."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["id"] for t in model["added_tokens"]}
        byte = byte_alphabet()
        self.spell = {i: bytes(map(byte.__getitem__, token)) for token, i in model["model"]["vocab"].items() if i not in special}
        # Ids ascend in the order of the merges, so they are the ranks.
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLITS, mergeable_ranks={b: i for i, b in self.spell.items()}, special_tokens={})
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.sizes, self.join = sizes_of(self.spell), joiner(self.spell)

    def encode(self, text: str) -> list[int]:
        # The fast one splits by a pattern that gives up on runs of very many blanks.
        if len(text) > 100_000:
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokenizer:
    """BPE over pieces with byte fallback, which puts a space before a text. `spell` has the bytes of every id."""

    SPACE = "▁"

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spell = {i: self._bytes(piece) for i, piece in enumerate(pieces)}
        self.sizes, self.join = sizes_of(self.spell), joiner(self.spell)
        # No merge crosses the place before a space if no piece has a space after another character.
        self.apart = not any(self.SPACE in piece.lstrip(self.SPACE) for piece in pieces)

    def _bytes(self, piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(self.SPACE, " ").encode()

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of words, whose leading space is the one that the tokenizer would put there."""
        ids = self.model.encode([w[1:] for w in words], num_threads=1)
        # A space alone: the tokenizer has no ids for an empty text.
        return [[self.model.piece_to_id(self.SPACE)] if w == " " else x for w, x in zip(words, ids, strict=True)]


def common_ends(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The ends that both lists hold, in order, and how many ids of either side lie up to each."""
    index_a, index_b = (dict(zip(ends, itertools.count(1))) for ends in (ends_a, ends_b))
    both = sorted(index_a.keys() & index_b.keys())
    return both, list(map(index_a.__getitem__, both)), list(map(index_b.__getitem__, both))


def groups_text(a: list[int], b: list[int], at_a: list[int], at_b: list[int]) -> list[str]:
    """Each group as text: the ids of either side joined by commas, with a bar between the sides."""
    a, b = list(map(str, a)), list(map(str, b))
    return [
        f"{a[i]}|{b[k]}" if j - i == 1 == m - k else f"{','.join(a[i:j])}|{','.join(b[k:m])}"
        for i, j, k, m in zip([0, *at_a], at_a, [0, *at_b], at_b)
    ]


def add(many: dict[int, int], more: dict[int, int]) -> None:
    for pair, times in more.items():
        many[pair] = many.get(pair, 0) + times


def links(a: list[int], b: list[int]) -> dict[int, int]:
    """How often each pair of ids of a group is linked, as one number of 64 bits for the pair.

    By distinct ids, so that a long group costs no more than its pairs.
    """
    many: dict[int, int] = {}
    times_b = collections.Counter(b).items()
    for i, times in collections.Counter(a).items():
        for j, more in times_b:
            many[i << 32 | j] = times * more
    return many


class Aligner:
    """Aligns texts word by word. The memory of words is emptied when it holds `words` entries, which changes no result."""

    def __init__(self, path_a: str, path_b: str, words: int = 250_000) -> None:
        self.one, self.two, self.limit = ByteTokenizer(path_a), PieceTokenizer(path_b), words
        # Groups as text, pairs as bytes, n_a, n_b, n_groups, and links of long groups; None if the ids do not spell the word.
        self.known: dict[str, tuple | None] = {}

    def learn(self, words: list[str]) -> None:
        """Align different words, all in one: both sides have an end where a word ends."""
        both = list(map(self.one.encode, words)), self.two.encode(words)
        bytes_of = [word.encode() for word in words]
        good = []
        for i, (word, a, b) in enumerate(zip(bytes_of, *both, strict=True)):
            if self.one.join(a) == word == self.two.join(b):
                good.append(i)
            else:
                self.known[words[i]] = None
        each = [[ids[i] for i in good] for ids in both]
        a, b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64) for ids in each)
        ends = [np.cumsum(side.sizes[ids]).tolist() for side, ids in ((self.one, a), (self.two, b))]
        common, at_a, at_b = common_ends(*ends)
        told = groups_text(a.tolist(), b.tolist(), at_a, at_b)
        begin_a, begin_b = (np.array([0, *at], np.int64) for at in (at_a, at_b))
        n_a, n_b = np.diff(begin_a), np.diff(begin_b)
        long = n_a * n_b > LONG
        many = np.where(long, 0, n_a * n_b)
        begin = np.cumsum([0, *many])
        group = np.repeat(np.arange(len(many)), many)
        within = np.arange(begin[-1]) - begin[group]
        pairs = a[begin_a[group] + within // n_b[group]] << 32 | b[begin_b[group] + within % n_b[group]]
        of_word = [0, *np.searchsorted(common, np.cumsum([len(bytes_of[i]) for i in good]), side="right").tolist()]
        extra: dict[int, dict[int, int]] = {}
        for g in np.flatnonzero(long).tolist():
            sides = a[begin_a[g] : begin_a[g + 1]].tolist(), b[begin_b[g] : begin_b[g + 1]].tolist()
            add(extra.setdefault(bisect.bisect_right(of_word, g) - 1, {}), links(*sides))
        for k, (i, first, last) in enumerate(zip(good, of_word, of_word[1:], strict=False)):
            spelt = pairs[begin[first] : begin[last]].tobytes()
            self.known[words[i]] = (";".join(told[first:last]), spelt, len(both[0][i]), len(both[1][i]), last - first, extra.get(k))

    def texts(self, texts: list[str]) -> list[tuple]:
        """Groups as text, pairs, times, n_a, n_b and n_groups of each text; nothing where its tokens do not spell it."""
        split = [_WORDS.findall(" " + t) if self.two.apart else [" " + t] if t else [] for t in texts]
        split = [words if text and PieceTokenizer.SPACE not in text else [] for text, words in zip(texts, split, strict=True)]
        used = set(itertools.chain.from_iterable(split))
        new = [w for w in used if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(used)
        if new:
            self.learn(new)
        return list(map(self._joined, split))

    def _joined(self, words: list[str]) -> tuple:
        found = list(map(self.known.__getitem__, words))
        if not words or None in found:
            return "", _NONE, _NONE, 0, 0, 0
        told, pairs, n_a, n_b, n_groups, extra = zip(*found, strict=True)
        pairs, times = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True)
        if any(extra):
            all_links = dict(zip(pairs.tolist(), times.tolist(), strict=True))
            for more in filter(None, extra):
                add(all_links, more)
            pairs, times = (np.fromiter(x, np.int64, len(all_links)) for x in (all_links.keys(), all_links.values()))
        return ";".join(told), pairs, times, sum(n_a), sum(n_b), sum(n_groups)


_NONE = np.zeros(0, np.int64)
# From white space up to the next space that follows another character; white space at the end.
_WORDS = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+\Z")


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs and times for every row.

    Both tokenizers encode the whole text with a space before it (the second adds it itself). `groups` is the alignment
    as text, `a1,a2|b1;a3|b2,b3`; pairs holds each linked pair of ids once, as a * 2^32 + b, times how often.
    A text that is null or empty, or that the tokens of either side do not spell, has none: zeros, an empty text.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for batch in batches:
            for first, count in slices(batch.column("text"), SLICE):
                part = batch.slice(first, count)
                told, pairs, times, *counts = zip(*aligner.texts(part.column("text").to_pylist()), strict=True)
                numbers = [pa.array(x, pa.int64()) for x in (*counts, [int(t.sum()) for t in times])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *numbers, pa.array(told), lists(pairs), lists(times)], names=names)
        tidy(keep=ALIGNERS)  # the memory of words serves the next task

    return rows.mapInArrow(work, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>")


ALIGNERS: dict[tuple[str, str], Aligner] = {}
CACHES.append(ALIGNERS)


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker process and pair of files."""
    if (path_a, path_b) not in ALIGNERS:
        ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return ALIGNERS[path_a, path_b]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (documents that hold it) and best (no pair of its first id has a larger count)."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    first = F.shiftright("pair", 32).alias("first")
    # One row for each id of the first vocabulary.
    most = counts.groupBy(first).agg(F.max("count").alias("most"))
    return counts.withColumn("first", first).join(most, "first").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """The stored rows of `alignments` with n_best and count_sum instead of pairs and times.

    Pairs that more than a 2^20th of all (document, pair) rows hold are broadcast, at most 2^20 of them, and take
    most links. The rows of the other pairs are joined with their counts by a shuffle, in which no pair is frequent.
    """
    spark = aligned.sparkSession
    counts = stored(pair_counts(aligned), "counted-pairs")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    frequent = F.col("count") > (total >> FREQUENT)
    top = counts.where(frequent).toArrow().sort_by("pair")
    held = spark.sparkContext.broadcast([top.column(c).to_numpy() for c in ("pair", "count", "best")])
    names = ["row", "best_here", "sum_here", "pairs", "times"]

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counted, best = held.value
        for batch in batches:
            lists = [batch.column(c) for c in ("pairs", "times")]
            pairs, times = (x.flatten().to_numpy() for x in lists)
            at = lists[0].offsets.to_numpy()
            at = at - at[0]
            place = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            known = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)

            def sums(values: np.ndarray, at: np.ndarray = at) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])

            of = np.where(known, place, 0) if len(keys) else place
            n_best = sums(times * (known & best[of])) if len(keys) else sums(times * 0)
            n_sum = sums(times * np.where(known, counted[of], 0)) if len(keys) else sums(times * 0)
            ends = np.concatenate([[0], np.cumsum(~known)])[at].astype(np.int32)
            rest = [pa.ListArray.from_arrays(ends, x[~known]) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_best), pa.array(n_sum), *rest], names=names)

    looked = aligned.select("row", "pairs", "times").mapInArrow(look_up, "row bigint, best_here bigint, sum_here bigint, pairs array<bigint>, times array<bigint>")
    looked = stored(looked, "looked-up")
    seldom = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = seldom.join(counts.where(~frequent), "pair").select("row", (F.col("times") * F.col("best").cast("bigint")).alias("b"), (F.col("times") * F.col("count")).alias("s"))
    known = looked.select("row", F.col("best_here").alias("b"), F.col("sum_here").alias("s"))
    sums = known.unionByName(rare).groupBy("row").agg(F.sum("b").alias("n_best"), F.sum("s").alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "row").drop("row")


def align_documents(docs: DataFrame, path_a: str, path_b: str, keep: dict[str, Column]) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, the columns that `keep` makes of `groups`, n_best, count_sum.

    n_best counts the links whose pair is held by as many documents as any pair of its first id; count_sum adds up, over
    the links, how many documents hold their pair. A row is a document, whatever its doc_id, so repeated rows count each
    and a null doc_id is kept. Null and empty texts, and texts that the tokens do not spell, have zeros and an
    empty `groups`. Very long texts are aligned whole. An empty table gives no rows; other columns are not looked at.
    """
    aligned = alignments(docs, path_a, path_b).withColumns(keep).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *keep, "pairs", "times", F.monotonically_increasing_id().alias("row")
    )
    return with_counts(stored(aligned, "alignments"))
