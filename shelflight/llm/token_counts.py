"""Token counts under a unigram model, computed once per shared prefix of words."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.shared import ship, text_or_empty
from shelflight.llm.token_ids import slices

BEGIN = "▁"  # stands before every word, as in the vocabulary
_NO_END = math.nan  # of no piece
UNKNOWN_PENALTY = 10.0  # a character that is no piece scores so much below the last piece
COUNTS = "doc_id bigint, n_words bigint, n_tokens bigint"


def piece_scores(path: str) -> dict[str, float]:
    """Pieces of a vocabulary file with log probabilities by Zipf's law of their ranks.

    The file's own scores are merge ranks, so only their order is used: the piece of rank r has -log(r + 1).
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(rank + 1) for rank, i in enumerate(ranked, start=1)}


class PrefixTrie:
    """Words as paths of characters; a node keeps the best segmentation of the prefix it stands for.

    Best is the largest sum of scores, then the fewest tokens. A character that is no piece is as many tokens as it has
    bytes in UTF-8. A node needs only those above it, so words that share a prefix share its work. The trie starts
    anew beyond `nodes` nodes, which changes no count; words over `longest` characters are not put in it.
    """

    def __init__(self, scores: dict[str, float], nodes: int = 400_000, longest: int = 64) -> None:
        self.scores, self.limit, self.longest = scores, nodes, longest
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        # Every end of a piece, with its score if it is a piece: what is no end of any, no longer text ends in a piece.
        self.ends: dict[str, float | None] = {piece[i:]: None for piece in scores for i in range(1, len(piece))}
        self.ends |= scores
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.counts: dict[str, int] = {}

    def _extend(self, word: str, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Best score and minus its tokens for word[:end], from those of all shorter prefixes."""
        last = word[end - 1]
        before = path[end - 1]
        if last in self.scores:
            best = (before[0] + self.scores[last], before[1] - 1)
        else:
            best = (before[0] + self.unknown, before[1] - len(last.encode("utf-8", "surrogatepass")))
        find = self.ends.get
        for begin in range(end - 2, -1, -1):
            score = find(word[begin:end], _NO_END)
            if score is None:
                continue
            if score is _NO_END:
                break
            way = (path[begin][0] + score, path[begin][1] - 1)
            if way > best:
                best = way
        return best

    def count(self, word: str) -> int:
        """Tokens of a word without its mark of beginning; 0 for none."""
        known = self.counts.get(word)
        if known is not None:
            return known
        if not word:
            return 0
        marked, path = BEGIN + word, [(0.0, 0)]
        if len(marked) > self.longest:
            for end in range(1, len(marked) + 1):
                path.append(self._extend(marked, end, path))
            return -path[-1][1]
        if len(self.best) > self.limit:
            self.clear()
        node = 0
        for end, char in enumerate(marked, start=1):
            step = (node, char)
            below = self.children.get(step)
            if below is None:
                below = self.children[step] = len(self.best)
                self.best.append(self._extend(marked, end, path))
            node = below
            path.append(self.best[node])
        self.counts[word] = -path[-1][1]
        return self.counts[word]


def count_tokens(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text.

    Words are runs without ASCII white space. Null, empty and blank texts have none and no tokens. Repeated rows are
    counted each. Every task has a trie of its own, so nothing is shuffled. An empty table gives no rows. Other
    columns are not looked at.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(scores)  # the vocabulary, whatever the input

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PrefixTrie(held.value)
        for batch in batches:
            for first, rows in slices(batch.column("text"), 8 << 20):
                part = batch.slice(first, rows)
                split = pc.ascii_split_whitespace(part.column("text"))
                coded = split.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                each = np.array([trie.count(w) for w in words] + [0], dtype=np.int64)
                index = coded.indices.to_numpy(zero_copy_only=False)
                at = split.offsets.to_numpy() - split.offsets[0].as_py()
                real = np.array([bool(w) for w in words] + [False])
                sums = [np.concatenate([[0], np.cumsum(x[index])]) for x in (real, each)]
                arrays = [part.column("doc_id"), *(pa.array((s[at[1:]] - s[at[:-1]]).astype(np.int64)) for s in sums)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(count, COUNTS)
