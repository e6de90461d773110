"""A quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, and a few pairs of features have one over both bins. Training
visits the features in turn, fits a shallow tree to the gradient over the bins and adds a small part of it to the
table. A score is the sum of a few table entries, so it can be read and explained.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.shared import ship, text_or_empty, tidy
from shelflight.llm.shingles import shingle_numbers, word_numbers
from shelflight.llm.token_ids import slices

FEATURES = (
    "log_words", "word_length", "upper", "digit", "prose_marks", "symbols", "controls", "distinct_words", "top_word",
    "symbol_words", "bare_words", "upper_words", "short_words", "words_per_line", "repeated_lines", "repeated_runs",
)
# Classes of bytes: 0 lower case and bytes of longer characters, 1 upper case, 2 digits, 3 white space,
# 4 marks of prose, 5 other printable ASCII, 6 control characters.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[:128] = 5
_KIND[:32] = 6
_KIND[127] = 6
for _kind, _bytes in ((0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, b" \t\n\r\x0b\x0c"), (4, b".,;:'\"?()-")):
    _KIND[list(_bytes)] = _kind


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each whole text."""
    lines = pc.split_pattern(texts, "\n")
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    form = coded.dictionary
    length = pc.utf8_length(form).to_numpy(zero_copy_only=False).astype(float)
    flags = np.stack([
        pc.match_substring_regex(form, r"[#$%&*|<>{}\[\]\\^~=+@_/!]").to_numpy(zero_copy_only=False),
        pc.match_substring_regex(form, r"^[^\p{L}\p{N}]*$").to_numpy(zero_copy_only=False),
        pc.match_substring_regex(form, r"^\p{Lu}{2,}[^\p{Ll}]*$").to_numpy(zero_copy_only=False),
        length <= 3,
        np.ones(len(form), dtype=bool),
    ]) & (length > 0)
    index = coded.indices.to_numpy(zero_copy_only=False)
    word_at = split.offsets.to_numpy() - split.offsets[0].as_py()
    line_code = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    line_at = lines.offsets.to_numpy() - lines.offsets[0].as_py()
    words, begins = word_numbers(texts)
    runs, run_at = shingle_numbers(words, begins, 3)
    raw = texts.cast(pa.binary())
    out = np.zeros((len(texts), len(FEATURES)))
    for i in range(len(texts)):
        kinds = np.bincount(_KIND[np.frombuffer(raw[i].as_buffer(), dtype=np.uint8)], minlength=7)
        visible = max(1, kinds.sum() - kinds[3])
        mine = index[word_at[i] : word_at[i + 1]]
        symbol, bare, upper, short, count = flags[:, mine].sum(axis=1)
        words_here = max(1, count)
        distinct, times = np.unique(words[begins[i] : begins[i + 1]], return_counts=True)
        own_lines = line_code[line_at[i] : line_at[i + 1]]
        own_runs = runs[run_at[i] : run_at[i + 1]]
        out[i] = (
            np.log1p(count), length[mine].sum() / words_here, kinds[1] / visible, kinds[2] / visible, kinds[4] / visible,
            kinds[5] / visible, kinds[6] / visible, len(distinct) / words_here, times.max(initial=0) / words_here,
            symbol / words_here, bare / words_here, upper / words_here,
            short / words_here, np.log1p(count / max(1, len(own_lines))), 1 - len(np.unique(own_lines)) / max(1, len(own_lines)),
            1 - len(np.unique(own_runs)) / max(1, len(own_runs)),
        )
    return out


@dataclasses.dataclass
class Model:
    """Intercept, bin edges and a table for every feature, and tables for pairs of features over coarse bins."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], side="left")]
        bins = {f: np.searchsorted(self.coarse[f], x[:, f], side="left") for pair in self.pairs for f in pair[:2]}
        for a, b, values in self.pairs:
            total += values[bins[a], bins[b]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a row of bins; cells of (gradient, hessian) sums."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A step function over the bins with up to 2 ** depth steps."""
    gain, at = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1), shallow_tree(g[at:], h[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of a tree that splits the rows once and each part by its columns, or the other way round."""
    best = (0.0, np.full(g.shape, g.sum() / (h.sum() + 1.0)))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(gg)):
            gain, out = -float(_gain(g.sum(), h.sum())), np.empty(gg.shape)
            for part in (slice(0, at), slice(at, None)):
                cg, ch = gg[part].sum(axis=0), hh[part].sum(axis=0)
                cut, _ = _best_cut(cg, ch)
                gain += cut + float(_gain(cg.sum(), ch.sum()))
                out[part] = shallow_tree(cg, ch, 1)
            if gain > best[0]:
                best = (gain, out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, pairs: int = 5, rate: float = 0.15) -> Model:
    """Train on features and labels 0 or 1. Without both labels the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    coarse = [e[np.linspace(0, len(e) - 1, min(len(e), 9)).astype(int)] if len(e) else e for e in edges]
    model = Model(intercept, edges, [np.zeros(len(e) + 1) for e in edges], coarse, [])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
    total = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, values in enumerate(model.tables):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(bins[f], g, len(values)), np.bincount(bins[f], h, len(values)))
            values += step
            total += step[bins[f]]
    rough = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(coarse)]

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        flat = rough[a] * shape[1] + rough[b]
        return tuple(np.bincount(flat, s, shape[0] * shape[1]).reshape(shape) for s in slopes())

    ranked = sorted(((-pair_tree(*cells(a, b))[0], a, b) for a in range(len(FEATURES)) for b in range(a)))[:pairs]
    model.pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in ranked]
    for _ in range(pair_rounds):
        for a, b, values in model.pairs:
            step = rate * pair_tree(*cells(a, b))[1]
            values += step
            total += step[rough[a], rough[b]]
    return model


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learnt; the others are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 7) -> Model:
    """Fit the model to about `sample` labelled documents at most, chosen by a hash of doc_id.

    Of several labels of a document the majority counts, a tie as 1; null labels and ids are left out. The sample
    bounds what reaches the driver: `sample` rows of numbers. Texts of chosen documents are read whole.
    """
    ship(docs.sparkSession)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(learnable())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    rate = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        parts = [features(texts.slice(a, n)) for a, n in slices(texts, 2 << 20)]
        tidy()
        return pa.array(list(np.concatenate(parts)) if parts else [], pa.list_(pa.float64()))

    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "y", measure("text").alias("x")).groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    got = rows.toPandas().sort_values("doc_id")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["y"].to_numpy(dtype=float))


def with_score(docs: DataFrame, model: Model, text: Column) -> DataFrame:
    """`docs` with a column score for the whole `text`: 0 to 1, higher for better."""
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        parts = [model.scores(features(texts.slice(a, n))) for a, n in slices(texts, 2 << 20)]
        tidy()
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return docs.withColumn("score", rate(text))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on) of every row.

    Null and empty texts are scored as texts without words. Repeated rows have the same score. A null doc_id is
    not held out. Only the text enters a score. An empty table gives no rows.
    """
    rows = with_score(docs.select("doc_id", text_or_empty().alias("text")), model, F.col("text"))
    return rows.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` with a score of 0.5 or more, with all their columns.

    Null and empty texts are scored as texts without words, repeated rows and rows without doc_id each by itself. An
    empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"))
    return with_score(rows, model, F.coalesce(F.col("row.text"), F.lit(""))).where("score >= 0.5").select("row.*")
