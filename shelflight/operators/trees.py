"""Forests and boosted trees over categories and numbers: one histogram of arrays a task and level.

Every category is a one-hot feature and every number a feature of at most 32 bins. A row has one category a column, so
all features of a column come from one count over its codes, and a row costs one step a column and level instead of
one for each one-hot feature. Rows are held as codes, a byte or two a column.
"""

from __future__ import annotations

import base64
import io
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import StringIndexer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
BLOCK = 1 << 16  # rows coded at once
CHUNK = 1 << 20  # rows counted at once
TREES_AT_ONCE = 10  # trees of a forest that grow together
_STAY = 1 << 30  # no code is larger: rows stay at a leaf


@dataclass
class Codes:
    """How columns become codes: categories by their place, numbers by how many thresholds are below them."""

    categories: list[list[str]]
    thresholds: list[list[float]]

    @property
    def sizes(self) -> list[int]:
        """Codes per column; an unknown category has the last code of its column, which is no feature."""
        return [len(c) + 1 for c in self.categories] + [len(t) + 1 for t in self.thresholds]


@dataclass
class Tree:
    """Nodes as arrays. The right child follows the left one; a leaf is its own left child."""

    column: np.ndarray
    code: np.ndarray
    left: np.ndarray
    value: np.ndarray


def learn_codes(df: DataFrame, categories: Sequence[str], numbers: Sequence[str]) -> Codes:
    """Categories in alphabetical order and the quantiles of each number, from all rows."""
    found = StringIndexer(
        inputCols=list(categories), outputCols=[f"{c}_index" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc"
    ).fit(df.select(*categories)).labelsArray
    at = [i / BINS for i in range(1, BINS)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(f"q{i}") for i, c in enumerate(numbers)]).first()
    return Codes([list(f) for f in found], [sorted(set(q or [])) for q in row])


def _coder(codes: Codes) -> Callable:
    """A function from the columns, as pandas series, to a matrix of codes, one row a column. Nested: workers need no package."""
    known, thresholds, width = codes.categories, [np.array(t) for t in codes.thresholds], len(codes.categories)
    kind = np.uint8 if max(codes.sizes) <= 256 else np.uint16 if max(codes.sizes) <= 65_536 else np.uint32

    def code(columns):
        import pandas as pd

        out = np.empty((len(columns), len(columns[0])), kind)
        for i, column in enumerate(columns):
            if i < width:
                place = pd.Index(known[i]).get_indexer(column) if known[i] else np.full(len(column), -1)
                out[i] = np.where(place < 0, len(known[i]), place)
            else:
                number = column.to_numpy(dtype=float)
                if np.isnan(number).any():
                    raise ValueError("a number that the trees read is missing")
                out[i] = np.searchsorted(thresholds[i - width], number, side="left")
        return out

    return code


def _walker(categories: int) -> Callable:
    """A function that takes the rows from one node to its child."""

    def step(tree, codes, node, rows):
        column = tree[0][node]
        code, at = codes[column, rows], tree[1][node]
        right = np.where(column < categories, code == at, code > at)
        return tree[2][node] + right

    return step


def _parts(df: DataFrame, codes: Codes, inputs: Sequence[Column], label: Column, key: Column, kind: type) -> RDD:
    """(codes, label, hash of the row) in arrays, spread over the cores, kept in memory and on disk."""
    code, columns = _coder(codes), len(inputs)
    rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(inputs)], label.alias("y"), F.xxhash64(key.cast("string"), *inputs, label).alias("h"))

    def coded(batches):
        held, n = [], 0

        def joined():
            return {"x": [np.ascontiguousarray(np.concatenate([h[0] for h in held], axis=1)).tobytes()],
                    "y": [np.concatenate([h[1] for h in held]).tobytes()], "h": [np.concatenate([h[2] for h in held]).tobytes()]}

        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch.to_pandas()
            if table["y"].isna().any():
                raise ValueError("a label is missing")
            held.append((code([table.iloc[:, i] for i in range(columns)]), table["y"].to_numpy(dtype=kind), table["h"].to_numpy(dtype=np.int64)))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield pa.RecordBatch.from_pydict(joined(), schema=BINARY())
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pydict(joined(), schema=BINARY())

    def BINARY():
        import pyarrow as pa

        return pa.schema([(c, pa.binary()) for c in "xyh"])

    BLOCK_ROWS, CHUNK_ROWS = BLOCK, CHUNK
    dtype = code([_empty(i < len(codes.categories)) for i in range(columns)]).dtype

    def arrays(blocks):
        held, n = [], 0

        def joined():
            return tuple(np.concatenate([h[i] for h in held], axis=-1) for i in range(3))

        for block in blocks:
            held.append((np.frombuffer(block["x"], dtype).reshape(columns, -1), np.frombuffer(block["y"], kind), np.frombuffer(block["h"], np.int64)))
            n += len(held[-1][1])
            if n >= CHUNK_ROWS:
                yield joined()
                held, n = [], 0
        if held:
            yield joined()

    # Blocks are few and of like size. They are dealt by their number: `repartition` would move ten at a time.
    blocks = rows.mapInArrow(coded, "x binary, y binary, h binary").rdd.persist(StorageLevel.MEMORY_AND_DISK)
    tasks = max(1, min(blocks.count(), 2 * df.sparkSession.sparkContext.defaultParallelism))
    numbered = blocks.zipWithIndex().map(lambda pair: (pair[1], pair[0]))
    parts = numbered.partitionBy(tasks, int).values().mapPartitions(arrays).persist(StorageLevel.MEMORY_AND_DISK)
    parts.count()
    blocks.unpersist()
    return parts


def _empty(text: bool):
    import pandas as pd

    return pd.Series([], dtype=object if text else float)


class _Growing:
    """A tree that grows level by level: open nodes, and the nodes made so far."""

    def __init__(self, width: int) -> None:
        self.column, self.code, self.left, self.value = [0], [_STAY], [0], [np.zeros(width)]
        self.open = [0]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.column, np.int64), np.array(self.code, np.int64), np.array(self.left, np.int64)

    def done(self) -> Tree:
        return Tree(*self.arrays(), np.array(self.value))


def _cells(features: list[np.ndarray], sizes: Sequence[int], categories: int) -> tuple[np.ndarray, ...]:
    """Which cells of the histogram the chosen features of the open nodes need: node, column, code of each.

    `features` has, for each open node, the columns and codes of its features; a number counts once, with all its codes.
    """
    node = np.repeat(np.arange(len(features)), [len(f) for f in features])
    column, code = np.concatenate(features).T if len(node) else np.zeros((2, 0), np.int64)
    many = np.where(column < categories, 1, np.array(sizes)[column])
    at = np.repeat(np.arange(len(many)), many)
    within = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return node[at], column[at], np.where(column[at] < categories, code[at], within)


def _split(tree: _Growing, cells: tuple[np.ndarray, ...], sums: np.ndarray, totals: np.ndarray, categories: int, last: bool) -> None:
    """Split every open node where that lowers the impurity most (variance or Gini); its children are open next.

    `sums` has, for every cell, the number of rows and the sums whose squares over that number are to grow; `totals`
    the same for every open node. Children of the last level stay leaves.
    """
    node, column, code = cells
    open_nodes, tree.open = tree.open, []
    number = column >= categories
    # A category's rows go right; of a number, those above the code do.
    begin = np.ones(len(node), bool)
    begin[1:] = (node[1:] != node[:-1]) | (column[1:] != column[:-1]) | ~number[1:]
    upto = np.cumsum(sums, axis=0)
    base = np.maximum.accumulate(np.where(begin, np.arange(len(node)), 0)) if len(node) else np.zeros(0, np.int64)
    before = np.concatenate([np.zeros((1, sums.shape[1])), upto])[base]
    left = np.where(number[:, None], upto - before, totals[node] - sums)
    right = totals[node] - left

    def squares(stats: np.ndarray) -> np.ndarray:
        return (stats[:, 1:] ** 2).sum(axis=1) / np.maximum(stats[:, 0], 1)

    whole = squares(totals)
    gain = np.where((left[:, 0] > 0.5) & (right[:, 0] > 0.5), squares(left) + squares(right) - whole[node], -1.0)
    best = {}
    order = np.lexsort((np.arange(len(node)), -gain, node))
    if len(order):
        first = np.concatenate([[True], node[order][1:] != node[order][:-1]])
        best = {int(node[i]): int(i) for i in order[first]}
    for at, place in enumerate(open_nodes):
        tree.value[place] = totals[at]
        i = best.get(at)
        if i is None or gain[i] <= 1e-12 * whole[at]:
            continue
        tree.column[place], tree.code[place], tree.left[place] = int(column[i]), int(code[i]), len(tree.column)
        for stats in (left[i], right[i]):
            child = len(tree.column)
            tree.column.append(0), tree.code.append(_STAY), tree.left.append(child), tree.value.append(stats)
            if not last:
                tree.open.append(child)


def _one_hot(sizes: Sequence[int], categories: int) -> np.ndarray:
    """All features as (column, code): each known category, and each number with code -1."""
    pairs = [(i, c) for i in range(categories) for c in range(sizes[i] - 1)] + [(i, -1) for i in range(categories, len(sizes))]
    return np.array(pairs, np.int64).reshape(-1, 2)


def grow_forest(parts: RDD, codes: Codes, classes: int, trees: int, depth: int, seed: int) -> list[Tree]:
    """Trees over bootstrap copies of the rows, by Gini impurity, with the square root of the features at each node.

    A row's weight in a tree is Poisson of mean 1, drawn from a hash of the row, so it depends on no partitioning;
    counts are whole, so a forest is repeatable. A job a level and group of trees; what a task sends is the counts of the
    chosen features.
    """
    sizes, categories = codes.sizes, len(codes.categories)
    features = _one_hot(sizes, categories)
    wanted = min(len(features), math.ceil(math.sqrt(len(features))))
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    limits = (steps * 2.0**53).astype(np.int64)
    step = _walker(categories)
    done = []

    def weights(h, tree):
        # Mixed as in splitmix64.
        with np.errstate(over="ignore"):
            z = h.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return np.searchsorted(limits, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.int64), side="right")

    for first in range(0, trees, TREES_AT_ONCE):
        growing = {t: _Growing(classes + 1) for t in range(first, min(trees, first + TREES_AT_ONCE))}
        draws = {t: np.random.default_rng([seed, t]) for t in growing}
        for level in range(depth):
            going = {t: g for t, g in growing.items() if g.open}
            if not going:
                break
            chosen = {t: [features[np.sort(draws[t].choice(len(features), wanted, replace=False))] for _ in g.open] for t, g in going.items()}
            cells = {t: _cells(chosen[t], sizes, categories) for t in going}
            plan = [(t, g.arrays(), np.array(g.open), cells[t]) for t, g in going.items()]

            def count(blocks, plan=plan, level=level):
                found = [(np.zeros((len(c[0]), classes)), np.zeros((len(o), classes))) for _, _, o, c in plan]
                for x, y, h in blocks:
                    for (t, tree, opened, (node, column, code)), (sums, totals) in zip(plan, found, strict=True):
                        weight = weights(h, t)
                        rows = np.flatnonzero(weight)
                        at = np.zeros(len(rows), np.int64)
                        for _ in range(level):
                            at = step(tree, x, at, rows)
                        place = np.full(len(tree[0]), -1)
                        place[opened] = np.arange(len(opened))
                        at = place[at]
                        rows, at = rows[at >= 0], at[at >= 0]
                        weight, y_ = weight[rows].astype(float), y[rows]
                        n = len(opened)
                        totals += np.bincount(at * classes + y_, weight, n * classes).reshape(n, classes)
                        for i, size in enumerate(sizes):
                            mine = np.flatnonzero(column == i)
                            if len(mine):
                                # Most nodes have drawn few of the numbers: only rows at nodes that have are counted.
                                drawn = np.zeros(n, bool)
                                drawn[node[mine]] = True
                                some = slice(None) if 2 * drawn.sum() > n else np.flatnonzero(drawn[at])
                                cell = (at[some] * size + x[i][rows[some]]) * classes + y_[some]
                                all_codes = np.bincount(cell, weight[some], n * size * classes).reshape(n, size, classes)
                                sums[mine] += all_codes[node[mine], code[mine]]
                yield [(s.astype(np.int64), t.astype(np.int64)) for s, t in found]

            found = parts.mapPartitions(count).treeReduce(lambda a, b: [(s + u, t + v) for (s, t), (u, v) in zip(a, b, strict=True)])
            for (t, g), (sums, totals) in zip(going.items(), found, strict=True):
                sums, totals = (np.column_stack([s.sum(axis=1), s]).astype(float) for s in (sums, totals))
                _split(g, cells[t], sums, totals, categories, level == depth - 1)
        done += [g.done() for g in growing.values()]
    for tree in done:  # shares of the classes
        tree.value = tree.value[:, 1:] / np.maximum(tree.value[:, :1], 1)
    return done


def grow_boosted(parts: RDD, codes: Codes, rounds: int, rate: float, depth: int) -> list[Tree]:
    """Trees by variance, the first of the label, each further one of twice what is left, added at `rate`. A job a level.

    What is left of every row is kept beside its codes and renewed once a round.
    """
    sizes, categories = codes.sizes, len(codes.categories)
    every = _one_hot(sizes, categories)
    step = _walker(categories)
    state, done = parts.map(lambda p: (p[0], p[1])), []
    kept = []
    for number in range(rounds):
        growing = _Growing(2)
        for level in range(depth):
            if not growing.open:
                break
            cells = _cells([every] * len(growing.open), sizes, categories)
            tree, opened = growing.arrays(), np.array(growing.open)

            def count(blocks, tree=tree, opened=opened, level=level):
                n = len(opened)
                found = [np.zeros((2, n * size)) for size in sizes]
                for x, target in blocks:
                    rows, at = np.arange(len(target)), np.zeros(len(target), np.int64)
                    for _ in range(level):
                        at = step(tree, x, at, rows)
                    place = np.full(len(tree[0]), -1)
                    place[opened] = np.arange(n)
                    at = place[at]
                    if (at < 0).any():
                        rows = np.flatnonzero(at >= 0)
                        at, x, target = at[rows], x[:, rows], target[rows]
                    for i, size in enumerate(sizes):
                        cell = at * size + x[i]
                        found[i][0] += np.bincount(cell, minlength=n * size)
                        found[i][1] += np.bincount(cell, target, n * size)
                yield found

            found = parts.context.runJob(state, count)
            by_column = [sum(one[i] for one in found).reshape(2, len(opened), -1) for i in range(len(sizes))]
            node, column, code = cells
            sums = np.zeros((len(node), 2))
            for i in range(len(sizes)):
                mine = column == i
                sums[mine] = by_column[i][:, node[mine], code[mine]].T
            totals = by_column[0].sum(axis=2).T
            _split(growing, cells, sums, totals, categories, level == depth - 1)
        tree = growing.done()
        tree.value = (tree.value[:, 1] / np.maximum(tree.value[:, 0], 1) * (rate if number else 1.0))[:, None]
        done.append(tree)
        if number == rounds - 1:
            break

        def renew(part, tree=(tree.column, tree.code, tree.left), value=tree.value[:, 0], first=not number):
            x, target = part
            rows, at = np.arange(len(target)), np.zeros(len(target), np.int64)
            for _ in range(depth):
                at = step(tree, x, at, rows)
            return x, (2 * target if first else target) - 2 * value[at]

        state = state.map(renew, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(state)
        if len(kept) > 2:
            kept.pop(0).unpersist()
    for one in kept:
        one.unpersist()
    return done


class TreeEnsemble(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the sum of the trees' values, or, with `labels`, the label of the largest sum.

    `categories` and `numbers` name the columns; `trees` holds codes and nodes as text. Unknown categories are none of
    the known ones; a missing number is an error.
    """

    categories = Param(Params._dummy(), "categories", "columns of categories", TypeConverters.toListString)
    numbers = Param(Params._dummy(), "numbers", "columns of numbers", TypeConverters.toListString)
    labels = Param(Params._dummy(), "labels", "names of the classes; none for a number", TypeConverters.toListString)
    prediction = Param(Params._dummy(), "prediction", "column that is added", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "codes and nodes", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, categories=None, numbers=None, labels=None, prediction=None, trees=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        codes, trees = unpacked(get("trees"))
        labels, code, step = np.array(get("labels"), object), _coder(codes), _walker(len(codes.categories))
        nodes = [((t.column, t.code, t.left), t.value) for t in trees]
        steps = [_depth(t) for t in trees]

        def predict(batches):
            import pandas as pd

            for columns in batches:
                x = code(columns)
                rows, total = np.arange(x.shape[1]), 0.0
                for (tree, value), deep in zip(nodes, steps, strict=True):
                    at = np.zeros(len(rows), np.int64)
                    for _ in range(deep):
                        at = step(tree, x, at, rows)
                    total = total + value[at]
                yield pd.Series(labels[total.argmax(axis=1)] if len(labels) else total[:, 0])

        # The types by name: annotations of several columns are not told apart here.
        predict = F.pandas_udf(predict, "string" if len(labels) else "double", F.PandasUDFType.SCALAR_ITER)
        inputs = [F.col(f"`{c}`").cast("string") for c in get("categories")] + [F.col(f"`{c}`").cast("double") for c in get("numbers")]
        return df.withColumn(get("prediction"), predict(*inputs))


def _depth(tree: Tree) -> int:
    level = np.zeros(len(tree.left), np.int64)
    for i, left in enumerate(tree.left.tolist()):  # children come after their parent
        if left != i:
            level[left : left + 2] = level[i] + 1
    return int(level.max())


def packed(codes: Codes, trees: list[Tree]) -> str:
    """Codes and trees as text."""
    out = io.BytesIO()
    texts = [np.array([c.encode() for c in known], object) for known in codes.categories]
    arrays = {f"c{i}": np.frombuffer(b"".join(t), np.uint8) for i, t in enumerate(texts)}
    arrays |= {f"n{i}": np.array([len(c) for c in t], np.int64) for i, t in enumerate(texts)}
    arrays |= {f"t{i}": np.array(t, float) for i, t in enumerate(codes.thresholds)}
    arrays |= {name: np.concatenate([getattr(t, name) for t in trees]) for name in ("column", "code", "left", "value")}
    np.savez_compressed(out, sizes=[len(t.left) for t in trees], columns=[len(texts), len(codes.thresholds)], **arrays)
    return base64.b64encode(out.getvalue()).decode()


def unpacked(text: str) -> tuple[Codes, list[Tree]]:
    held = np.load(io.BytesIO(base64.b64decode(text)))
    categories, numbers = held["columns"].tolist()
    known = []
    for i in range(categories):
        spelt, ends = held[f"c{i}"].tobytes(), np.cumsum(held[f"n{i}"]).tolist()
        known.append([spelt[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)])
    codes = Codes(known, [held[f"t{i}"].tolist() for i in range(numbers)])
    cuts = np.cumsum(held["sizes"])[:-1]
    nodes = [np.split(held[name], cuts) for name in ("column", "code", "left", "value")]
    return codes, [Tree(*parts) for parts in zip(*nodes, strict=True)]


def fit_forest(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], label: str, key: str, prediction: str, trees: int, depth: int, seed: int) -> TreeEnsemble:
    """A random forest that answers with the class name. Rows without a label are refused. Runs jobs."""
    codes = learn_codes(df, categories, numbers)
    labels = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="error").fit(df.select(label))
    indexed = labels.transform(df)
    inputs = [F.col(c).cast("string") for c in categories] + [F.col(c).cast("double") for c in numbers]
    parts = _parts(indexed, codes, inputs, F.col("label_index").cast("int"), F.col(key), np.int64)
    try:
        grown = grow_forest(parts, codes, len(labels.labels), trees, depth, seed)
    finally:
        parts.unpersist()
    return TreeEnsemble(categories=list(categories), numbers=list(numbers), labels=list(labels.labels), prediction=prediction, trees=packed(codes, grown))


def fit_boosted(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], label: str, key: str, prediction: str, rounds: int, rate: float, depth: int) -> TreeEnsemble:
    """Gradient-boosted trees for squared errors. Runs jobs."""
    codes = learn_codes(df, categories, numbers)
    inputs = [F.col(c).cast("string") for c in categories] + [F.col(c).cast("double") for c in numbers]
    parts = _parts(df, codes, inputs, F.col(label).cast("double"), F.col(key), np.float64)
    try:
        grown = grow_boosted(parts, codes, rounds, rate, depth)
    finally:
        parts.unpersist()
    return TreeEnsemble(categories=list(categories), numbers=list(numbers), labels=[], prediction=prediction, trees=packed(codes, grown))
