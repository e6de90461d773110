"""Exact cosine links between vectors by dual traversal of cover trees.

Equal vectors are one point. Points are dealt to cells around pivots, large cells to parts, and each part builds a
cover tree: levels of centres whose radii halve, every centre staying one on all finer levels. Two parts meet in
one task, which walks both trees level by level. A pair of nodes is dropped when their centres are farther apart
than both covering radii and the link distance, taken whole when all of its pairs must be links, else opened.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.shared import Runs, components, discard, ship, stored

SLACK = 1e-5  # more than single precision can err; only widens what is looked at
POINT = "cell bigint, part bigint, point bigint, times bigint, vector array<double>, path array<int>"


def unit(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors, one row each; all rows have one length."""
    flat = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Points of the sample, each the farthest from those before."""
    if not len(sample):
        return sample
    chosen, nearest = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        if nearest.max() <= 0:
            break
        chosen.append(int(np.argmax(nearest)))
    return sample[chosen]


def levels(reach: float) -> list[float]:
    """Halving radii from 1 (a root holds the whole unit sphere) down to a quarter of the link distance."""
    out = [1.0]
    while out[-1] > reach / 4:
        out.append(out[-1] / 2)
    return out


def cover_paths(x: np.ndarray, radii: list[float]) -> np.ndarray:
    """For every point the row of its centre on each level.

    On a level each node of the one above is split: its centre comes first, then the first point that is not
    within the radius of a centre yet, until all are covered.
    """
    paths = np.zeros((len(x), len(radii)), dtype=np.int32)
    owner = np.zeros(len(x), dtype=np.int64)
    for level, radius in enumerate(radii):
        fresh = np.empty(len(x), dtype=np.int64)
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        for node in np.split(order, cuts):
            centre = int(owner[node[0]])
            if len(node) == 1:
                fresh[node] = centre
                continue
            node = np.concatenate([[centre], node[node != centre]])
            near = (x[node].astype(np.float32) @ x[node].astype(np.float32).T) >= 1 - radius * radius / 2
            open_ = np.ones(len(node), dtype=bool)
            for i in range(len(node)):
                if open_[i]:
                    mine = near[i] & open_
                    mine[i] = True
                    fresh[node[mine]] = node[i]
                    open_ &= ~mine
        owner = fresh
        paths[:, level] = owner
    return paths


class Tree:
    """Nodes of one part by level: centres, covering radii, members."""

    def __init__(self, x: np.ndarray, paths: np.ndarray) -> None:
        self.x, self.levels = x, []
        above = np.zeros(len(x), dtype=np.int64)
        for level in range(paths.shape[1]):
            centres, node = np.unique(paths[:, level], return_inverse=True)
            far = np.linalg.norm(x - x[paths[:, level]], axis=1)
            radius = np.zeros(len(centres))
            np.maximum.at(radius, node, far)
            order = np.argsort(node, kind="stable")
            begins = np.searchsorted(node[order], np.arange(len(centres) + 1))
            self.levels.append((centres, radius, above[centres], order, begins))
            above = node


def walk(one: Tree, two: Tree, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Members of both trees, (many, many, True) where every pair is a link, or pairs (i, j, False) of single links."""
    reach = float(np.sqrt(2 - 2 * least))
    open_ = None
    for level, ((ca, ra, pa_, oa, ba), (cb, rb, pb, ob, bb)) in enumerate(zip(one.levels, two.levels, strict=True)):
        xa, xb = one.x[ca].astype(np.float32), two.x[cb].astype(np.float32)
        still = np.zeros((len(ca), len(cb)), dtype=bool)
        for first in range(0, len(ca), 1024):
            part = slice(first, first + 1024)
            dots = xa[part] @ xb.T
            wide = ra[part].astype(np.float32)[:, None] + (rb + reach + SLACK).astype(np.float32)[None, :]
            near = 2 * dots + wide * wide >= 2 - SLACK
            if open_ is not None:
                near &= open_[pa_[part]][:, pb]
            i, j = np.nonzero(near)
            room = reach - SLACK - ra[i + first] - rb[j]
            whole = (room > 0) & (2 - 2 * dots[i, j] <= room * room - SLACK)
            near[i[whole], j[whole]] = False
            still[part] = near
            for a, b in zip((i[whole] + first).tolist(), j[whole].tolist(), strict=True):
                yield oa[ba[a] : ba[a + 1]], ob[bb[b] : bb[b + 1]], True
        open_ = still
        if not still.any():
            return
    # What is open at the last level is compared point by point; most nodes there hold one.
    i, j = np.nonzero(open_)
    single = (np.diff(ba)[i] == 1) & (np.diff(bb)[j] == 1)
    p, q = oa[ba[i[single]]], ob[bb[j[single]]]
    linked = np.einsum("nd,nd->n", one.x[p], two.x[q]) >= least
    if linked.any():
        yield p[linked], q[linked], False
    for a, b in zip(i[~single].tolist(), j[~single].tolist(), strict=True):
        ma, mb = oa[ba[a] : ba[a + 1]], ob[bb[b] : bb[b + 1]]
        p, q = np.nonzero(one.x[ma] @ two.x[mb].T >= least)
        if len(p):
            yield ma[p], mb[q], False


def meet(one: Tree, two: Tree, times: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of both trees together, and the first row that links of this meeting reach.

    If `two` is `one`, a row's link to itself is not counted.
    """
    shift = 0 if two is one else len(one.x)
    weight = times[0] if two is one else np.concatenate(times)
    links, root = np.zeros(len(weight), dtype=np.int64), np.arange(len(weight))

    def unite(rows: np.ndarray) -> None:
        roots = np.unique(root[rows])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]

    for a, b, all_ in walk(one, two, least):
        b = b + shift
        if all_:
            links[a] += weight[b].sum()
            if shift:
                links[b] += weight[a].sum()
            unite(np.concatenate([a, b]))
        else:
            np.add.at(links, a, weight[b])
            if shift:
                np.add.at(links, b, weight[a])
            for i in np.unique(a):
                unite(np.concatenate([[i], b[a == i]]))
    return links - (0 if shift else weight), root


def near_duplicates(vectors: DataFrame, least: float = 0.95, part_points: int = 4096, most_pivots: int = 1024) -> DataFrame:
    """One row per vector of (vec_id, embedding): its links and the group that chains of links connect.

    Two vectors are linked if their cosine in double precision is `least` or more. Returns vec_id, n_links (long,
    other rows linked directly), component_id (smallest vec_id that links reach) and kept (vec_id = component_id).
    Null, empty and zero vectors, vectors with a null, NaN or infinite component and rows without vec_id link with
    nothing; vectors of different lengths do not link. Rows that repeat a vec_id count each. An empty table gives
    no rows. Other columns are not looked at.

    Equal vectors are grouped by a digest of their components before anything else, so a vector that a third of the
    rows share is one point. Links never become rows: a meeting of two parts returns counts and a spanning forest.
    """
    spark = vectors.sparkSession
    ship(spark)
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    fit = F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    key = F.when(F.coalesce(fit, F.lit(False)), F.sha2(F.col("embedding").cast("string"), 256))
    keyed = stored(rows.select("vec_id", key.alias("key")), "vector-keys")
    points = rows.withColumn("key", key).where("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("point"), F.count("*").alias("times"), F.min_by("embedding", "vec_id").alias("vector")
    )
    points = stored(points.select("key", "point", "times", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("length")), "points")
    forests = []
    for length, number in points.groupBy("length").count().orderBy("length").collect():  # a row per vector length
        forests.append(_forest(points.where(F.col("length") == length), number, least, part_points, most_pivots))
    found = None
    for forest in forests:
        found = forest if found is None else found.unionByName(forest)
    if found is None:
        found = spark.createDataFrame([], "point bigint, links bigint, root bigint")
    links = found.groupBy("point").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("point").alias("a"), F.col("root").alias("b")))
    summary = (
        points.select("key", "point", "times").join(links, "point", "left")
        .join(groups.select(F.col("id").alias("point"), "component"), "point", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "point").alias("component"))
    )
    return keyed.join(stored(summary, "vector-groups"), "key", "left").select(
        "vec_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )


def _forest(points: DataFrame, number: int, least: float, part_points: int, most_pivots: int) -> DataFrame:
    """point, links, root from all meetings of parts; points have one length."""
    spark, reach = points.sparkSession, float(np.sqrt(2 - 2 * least))
    radii = levels(reach)
    # The pivots come from a bounded sample of points in order of their digests; any choice gives the same links.
    sample = points.orderBy("key").limit(2 * most_pivots).select("vector").toArrow()
    pivots = pivots_of(unit(sample["vector"]), min(most_pivots, -(-number // part_points)))
    held = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = np.sqrt(np.maximum(0, 2 - 2 * unit(batch.column("vector")) @ held.value.T))
                cell = gap.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(gap[np.arange(len(cell)), cell]), *(batch.column(c) for c in ("point", "times", "vector"))],
                    names=["cell", "gap", "point", "times", "vector"],
                )

    placed = points.select("point", "times", "vector").mapInArrow(place, "cell bigint, gap double, point bigint, times bigint, vector array<double>")
    placed = stored(placed, "placed-points")
    cells = {c: (n, far) for c, n, far in placed.groupBy("cell").agg(F.count("*"), F.max("gap")).collect()}  # a row per pivot
    parts = np.array([-(-cells.get(c, (0, 0.0))[0] // part_points) for c in range(len(pivots))])
    far = np.array([cells.get(c, (0, 0.0))[1] for c in range(len(pivots))])
    share = F.element_at(F.array(*[F.lit(int(max(1, p))) for p in parts]), (F.col("cell") + 1).cast("int"))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("point"), share)).select("cell", "part", "point", "times", "vector")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("point")
        paths = cover_paths(unit(table["vector"]), radii)
        return table.append_column("path", pa.array(list(paths), pa.list_(pa.int32())))

    trees = stored(dealt.groupBy("cell", "part").applyInArrow(build, POINT), "cover-trees")
    first = np.concatenate([[0], np.cumsum(parts)])  # the number of a part: parts before its cell, and its own

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gap = np.sqrt(np.maximum(0, 2 - 2 * unit(batch.column("vector")) @ held.value.T))
            mine = first[batch.column("cell").to_numpy()] + batch.column("part").to_numpy()
            row, cell = np.nonzero(gap <= far[None, :] + reach + SLACK)
            times = parts[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            other = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
            for at in range(0, len(row), 20_000):
                cut = slice(at, at + 20_000)
                block = batch.take(pa.array(row[cut]))
                low, high = np.minimum(mine[row[cut]], other[cut]), np.maximum(mine[row[cut]], other[cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low), pa.array(high), pa.array(mine[row[cut]]), *(block.column(c) for c in ("point", "times", "vector", "path"))],
                    names=["low", "high", "own", "point", "times", "vector", "path"],
                )

    sent = trees.mapInArrow(send, "low bigint, high bigint, own bigint, point bigint, times bigint, vector array<double>, path array<int>")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in Runs(batches, ("low", "high")):
            low, high = run["low"][0].as_py(), run["high"][0].as_py()
            trees, points, times = [], [], []
            for part in sorted({low, high}):
                side = run.filter(pa.compute.equal(run["own"], part)).sort_by("point")
                x = unit(side["vector"]) if side.num_rows else np.zeros((0, 1))
                trees.append(_local_tree(x, side))
                points.append(side["point"].to_numpy())
                times.append(side["times"].to_numpy())
            if not all(len(p) for p in points):
                continue
            links, root = meet(trees[0], trees[-1], (times[0], times[-1]), least)
            ids = np.concatenate(points)
            some = np.flatnonzero(links > 0)
            lowest = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(lowest, root, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(lowest[root[some]])], names=["point", "links", "root"])

    met = sent.repartition(tasks, "low", "high").sortWithinPartitions("low", "high")
    found = stored(met.mapInArrow(link, "point bigint, links bigint, root bigint"), "vector-links")
    discard(placed, trees)
    return found


def _local_tree(x: np.ndarray, side: pa.Table) -> Tree:
    """The tree over the rows that came: a part may send only some, so centres that stayed away are replaced."""
    if not side.num_rows:
        return Tree(x, np.zeros((0, 1), dtype=np.int64))
    width = len(side["path"][0])
    paths = side["path"].combine_chunks().flatten().to_numpy().reshape(-1, width).astype(np.int64)
    out = np.empty_like(paths)
    for level in range(width):
        _, first, node = np.unique(paths[:, level], return_index=True, return_inverse=True)
        out[:, level] = first[node]
    return Tree(x, out)
