"""K-means from many starts at once, and names for its segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Points, chosen by a hash of their values, from which the first centres are drawn.
FIRST_POINTS = 5_000

# Names of four segments, by value (high, low) and by velocity (fast, slow).
SEGMENT_NAMES = (("Fast Moving High Value", "Slow Moving High Value"), ("Fast Moving Low Value", "Dead Stock"))


def first_centres(points: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """Centres among the points, each drawn by its squared distance to those before."""
    centres = [points[draw.integers(len(points))]]
    for _ in range(1, k):
        far = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0)
        at = draw.choice(len(points), p=far / far.sum()) if far.sum() > 0 else draw.integers(len(points))
        centres.append(points[at])
    return np.array(centres)


def _round(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """Per start and centre: number of the rows nearest to it, their cost and sums. One shuffled row a task, start and centre.

    The rows of a batch meet all centres of all starts at once. The function is nested, so workers need no package.
    """
    names = points.columns

    def assign(batches):
        import pyarrow as pa

        starts, k, width = centres.shape
        flat = centres.reshape(starts * k, width)
        found = np.zeros((starts, k, 2 + width))
        for batch in batches:
            rows = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns]).astype(float)
            rows = rows[np.isfinite(rows).all(axis=1)]
            off = np.zeros((len(rows), starts * k))
            for i in range(width):
                off += (rows[:, i, None] - flat[None, :, i]) ** 2
            off = off.reshape(len(rows), starts, k)
            place = off.argmin(axis=2)
            least = off.min(axis=2)
            for s in range(starts):
                weights = [None, least[:, s], *rows.T]
                found[s] += np.column_stack([np.bincount(place[:, s], weights=w, minlength=k) for w in weights])
        at = np.indices((starts, k)).reshape(2, -1)
        cells = found.reshape(starts * k, -1)
        columns = [at[0].astype("int32"), at[1].astype("int32"), cells[:, 0].astype("int64"), *cells[:, 1:].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["start", "centre", "n", "cost", *names])

    kinds = ", ".join(f"`{name}` double" for name in names)
    parts = points.mapInArrow(assign, f"start int, centre int, n bigint, cost double, {kinds}").filter("n > 0")
    return parts.groupBy("start", "centre").agg(*[F.sum(f"`{c}`").alias(c) for c in ("n", "cost", *names)])


def fit_centres(points: DataFrame, k: int, starts: int, rounds: int = 20, tolerance: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, float]:
    """The centres of least cost of several starts, and that cost. Runs a job per round, for all starts together.

    A round is one aggregate: every row is assigned once for each start, in arrays of a batch of rows, and sums per
    start and centre are made inside the tasks; what reaches the driver is starts * k rows. A start stops when no centre
    moves by more than `tolerance`. Only the first centres come from a sample, of FIRST_POINTS rows. Rows without a
    finite number in every column are near to nothing. `points` is read once a round, so it should be kept.
    """
    names = points.columns
    points = points.select(*[F.col(name).cast("double").alias(name) for name in names])
    some = points.distinct().orderBy(F.xxhash64(*names), *names).limit(FIRST_POINTS).toPandas().to_numpy(dtype=float)
    some = some[np.isfinite(some).all(axis=1)]
    if not len(some):
        return np.zeros((k, len(names))), 0.0
    centres = np.array([first_centres(some, k, np.random.default_rng(seed + s)) for s in range(starts)])
    moving, cost = set(range(starts)), [float("inf")] * starts
    for number in range(rounds + 1):
        going = sorted(moving)
        found = _round(points, centres[going]).collect()
        for at, s in enumerate(going):
            mine = [row for row in found if row["start"] == at]
            cost[s] = sum(row["cost"] for row in mine)
            after = centres[s].copy()
            for row in mine:
                after[row["centre"]] = [row[name] / row["n"] for name in names]
            still = np.sqrt(((after - centres[s]) ** 2).sum(axis=1)).max() <= tolerance
            if still or number == rounds:
                moving.discard(s)  # the cost is that of these centres
            else:
                centres[s] = after
        if not moving:
            break
    best = min(range(starts), key=lambda s: (cost[s], s))
    return centres[best], cost[best]


def assigning(columns: Sequence[str], means: Sequence[float], deviations: Sequence[float], centres: np.ndarray, prediction: str) -> SQLTransformer:
    """The nearest centre, in scaled columns, as a pipeline stage: one expression."""

    def scaled(name: str, mean: float, deviation: float) -> str:
        return f"((CAST(`{name}` AS DOUBLE) - {float(mean)!r}D) * {1 / float(deviation) if deviation else 0.0!r}D)"

    def distance(centre: np.ndarray) -> str:
        offs = [f"({scaled(*column)} - {float(at)!r}D)" for column, at in zip(zip(columns, means, deviations, strict=True), centre, strict=True)]
        return " + ".join(f"{off} * {off}" for off in offs)

    distances = ", ".join(map(distance, centres))
    place = f"CAST(array_position(array({distances}), array_min(array({distances}))) - 1 AS INT)"
    return SQLTransformer(statement=f"SELECT *, {place} AS `{prediction}` FROM __THIS__")


def segment_names(assigned: DataFrame, value: str = "Inventory_Value", velocity: str = "Sales_Velocity", segment: str = "Predicted_Cluster") -> DataFrame:
    """One row per segment: its mean value and velocity, and its name.

    Of four segments the two of larger mean value are of high value; in each half the faster one moves fast. With
    fewer segments the names that come first are taken.
    """
    means = assigned.groupBy(segment).agg(F.avg(value).alias("mean_value"), F.avg(velocity).alias("mean_velocity"), F.count(F.lit(1)).alias("row_count"))
    # As many rows as segments, so one array of them.
    every = F.array_sort(F.collect_list(F.struct((-F.col("mean_value")).alias("order"), segment, "mean_value", "mean_velocity", "row_count")))
    ranked = means.agg(every.alias("all")).select(F.posexplode("all").alias("at", "one")).select((F.col("at") >= 2).cast("int").alias("half"), "one.*").drop("order")
    halves = F.array_sort(F.collect_list(F.struct((-F.col("mean_velocity")).alias("order"), segment, "mean_value", "mean_velocity", "row_count")))
    placed = ranked.groupBy("half").agg(halves.alias("all")).select("half", F.posexplode("all").alias("at", "one")).select("half", "at", "one.*").drop("order")
    name = F.array(*[F.array(*[F.lit(n) for n in pair]) for pair in SEGMENT_NAMES])
    return placed.select(segment, "mean_value", "mean_velocity", "row_count", F.get(F.get(name, F.col("half")), F.col("at")).alias("Segment_Name"))
