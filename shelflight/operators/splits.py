"""Exact, repeatable train/test splits in hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelflight.session import written

TRAIN_PERCENT = 80
SEED = 42
# Hash bits that name the bucket: 65,536 of them.
_BUCKET_SHIFT = 48


def _first_reaching(counts: DataFrame, position: str) -> DataFrame:
    """Per class, the position at which the running count reaches what is wanted.

    `wanted` becomes what is still to be taken from that position.
    """
    up_to = Window.partitionBy("g").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("wanted") - F.col("reached") + F.col("n")
    return (
        counts.withColumn("reached", F.sum("n").over(up_to))
        .filter("reached >= wanted")
        .groupBy("g")
        .agg(F.min(position).alias(position), F.min_by(left, position).alias("wanted"))
    )


def split(df: DataFrame, key: str, label: str | None = None, seed: int = SEED) -> DataFrame:
    """Add `is_train`: the first 80 % of the rows, of each class if `label` is given.

    Rows are ordered by a hash of their key, so the split does not depend on
    partitioning. No class is ever sorted as a whole: hash buckets find where the
    80 % end, only the rows of that one bucket are ranked, and every row is then
    compared with the cut of its class. The cuts are one row per class. Classes
    and hashes are written once for the two passes over them; runs a job. `df`
    is read for that and again for the result, so it should be stored, or cheap.
    """
    group = F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit("")
    hashed = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed))
    rows = df.select(group.alias("g"), hashed.alias("h"))
    rows = written(rows.withColumn("b", F.shiftright("h", _BUCKET_SHIFT)), "split")
    buckets = rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.greatest(F.floor(F.sum("n").over(Window.partitionBy("g")) * TRAIN_PERCENT / 100), F.lit(1))
    edge = _first_reaching(buckets.withColumn("wanted", wanted), "b")
    in_edge = rows.join(edge, ["g", "b"]).groupBy("g", "h", "wanted").agg(F.count(F.lit(1)).alias("n"))
    cuts = _first_reaching(in_edge, "h").select(F.col("g").alias("_g"), F.col("h").alias("_cut"))
    return (
        df.withColumns({"_g": group, "_h": hashed})
        .join(cuts, "_g")
        .withColumn("is_train", F.col("_h") <= F.col("_cut"))
        .drop("_g", "_h", "_cut")
    )


def split_sizes(df: DataFrame, label: str | None = None) -> DataFrame:
    keys = [label, "is_train"] if label else ["is_train"]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
