"""What a level of a forest counts."""

import functools

import numpy as np
from pyspark.sql import functions as F

from shelflight.operators import trees as te


def test_forest_counts_only_rows_at_nodes_that_drew_a_column(spark, monkeypatch):
    """Every column that some node had drawn was counted over all rows."""
    counted = []
    df = spark.createDataFrame([(f"k{i}", f"c{i % 40}", *[float((i * p) % 97) for p in (3, 5, 7, 11, 13)], "ab"[(i * i) % 7 > 2]) for i in range(600)],
                               "k string, c string, x0 double, x1 double, x2 double, x3 double, x4 double, y string").repartition(3)
    codes = te.learn_codes(df, ["c"], [f"x{i}" for i in range(5)])
    inputs = [F.col("c"), *[F.col(f"x{i}") for i in range(5)]]
    parts = te._parts(df, codes, inputs, (F.col("y") == "b").cast("int"), F.col("k"), np.int64)

    class Here:
        """Parts counted in this process."""

        def __init__(self, found=None):
            self.found = found

        def mapPartitions(self, count):
            return Here([one for part in parts.collect() for one in count([part])])

        def treeReduce(self, add):
            return functools.reduce(add, self.found)

    monkeypatch.setattr(te.np, "bincount", lambda x, w, n, keep=np.bincount: counted.append(len(x)) or keep(x, w, n))
    here = te.grow_forest(Here(), codes, 2, 3, 6, 1)
    monkeypatch.undo()
    there = te.grow_forest(parts, codes, 2, 3, 6, 1)
    assert all((getattr(a, f) == getattr(b, f)).all() for a, b in zip(here, there, strict=True) for f in ("column", "code", "left", "value"))
    # A tree's level counts all its rows for the totals, then once for each column that some node drew.
    assert sum(length < max(counted) / 2 for length in counted) > 10
