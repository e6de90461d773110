"""Algorithms that read the rows once: class boundaries, correlations, least squares; and publishing at once."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from shelflight.functions import exact_mean, exact_sum
from shelflight.operators import analytics as an
from shelflight.operators import pareto
from shelflight.operators.least_squares import fit_line
from shelflight.sources.publish import drop_generations, publish, read_published
from test_pareto import CASES, _expected


def _classes(df, **more):
    return {r.k: r.ABC_Category for r in pareto.abc_class(df, "v", "k", "C", **more).collect()}


@pytest.mark.parametrize("few", [1, 3])
def test_large_groups_are_narrowed_by_digits_and_hashes(spark, monkeypatch, few):
    """With a tiny bound on the rows read in order, every way of narrowing runs."""
    monkeypatch.setattr(pareto, "_FEW", few)
    monkeypatch.setattr(pareto, "_DIGITS", 1)
    monkeypatch.setattr(pareto, "_MORE", 2)
    monkeypatch.setattr(pareto, "_HASH_DIGITS", 1)
    draw = random.Random(few)
    mixed = [(f"k{i}", 250.0 if i % 3 == 0 else round(draw.lognormvariate(5, 2), 4)) for i in range(200)]
    for values in (CASES["all tied"], CASES["negative tail"], CASES["large and small"], mixed):
        assert _classes(spark.createDataFrame(values, "k string, v double").repartition(3)) == _expected(values, "C")


def test_boundaries_of_several_tables_at_once(spark):
    one, two = CASES["tied across the edge"], CASES["all negative"]
    tables = {name: spark.createDataFrame(rows, "k string, v double") for name, rows in (("a", one), ("b", two), ("none", [("x", 0.0)]))}
    found = pareto.find_boundaries({name: (df, "v") for name, df in tables.items()}, "k")
    for name, rows in (("a", one), ("b", two)):
        assert _classes(tables[name], boundaries=found[name]) == _expected(rows, "C")
    assert _classes(tables["none"], boundaries=found["none"]) == {"x": "C"}


def test_amounts_beyond_the_units(spark):
    rows = [("a", 4e25), ("b", 4e25), ("c", 1.5e25), ("d", 5e24), ("e", 12.5), ("f", None), ("g", float("nan")), ("h", -3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert {k: c for k, c in _classes(df).items() if k not in "fg"} == {"a": "A", "b": "A", "c": "B", "d": "C", "e": "C", "h": "C"}
    total, mean, small = df.agg(exact_sum(F.col("v")), exact_mean(F.col("v")), exact_sum(F.when(F.col("v") < 1e20, F.col("v")))).first()
    assert math.isclose(total, 1e26, rel_tol=1e-12) and math.isclose(mean, 1e26 / 6, rel_tol=1e-9) and small == 9.5
    shares = {r["k"]: r["Running_Share"] for r in pareto.running_share(df, "v", "k").collect()}
    assert math.isclose(shares["c"], 0.95, rel_tol=1e-9) and shares["f"] is None and shares["g"] is None and shares["h"] == 1.0


def test_sums_have_room_for_many_equal_values(spark):
    """Counts are never multiplied in narrow decimals: sums of 28 digits widen to 38."""
    df = spark.range(10).select(F.col("id").cast("string").alias("k"), F.lit(0.0).alias("v"))
    rows = df.select(pareto.to_units(F.col("v")).alias("u"), "k")
    for plan in (pareto._boundaries(rows), pareto.running_share(df, "v", "k")):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"cast\((n|count|_ties|row_number)\S* as decimal", text)


def test_running_share_moves_the_rows_twice(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    plan = pareto.running_share(df, "v", "k")._jdf.queryExecution().executedPlan().toString()
    # The range shuffle is behind the written table; here are the shuffle by range, and those of the sums, a row per range.
    assert plan.count("REPARTITION_BY_NUM") <= 2 and "rangepartitioning" not in plan


@pytest.mark.parametrize("pairs", [256, 4])
def test_correlations_in_one_row_or_in_blocks(spark, monkeypatch, pairs):
    monkeypatch.setattr(an, "_PAIRS", pairs)
    draw = np.random.default_rng(3)
    table = draw.normal(1e8, 1, (300, 4))
    table[:, 1] += 2 * table[:, 0]
    table[draw.random(table.shape) < 0.2] = np.nan
    rows = [(*map(float, r), 5.0, None) for r in table]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(3)
    got = {(r.a, r.b): r.corr for r in an.correlations(df, list("abcdef")).collect()}
    assert len(got) == 36 and all(got[x, y] == got[y, x] for x, y in got)
    for i, x in enumerate("abcd"):
        for j, y in enumerate("abcd"):
            both = ~np.isnan(table[:, i]) & ~np.isnan(table[:, j])
            assert math.isclose(got[x, y], np.corrcoef(table[both, i], table[both, j])[0, 1], abs_tol=1e-7)
    assert all(got[x, y] is None for x, y in got if x in "ef" or y in "ef")
    empty = an.correlations(df.limit(0), list("abcdef")).collect()
    assert len(empty) == 36 and all(r.corr is None for r in empty)


def test_least_squares_of_any_rank(spark, tmp_path):
    draw = np.random.default_rng(8)
    x = draw.normal(1000, 1, (200, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 7 + draw.normal(0, 0.1, 200)
    rows = [(float(a), float(b), float(a) * 30, 4.0, float(c)) for (a, b), c in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 4.0, 1.0), (1.0, float("nan"), 1.0, 4.0, 1.0)], "a double, b double, a30 double, four double, y double")
    line = fit_line(df, ["a", "b", "a30", "four"], "y")
    plain = np.linalg.lstsq(np.column_stack([x, np.ones(200)]), y, rcond=None)[0]
    assert line.rank == 2 and line.coefficients["four"] == 0
    # The two proportional columns share the weight, equally where both have variance one.
    assert math.isclose(line.coefficients["a"] * 2, plain[0], rel_tol=1e-6) and math.isclose(line.coefficients["a30"] * 60, plain[0], rel_tol=1e-6)
    assert math.isclose(line.coefficients["b"], plain[1], rel_tol=1e-6)
    model = PipelineModel(stages=[line.stage("p")])
    model.write().save(str(tmp_path / "line"))
    loaded = PipelineModel.load(str(tmp_path / "line")).transform(df.dropna()).where("NOT isnan(b)").collect()
    fitted = np.column_stack([x, np.ones(200)]) @ plain
    assert np.allclose([r["p"] for r in loaded], fitted, atol=1e-4)
    none = fit_line(df.limit(0), ["a", "b"], "y")
    assert none.rank == 0 and none.intercept == 0 and set(none.coefficients.values()) == {0.0}


@pytest.mark.parametrize("kind", ["folder", "database"])
def test_publication_is_whole_or_not_at_all(spark, tmp_path, kind):
    sink = f"{tmp_path}/out/" if kind == "folder" else "whole_or_not"
    if kind == "database":
        spark.sql("CREATE DATABASE whole_or_not")
    with pytest.raises(FileNotFoundError):
        read_published(spark, sink)

    def tables(n):
        return {name: spark.range(n).withColumn("of", F.lit(name)) for name in ("inventory", "predictions", "revenue", "recommendations")}

    publish(tables(3), sink)
    broken = {**tables(5), "revenue": spark.range(5).select(F.raise_error(F.lit("third write")).alias("id"))}
    with pytest.raises(PySparkException):
        publish(broken, sink)
    assert {name: df.count() for name, df in read_published(spark, sink).items()} == dict.fromkeys(tables(1), 3)
    publish(tables(7), sink)
    assert {df.count() for df in read_published(spark, sink).values()} == {7}
    if kind == "database":
        assert spark.table("whole_or_not.revenue").count() == 7
    drop_generations(spark, sink)
    assert {df.count() for df in read_published(spark, sink).values()} == {7}
    publish(tables(2), sink)
    assert {name: df.count() for name, df in read_published(spark, sink).items()} == dict.fromkeys(tables(1), 2)
    if kind == "database":
        spark.sql("DROP DATABASE whole_or_not CASCADE")


def test_duplicates_are_counted_by_digest(spark):
    from shelflight.operators.quality import duplicate_count

    rows = [("a", 0.0, None), ("a", -0.0, None), ("a", None, 0), ("a", None, 0), ("a", float("nan"), 1), ("a", float("nan"), 1), (None, None, None), ("", None, None), ("a", 0.0, 0)]
    df = spark.createDataFrame(rows, "s string, `d.x` double, i int")
    assert duplicate_count(df).first()[0] == len(rows) - df.dropDuplicates().count() == 3
    assert duplicate_count(df.limit(0)).first()[0] == 0


def test_ten_starts_at_once_reach_the_cost_of_separate_fits(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from shelflight.operators.segments import assigning, fit_centres

    draw = np.random.default_rng(4)
    centres = np.array([[0, 0], [6, 0], [0, 6], [6, 6]])
    points = np.concatenate([draw.normal(c, 0.8, (60, 2)) for c in centres])
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "x0 double, x1 double").repartition(3).cache()
    found, cost = fit_centres(df, 4, 10)
    vectors = VectorAssembler(inputCols=["x0", "x1"], outputCol="features").transform(df)
    best = min(KMeans(k=4, seed=i).fit(vectors).summary.trainingCost for i in range(5))
    assert math.isclose(cost, best, rel_tol=1e-3)
    named = assigning(["x0", "x1"], [0, 0], [1, 1], found, "c").transform(df).collect()
    assert all(r["c"] == int(np.argmin(((found - [r["x0"], r["x1"]]) ** 2).sum(axis=1))) for r in named)
    assert fit_centres(df.limit(0), 4, 2)[1] == 0.0
