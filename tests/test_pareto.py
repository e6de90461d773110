import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelflight.functions import to_units
from shelflight.operators import pareto
from shelflight.operators.pareto import abc_class, running_share


def _expected(values, zero):
    """Brute force over (key, value) pairs in whole ten-thousandths."""
    import hashlib

    rows = [(k, round(v * 10000)) for k, v in values if v is not None]
    rows.sort(key=lambda r: (-r[1], hashlib.md5(r[0].encode()).hexdigest(), r[0]))
    total, running, out = sum(u for _, u in rows), 0, {k: "C" for k, v in values if v is None}
    sign = (total > 0) - (total < 0)
    for key, units in rows:
        running += units
        inside = [(running * 100 - total * limit) * sign <= 0 for limit in (80, 95)]
        out[key] = "A" if inside[0] else "B" if inside[1] else "C"
    return {k: zero for k, _ in values} if total == 0 else out


def _classes(spark, values, zero="C", partitions=3):
    df = spark.createDataFrame([(k, v) for k, v in values], "k string, v double").repartition(partitions)
    return {r.k: r.ABC_Category for r in abc_class(df, "v", "k", zero).collect()}


CASES = {
    "exact 80 and 95": [("a", 80.0), ("b", 15.0), ("c", 5.0)],
    "just above 80": [("a", 80.0001), ("b", 14.9999), ("c", 5.0)],
    "all tied": [(f"k{i}", 7.0) for i in range(100)],
    "tied across the edge": [("x", 50.0)] + [(f"t{i}", 1.0) for i in range(60)] + [("z", 0.0), ("y", 0.0)],
    "one line": [("only", 3.0)],
    "with null": [("a", 5.0), ("n", None), ("b", 1.0)],
    "negative tail": [("a", 90.0), ("b", 20.0), ("c", -10.0)],
    "all negative": [("a", -1.0), ("b", -2.0), ("c", -3.0), ("d", -0.5)],
    "large and small": [("big", 9.0e10), ("mid", 12345.6789), ("tiny", 0.0001)],
}


@pytest.mark.parametrize("name", CASES)
def test_classes_match_brute_force(spark, name):
    assert _classes(spark, CASES[name]) == _expected(CASES[name], "C")


def test_random_values_with_a_hot_value(spark):
    generator = random.Random(5)
    values = [(f"k{i}", 250.0 if i % 3 == 0 else round(generator.lognormvariate(5, 2), 2)) for i in range(3000)]
    expected = _expected(values, "C")
    assert _classes(spark, values, partitions=1) == expected
    assert _classes(spark, values, partitions=7) == expected


def test_zero_total_gets_the_given_class(spark):
    values = [("a", 0.0), ("b", 0.0)]
    assert _classes(spark, values, "C") == {"a": "C", "b": "C"}
    assert _classes(spark, values, "A") == {"a": "A", "b": "A"}


def test_running_share_equals_one_global_window(spark):
    generator = random.Random(9)
    rows = [(f"k{i}", 40.0 if i % 3 == 0 else round(generator.uniform(0, 500), 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double")
    units = to_units(F.col("v"))
    order = Window.orderBy(units.desc(), F.md5("k"), "k").rowsBetween(Window.unboundedPreceding, 0)
    expected = {r.k: r.s for r in df.select("k", F.sum(units).over(order).alias("s")).collect()}
    actual = {r.k: round(r.Running_Value * 10000) for r in running_share(df, "v", "k").collect()}
    assert actual == expected


def test_no_plan_step_gathers_the_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    plan = abc_class(df, "v", "k", "C")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan
    rows = df.select(to_units(F.col("v")).alias("u"), "k")
    steps = pareto._boundaries(rows)._jdf.queryExecution().optimizedPlan().toString()
    # Windows run over groups per limit and over the total of the first prefixes, never over rows.
    assert "Window" in steps and "Aggregate" in steps and "Python" not in steps


def test_one_value_without_keys_is_spread(spark):
    """All rows share value and key: no task of the ranking holds them all."""
    df = spark.range(20_000, numPartitions=4).select(F.lit(None).cast("string").alias("k"), F.lit(5.0).alias("v"), "id")
    ranked = running_share(df, "v", "k")
    held = ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert held < 10_000
    assert sorted(r["Running_Value"] for r in ranked.collect()) == [5.0 * (i + 1) for i in range(20_000)]


def test_a_total_below_zero_gets_the_given_class(spark):
    df = spark.createDataFrame([("a", -5.0), ("b", 2.0)], "k string, v double")
    assert {r["ABC_Category"] for r in abc_class(df, "v", "k", "A", "A").collect()} == {"A"}
    assert {r["k"]: r["ABC_Category"] for r in abc_class(df, "v", "k", "A").collect()} == _expected([("a", -5.0), ("b", 2.0)], "A")


def test_amounts_without_limit_or_number(spark):
    values = [("big", 1e15), ("nan", float("nan")), ("inf", float("inf")), ("a", 1.0), ("none", None)]
    assert _classes(spark, values) == {"big": "C", "nan": "C", "inf": "C", "a": "C", "none": "C"}
