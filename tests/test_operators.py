import datetime as dt
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import catalog, compare
from checks.inventory_view import AS_OF, inventory_lines
from shelflight.operators import analytics as an
from shelflight.operators import cleaning as cl
from shelflight.operators.features import demand_level, inventory_health, stock_status
from shelflight.operators.recommend import impact_summary, recommend
from shelflight.operators.scoring import score_kpis
from shelflight.operators.splits import split
from shelflight.operators.training import Models, require_columns
from shelflight.plans.stages import execute_run
from shelflight.sources.publish import read_published
from shelflight.streaming.live import live_recommendations, write_live

DATA = "/root/testdata/sf0.001"


def _scored(spark, rows):
    names = ("Product_ID string, Product_Name string, Category string, Supplier string, Store_City string, "
             "Stock_Quantity bigint, Min_Stock_Level bigint, Max_Stock_Level bigint, Cost_Price double, "
             "Selling_Price double, Predicted_Expiry_Risk string, Predicted_Sales_Velocity double, "
             "Predicted_Revenue double, Recovered_Revenue double")
    return score_kpis(spark.createDataFrame(rows, names))


def _row(name, stock, low, high, risk="Low", velocity=0.0, revenue=0.0, recovered=0.0, city="Town", price=10.0):
    return (name, name, "Cat", "Sup", city, stock, low, high, 4.0, price, risk, velocity, revenue, recovered)


def test_rules_at_their_bounds(spark):
    rows = [
        _row("at both", 50, 50, 50, velocity=8.0),
        _row("slow", 5, 5, 100, velocity=4.9),
        _row("pace five", 5, 5, 100, velocity=5.0),
        _row("bulk", 50, 5, 100, velocity=12.0, revenue=1000.0),
        _row("none", 50, 5, 100, velocity=11.9),
        _row("east", 120, 5, 100, city="Store Front East"),
        _row("high", 50, 5, 100, risk="High"),
        _row("no risk", 50, 5, 100, risk="No Risk"),
    ]
    found = {}
    for r in recommend(_scored(spark, rows)).collect():
        found.setdefault(r.Product_ID, {})[r.Recommendation_Type.replace(" Recommendation", "")] = r
    assert set(found["at both"]) == {"Reorder", "Overstock", "Transfer", "Supplier"}
    assert (found["slow"]["Reorder"].Priority_Level, found["pace five"]["Reorder"].Priority_Level) == ("Medium", "High")
    assert found["slow"]["Reorder"].Expected_Revenue_Recovery == 855.0
    assert found["bulk"]["Purchase Planning"].Expected_Revenue_Recovery == 120.0
    assert found["east"]["Transfer"].Action == "Transfer 20 Units to Warehouse A"
    assert found["high"]["Discount"].Expected_Revenue_Recovery == 300.0
    assert "none" not in found and "no risk" not in found


def test_summary_caps_and_counts(spark):
    rows = [
        _row("p", 10, 50, 100, risk="High", recovered=500.0),
        _row("p", 10, 5, 100, risk="Medium", recovered=20.0),
        _row("q", 10, 5, 100, risk="Low", recovered=70.0),
    ]
    summary = impact_summary(_scored(spark, rows)).first()
    assert (summary.Products_Analysed, summary.High_Risk_Products) == (2, 1)
    assert (summary.Revenue_at_Risk, summary.Expected_Recovery) == (200.0, 140.0)
    assert summary.Actual_Recovered_Revenue == 120.0
    assert summary.Estimated_Waste_Reduction_Pct == pytest.approx(70.0)
    empty = impact_summary(_scored(spark, [_row("z", 10, 5, 100)])).first()
    assert (empty.Revenue_at_Risk, empty.Estimated_Waste_Reduction_Pct) == (0.0, 0.0)


def test_feature_bounds(spark):
    df = spark.createDataFrame([(19, 5, 29), (20, 10, 30), (49, 40, 31), (50, 41, None)], "d int, s int, days int")
    status = stock_status(F.col("s"), F.lit(10), F.lit(40))
    rows = df.select(demand_level(F.col("d")).alias("d"), status.alias("s"),
                     inventory_health(F.col("days"), status).alias("h")).collect()
    assert [tuple(r) for r in rows] == [
        ("Low", "Low Stock", 50), ("Medium", "Optimal", 100), ("Medium", "Optimal", 100), ("High", "Overstock", 80)
    ]


def test_business_rules_drop_each_violation(spark):
    good = inventory_lines(spark, DATA).transform(cl.clean).limit(1)
    bad = [
        good.withColumn("Manufacturing_Date", F.col("Expiry_Date") + F.expr("interval 1 day")),
        good.withColumn("Discount_%", F.lit(100.5)),
        good.withColumn("Customer_Rating", F.lit(None).cast("double")),
        good.withColumn("Days_Remaining", F.lit(-1).cast("bigint")),
    ]
    for df in bad:
        assert df.transform(cl.apply_business_rules).isEmpty()


def test_correlations_with_constant_and_missing(spark):
    rows = [(1.0, 2.0, 7.0), (2.0, None, 7.0), (3.0, 6.5, 7.0), (4.0, 7.0, 7.0)]
    found = {(r.a, r.b): r["corr"] for r in an.correlations(spark.createDataFrame(rows, "x double, y double, c double")).collect()}
    assert found["x", "x"] == pytest.approx(1.0)
    complete = np.corrcoef([1.0, 3.0, 4.0], [2.0, 6.5, 7.0])[0, 1]
    assert found["x", "y"] == found["y", "x"] == pytest.approx(complete)
    assert found["x", "c"] is None and found["c", "c"] is None


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") == 7, "rare").otherwise("usual").alias("y"))
    first = {r.k: r.is_train for r in split(df, "k", "y").collect()}
    second = {r.k: r.is_train for r in split(df.repartition(5), "k", "y").collect()}
    assert first == second and first["7"]
    assert sum(first.values()) == 1 + int(999 * 0.8)


def test_a_whole_run(spark, tmp_path):
    raw = inventory_lines(spark, DATA)
    run = execute_run(raw, AS_OF, str(tmp_path / "run"), dt.datetime(2001, 12, 1))
    assert run.cleaned.count() == 5076
    assert run.summary.first().Products_Analysed == run.scored.select("Product_ID").distinct().count()
    published = read_published(spark, str(tmp_path / "run/published/"))["recommendations"]
    shown = [c for c in published.columns if c in run.recommendations.columns]
    assert published.select(*shown).exceptAll(run.recommendations.select(*shown)).count() == 0
    assert published.count() == run.recommendations.count()


def test_stream_gives_the_batch_result(spark, tmp_path):
    lines = inventory_lines(spark, DATA).dropDuplicates()
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    query = write_live(live_recommendations(stream, AS_OF), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    expected, got = catalog.Stages(spark, DATA).advice, spark.read.parquet(str(tmp_path / "out"))
    assert expected.exceptAll(got.select(*expected.columns)).count() == 0 and got.count() == expected.count()


def test_models_need_their_columns_and_files(spark, tmp_path):
    with pytest.raises(ValueError, match="missing model features.*'b'"):
        require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b"])
    with pytest.raises(FileNotFoundError, match="expiry.*demand.*revenue.*segment"):
        Models.load(str(tmp_path / "nowhere"))


def test_correlations_of_large_means_and_odd_values(spark):
    generator = np.random.default_rng(3)
    x = generator.normal(size=400)
    y = x + generator.normal(size=400)
    rows = [(float(1e8 + 5 * a), float(1.7e9 + b), float("nan") if i % 9 == 0 else float(a), 2.5) for i, (a, b) in enumerate(zip(x, y))]
    found = {(r.a, r.b): r["corr"] for r in an.correlations(spark.createDataFrame(rows, "p double, q double, z double, c double")).collect()}
    assert found["p", "q"] == pytest.approx(np.corrcoef([r[0] for r in rows], [r[1] for r in rows])[0, 1], abs=1e-6)
    some = [i for i in range(400) if i % 9]
    assert found["p", "z"] == pytest.approx(np.corrcoef([rows[i][0] for i in some], [rows[i][2] for i in some])[0, 1], abs=1e-6)
    assert found["c", "c"] is None and found["p", "c"] is None and found["q", "q"] == 1.0


def test_crosstab_counts_every_risk(spark):
    rows = [("a", "No Risk")] * 3 + [("b", "High"), ("b", "Low"), (None, "High"), ("a", None)]
    table = an.risk_crosstab(spark.createDataFrame(rows, "Category string, Predicted_Expiry_Risk string"), n=1).collect()
    assert [tuple(r) for r in table] == [("a", 0, 0, 0, 3)]


@pytest.mark.parametrize("name", ["cleaned_inventory", "cleaning_audit", "executive_categories", "recommendations",
                                  "impact_summary", "risk_crosstab", "csv_round_trip"])
def test_registered_query_matches_its_sql(spark, name):
    assert pathlib.Path(DATA).exists()
    assert compare.check(spark, compare.oracle(DATA), DATA, name) is None
