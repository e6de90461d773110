"""What moves between tasks, for tables larger than memory."""

import pathlib
import datetime as dt
import re

import numpy as np
from pyspark.sql import functions as F

from shelflight.functions import parse_timestamp
from shelflight.operators import cleaning as cl
from shelflight.operators import segments
from shelflight.session import tune
from checks import catalog
from shelflight.operators.quality import changed_rows
from shelflight.session import shared_folder

_ROW = {
    "Product_ID": "p", "Product_Name": "soap", "Category": "bath", "Brand": None, "Purchase_Price": 1.0, "Selling_Price": 2.0,
    "Current_Stock": 3.0, "Reorder_Level": 1.0, "Daily_Sales": 0.0, "Weekly_Demand": 2.0, "Monthly_Demand": 9.0,
    "Lead_Time_Days": 1.0, "Demand_Forecast": 1.0, "Days_Remaining": 5.0, "Customer_Rating": 4.0, "Discount_%": 0.0,
    "Expiry_Date": "2001-05-01", "Manufacturing_Date": "2001-01-01", "Timestamp": None,
}
_SCHEMA = ", ".join(f"`{c}` {'double' if isinstance(v, float) else 'string'}" for c, v in _ROW.items())


def _raw(spark):
    odd = [
        {}, {}, {"Daily_Sales": -0.0}, {"Category": "BATH"}, {"Brand": "generic"}, {"Category": None}, {"Category": None},
        {"Selling_Price": float("nan")}, {"Selling_Price": None}, {"Category": None, "Brand": "bath"}, {"Product_ID": None},
        {"Expiry_Date": "n/a"}, {"Expiry_Date": "01/05/2001"}, {"Expiry_Date": "2000-05-01"}, {"Current_Stock": -1.0},
    ]
    return spark.createDataFrame([tuple({**_ROW, **o}.values()) for o in odd], _SCHEMA)


def test_duplicates_dropped_last_leave_the_rows_of_duplicates_dropped_first(spark):
    raw = _raw(spark)
    steps = (cl.nulls_for_nan, cl.drop_duplicate_rows, cl.fill_missing, cl.drop_invalid, cl.standardize_text, cl.convert_dates, cl.apply_business_rules, cl.cast_types)
    want = raw
    for step in steps:
        want = want.transform(step)
    found = cl.clean(raw)
    assert found.columns == want.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    assert found.count() == 7


def test_cleaning_sends_only_what_is_read(spark):
    tune(spark)
    plan = cl.clean(_raw(spark)).select("Product_ID")._jdf.queryExecution().optimizedPlan().toString()
    sent = re.search(r"Aggregate \[.*?\], \[(.*)\]", plan).group(1)
    assert "Product_ID" in sent and "Lead_Time_Days" not in sent and "Weekly_Demand" not in sent
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_iso_dates_meet_one_pattern_only(spark):
    parsed = parse_timestamp(F.col("t"), "string", day_first=True).alias("d")
    plan = spark.createDataFrame([("x",)], "t string").select(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"WHEN RLIKE\(t#\d+, \^\\d\{4\}-\\d\{2\}-\\d\{2\}", plan)
    texts = {"2001-05-03": dt.datetime(2001, 5, 3), "2001-13-03": None, "  12-03-69": dt.datetime(1969, 3, 12), "2001-05-03\n": dt.datetime(2001, 5, 3), "12-03-2001": dt.datetime(2001, 3, 12)}
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsed).collect()
    assert {r["t"]: r["d"] for r in found} == texts


def test_a_round_of_k_means_multiplies_no_rows(spark):
    draw = np.random.default_rng(5)
    rows = draw.normal(size=(300, 2))
    points = spark.createDataFrame([*map(tuple, rows.tolist()), (float("nan"), 1.0), (None, 2.0)], "a double, b double")
    centres = draw.normal(size=(3, 4, 2))
    found = segments._round(points.repartition(5), centres)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    off = ((rows[:, None, None, :] - centres[None]) ** 2).sum(axis=3)
    for r in found.collect():
        mine = rows[off[:, r["start"]].argmin(axis=1) == r["centre"]]
        assert r["n"] == len(mine)
        assert np.allclose([r["a"], r["b"]], mine.sum(axis=0))
        assert np.isclose(r["cost"], ((mine - centres[r["start"], r["centre"]]) ** 2).sum())
    assert sum(r["n"] for r in found.collect()) == 900


def test_split_stores_classes_and_hashes_once(spark, monkeypatch):
    from shelflight.operators import splits

    stored = []
    keep = splits.written
    monkeypatch.setattr(splits, "written", lambda df, name: stored.append(df.columns) or keep(df, name))
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).cast("string").alias("y"), F.lit("wide").alias("w"))
    sizes = {(r["y"], r["is_train"]): r["row_count"] for r in splits.split_sizes(splits.split(df, "k", "y"), "y").collect()}
    assert stored == [["g", "h", "b"]]
    assert sizes == {("0", True): 40, ("0", False): 10, ("1", True): 40, ("1", False): 10}


def test_changed_rows_counts_as_multisets_do(spark):
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "n int, t string")
    after = spark.createDataFrame([(1, "a"), (2, None), (2, ""), (4, "c")], "n int, t string")
    assert changed_rows(before, after) == before.exceptAll(after).count() + after.exceptAll(before).count() == 4
    assert changed_rows(before, before) == changed_rows(before.limit(0), after.limit(0)) == 0


def test_published_round_trip_leaves_no_generation(spark):
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    known = set(folder.glob("shelflight-published-*"))
    rows = catalog.queries()["published_round_trip"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 8 and all(r["changed_rows"] == 0 and r["table_rows"] > 0 for r in rows)
    (sink,) = set(folder.glob("shelflight-published-*")) - known
    assert not [f for f in sink.rglob("*.parquet")]


def test_cleaning_is_compiled_apart_from_what_made_the_rows(spark):
    """Else one method holds both, is too long to be compiled, and every step copies every row."""
    raw = _raw(spark).repartition(2).select(F.inline(F.array(F.struct("*"))))
    cleaned = cl.clean(raw)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = cl.clean(raw)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    made, checked = re.search(r"\*\((\d+)\) Generate inline", plan), re.findall(r"\*\((\d+)\) Filter .*Purchase_Price", plan)
    assert made and checked and made[1] not in checked
    # Two cleaned tables can still meet in one plan.
    assert cleaned.unionByName(cl.clean(raw)).count() == 2 * cleaned.count()


def test_numbers_in_text_are_parsed_once_and_as_before(spark):
    from shelflight.functions.numeric import to_number

    values = ["12.5", " 7 ", "12.5d", "3F ", "4.f\t", "1e3", "-0", "NaN", "Infinity", "-inf", "0x1p3", "0x1p3d", "d", "", None, "1,5", "5D\n", "١"]
    want = [12.5, 7.0, None, None, None, 1000.0, -0.0, None, float("inf"), float("-inf"), None, None, None, None, None, None, None, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    found = [r.n for r in df.select("i", to_number(F.col("t"), "string").alias("n")).orderBy("i").collect()]
    as_before = F.when(~F.col("t").rlike(r"[0-9.][dDfF]\s*$"), F.col("t").try_cast("double"))
    before = [r.n for r in df.select("i", F.when(~F.isnan(as_before), as_before).alias("n")).orderBy("i").collect()]
    assert found == before and found[:10] == want[:10]
    plan = df.select(to_number(F.col("t"), "string"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"cast\(t#\d+ as double\)", plan)) == 1
