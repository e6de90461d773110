"""Duplicates among stored rows: only digests and copies are shuffled, and shuffles do not stay."""

import pathlib
import re
import time

import pytest
from pyspark.sql import functions as F

from checks import catalog
from shelflight.operators import cleaning as cl
from shelflight.session import shared_folder, shuffles_dropped, written
from test_scale import _raw


def _as_text(df):
    return sorted(map(repr, df.collect()))


def test_stored_cleaning_has_the_rows_of_cleaning(spark):
    raw = _raw(spark)
    for several in (raw, raw.unionByName(raw).repartition(3), raw.limit(0), raw.dropDuplicates()):
        assert cl.clean_stored(several).columns == cl.clean(several).columns
        assert _as_text(cl.clean_stored(several)) == _as_text(cl.clean(several))
        assert _as_text(cl.drop_duplicate_rows_stored(cl.nulls_for_nan(several))) == _as_text(cl.nulls_for_nan(several).dropDuplicates())


@pytest.mark.parametrize("bits", [1, 28])
def test_one_of_each_keeps_one_row_a_pair_of_digests(spark, monkeypatch, bits):
    """Also where the bitmap is far too small, and where one row is most of the table."""
    monkeypatch.setattr(cl, "_MOST_BITS", bits)
    digest = F.when(F.col("id") < 3000, F.lit(7)).otherwise(F.col("id") - F.col("id") % 5 * F.col("id") % 2)
    rows = spark.range(5000).select(F.xxhash64(digest).alias("a"), F.xxhash64(digest, F.lit(1)).alias("b"), digest.alias("v"))
    # The same first digest, another second one.
    rows = rows.unionByName(rows.filter("v = 7").limit(1).withColumn("b", F.lit(0).cast("bigint")).withColumn("v", F.lit(-1).cast("bigint")))
    found = [r.v for r in cl.one_of_each(rows.repartition(4), "a", "b").collect()]
    assert sorted(found) == sorted({r.v for r in rows.collect()})


def test_whole_rows_without_copies_are_not_shuffled(spark):
    """Cleaning sent every row with all its columns."""
    rows = spark.range(20_000).select(F.xxhash64(F.col("id") % 19_900).alias("a"), F.xxhash64(F.col("id") % 19_900, F.lit(1)).alias("b"), F.lit("wide").alias("w"))
    plan = cl.one_of_each(rows, "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "broadcast" in plan
    assert cl.one_of_each(rows, "a", "b").count() == 19_900
    last = max(pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("merged-*"), key=lambda p: p.stat().st_mtime)
    assert 100 <= spark.read.parquet(str(last)).count() < 2_000


def test_wide_queries_take_cleaned_rows_as_stored(spark):
    for name in ("cleaned_inventory", "analysis_base", "filtered_lines", "training_table", "converted_dates", "business_rules"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and not re.search(r"l_orderkey", plan), name


def test_shuffles_of_stored_tables_are_dropped(spark):
    def shuffled():
        place = pathlib.Path(spark.sparkContext._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().getConf())[0])
        return {p.name for p in place.rglob("shuffle_*")}

    before = shuffled()
    written(spark.range(1000).repartition(7), "few")
    with shuffles_dropped(spark):
        assert spark.range(100).repartition(3).groupBy((F.col("id") % 3).alias("k")).count().count() == 3
    for _ in range(50):  # they go in the background
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before


def test_published_round_trip_leaves_no_stored_table(spark):
    """Cleaned rows and the four tables stayed, and the shuffles of every comparison."""
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    known = set(folder.iterdir()) if folder.exists() else set()
    rows = catalog.queries()["published_round_trip"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 8 and all(r["changed_rows"] == 0 for r in rows)
    assert not [f for new in set(folder.iterdir()) - known for f in new.rglob("*.parquet")]


def test_scored_text_is_written_compressed_and_read_as_it_was(spark, tmp_path):
    from shelflight.sources.readers import read_csv
    from shelflight.sources.writers import write_csv

    df = spark.createDataFrame([("a\"b,c", 1.5, None), (" é ", -0.0, "2001-01-02"), ("", 1e22, "x")], "t string, Selling_Price double, d string")
    for kind in ("none", "gzip"):
        write_csv(df, f"{tmp_path}/{kind}", kind)
    assert _as_text(read_csv(spark, f"{tmp_path}/gzip")) == _as_text(read_csv(spark, f"{tmp_path}/none"))
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    known = set(folder.glob("shelflight-scored-*"))
    catalog.queries()["priority_records_from_file"](spark, "/root/testdata/sf0.001")
    (file,) = set(folder.glob("shelflight-scored-*")) - known
    assert {f.suffix for f in file.glob("part-*")} == {".gz"}
