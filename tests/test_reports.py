"""Reports on predictions: their rows, and that they read their input once."""

import types

from pyspark.sql import functions as F

from checks import catalog, compare
from shelflight.operators.metrics import classification_report

_DATA = "/root/testdata/sf0.001"


def test_registered_classification_report_is_planned_and_equals_its_sql(spark):
    """Its plan was refused: a cast of a whole struct fixed which fields are never null."""
    assert compare.check(spark, compare.oracle(_DATA), _DATA, "classification_report") is None


def test_classification_report_reads_its_input_once(spark, tmp_path):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), (None, "a"), ("c", None), ("b", "d")]
    spark.createDataFrame(rows, "y string, p string").write.parquet(f"{tmp_path}/t")
    report = classification_report(spark.read.parquet(f"{tmp_path}/t"), "y", "p")
    assert report._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    found = {r["label"]: tuple(r)[1:] for r in report.collect()}
    assert found == {
        "a": (0.5, 0.5, 0.5, 2), "b": (0.5, 0.5, 0.5, 2), "c": (0.0, 0.0, 0.0, 1), "d": (0.0, 0.0, 0.0, 0), None: (0.0, 0.0, 0.0, 1),
        "accuracy": (None, None, 0.333333, 6), "macro avg": (0.2, 0.2, 0.2, 6), "weighted avg": (0.333333, 0.333333, 0.333333, 6),
    }


def test_classification_report_of_nothing_has_its_last_rows(spark):
    rows = classification_report(spark.range(0).select(F.lit("a").alias("y"), F.lit("b").alias("p")), "y", "p").collect()
    assert {r["label"]: tuple(r)[1:] for r in rows} == {
        "accuracy": (None, None, 0.0, None), "macro avg": (None, None, None, None), "weighted avg": (0.0, 0.0, 0.0, None),
    }


def test_four_models_are_fitted_from_one_learning_table(spark, monkeypatch, tmp_path):
    """Each made its own learning table."""
    tables = []
    fitted = types.SimpleNamespace(expiry="e", demand="d", revenue="r", segment="s")
    monkeypatch.setattr(catalog.tr, "train_models", lambda df: tables.append(df) or fitted)
    for kind in ("expiry", "demand", "revenue", "segments"):
        monkeypatch.setattr(catalog.tr, f"train_{kind}", lambda df: tables.append(df))
    stages = catalog.Stages(spark, str(tmp_path))
    stages.engineered = spark.range(1)
    assert vars(stages.models) == vars(stages.models) == vars(fitted)
    assert len(tables) == 1
