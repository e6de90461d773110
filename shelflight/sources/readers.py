"""Inventory tables from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.operators.cleaning import numbers_from_text
from shelflight.schema import NULL_TOKENS


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def nulls_for_tokens(df: DataFrame) -> DataFrame:
    """Spreadsheet spellings of "no value" become null in text columns."""
    text = [c for c, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")) for c in text})


def read_csv(spark: SparkSession, path: str, typed: bool = True, multi_line: bool = False) -> DataFrame:
    """A CSV table with a header, read as text so that no pass infers types.

    `typed` turns the known numeric fields into numbers, leniently. `multi_line`
    allows line breaks inside quoted fields, at the price of unsplittable files.
    """
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line, inferSchema=False)
    df = df.transform(trim_headers).transform(nulls_for_tokens)
    return numbers_from_text(df) if typed else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).transform(trim_headers)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary document; the types are fixed, so no pass infers them."""
    schema = (
        "Products_Analysed bigint, High_Risk_Products bigint, Revenue_at_Risk double, "
        "Actual_Recovered_Revenue double, Expected_Recovery double, Estimated_Waste_Reduction_Pct double, "
        "Overall_Inventory_Health_Pct double, Recovery_Method string"
    )
    return spark.read.schema(schema).json(path)
