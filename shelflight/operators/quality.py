"""Data-quality profile of a table, each report in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import half_even
from shelflight.session import shuffles_dropped


def _missing(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if dict(df.dtypes)[name] in ("float", "double"):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _null_cells(df: DataFrame) -> Column:
    """Missing cells of one row."""
    return sum((F.when(_missing(df, c), 1).otherwise(0) for c in df.columns), F.lit(0)).cast("bigint")


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and their share in percent."""
    width = len(df.columns)
    counts = df.select(_null_cells(df).alias("cells")).agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("cells"), F.lit(0)).alias("null_cells")
    )
    share = F.try_divide(F.col("null_cells") * 100.0, F.col("row_count").cast("double") * width)
    return counts.select(
        "row_count", F.lit(width).cast("bigint").alias("column_count"), "null_cells",
        half_even(share, 2).alias("null_cell_pct"),
    )


def null_distribution(df: DataFrame) -> DataFrame:
    """Missing values per column that has any: count and exact share in percent."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(_missing(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("missing")) for i, c in enumerate(df.columns)]
    )
    return (
        counts.select("n", F.inline(entries))
        .filter("missing > 0")
        .select("column_name", "missing", (F.col("missing") / F.col("n") * 100).alias("missing_pct"))
        .orderBy(F.col("missing").desc(), "column_name")
    )


def null_report(df: DataFrame) -> DataFrame:
    """The same with the share rounded for display."""
    return null_distribution(df).withColumn("missing_pct", half_even(F.col("missing_pct"), 2))


def row_digest(df: DataFrame) -> list[Column]:
    """Two hashes of 64 bits of a whole row; equal rows, nulls and NaN equal, have equal ones."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        columns += [column + F.lit(0.0) if kind in ("float", "double") else column, column.isNull()]  # -0.0 is 0.0
    return [F.xxhash64(F.lit(seed), *columns).alias(f"digest_{seed}") for seed in (1, 2)]


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows.

    Rows are told apart by 128 bits, and only those are shuffled, whatever the rows hold; copies merge map-side.
    """
    groups = df.select(*row_digest(df)).groupBy("digest_1", "digest_2").agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def changed_rows(before: DataFrame, after: DataFrame) -> int:
    """Rows that only one of two tables has, as often as it has more of them. Runs a job.

    Rows are told apart by 128 bits, and only those are shuffled, whatever the rows hold.
    """
    sides = [df.select(*row_digest(df), F.lit(sign).alias("sign")) for df, sign in ((before, 1), (after, -1))]
    groups = sides[0].unionByName(sides[1]).groupBy("digest_1", "digest_2").agg(F.abs(F.sum("sign")).alias("rows"))
    with shuffles_dropped(before.sparkSession):
        return groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def rule_violations(df: DataFrame) -> DataFrame:
    """Rows per broken rule, for the rules whose columns are present."""
    stock = next((c for c in ("Stock_Quantity", "Current_Stock") if c in df.columns), None)
    checks: dict[str, Column] = {}
    if stock:
        checks["negative_stock"] = F.col(stock) < 0
    if "Purchase_Price" in df.columns:
        checks["cost_not_positive"] = F.col("Purchase_Price") <= 0
    if {"Purchase_Price", "Selling_Price"} <= set(df.columns):
        checks["selling_below_cost"] = F.col("Selling_Price") < F.col("Purchase_Price")
    if not checks:
        return df.sparkSession.createDataFrame([], "rule string, row_count bigint")
    counts = df.agg(*[F.count_if(check).alias(name) for name, check in checks.items()])
    entries = [F.struct(F.lit(name).alias("rule"), F.col(name).alias("row_count")) for name in checks]
    return counts.select(F.inline(F.array(*entries)))


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    sides = [profile(df).select(F.lit(name).alias("side"), "row_count", "column_count", "null_cells")
             for name, df in (("raw", before), ("cleaned", after))]
    return sides[0].unionByName(sides[1])


def dataset_context(df: DataFrame) -> DataFrame:
    """Row count and column names, the description handed to the assistant."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("columns", F.lit(", ".join(df.columns)))
