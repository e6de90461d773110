"""Row filters of the interactive views. Each is optional and pushes down."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_values(df: DataFrame, chosen: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Keep rows whose columns hold one of the chosen values; None means no filter."""
    for name, values in chosen.items():
        if values is not None and name in df.columns:
            df = df.filter(F.col(name).isin(list(values)))
    return df


def urgent_expiry(days_limit: int = 30) -> Column:
    """Due within the limit, or recorded as high risk in any spelling of the case."""
    return (F.col("Days_Remaining") <= days_limit) | (F.lower("Expiry_Risk") == "high")


def expiring_within_a_year(df: DataFrame) -> DataFrame:
    """Strictly between a year past and a year ahead; drops "no date" markers."""
    return df.filter((F.col("Days_To_Expiry") > -365) & (F.col("Days_To_Expiry") < 365))


def option_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values of several columns, as (field, option), in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("option")) for c in columns])
    return df.select(F.inline(pairs)).filter("option is not null").distinct().orderBy("field", "option")
