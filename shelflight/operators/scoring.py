"""Scoring: derived inputs, model or rule predictions, and the KPIs built on them.

The formulas differ on purpose from the feature stage: revenue is based on past
volume, the margin is a fraction, and the stock bounds are inclusive.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import days_until, half_even, ratio_or_zero, to_number
from shelflight.operators.features import alias_if_missing, coerce_dates
from shelflight.operators.pareto import Boundaries, abc_class
from shelflight.schema import LEGACY_NAMES, LINE_KEY, as_date, type_names

NO_EXPIRY_DAYS = 9999


def scoring_inputs(df: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Names, dates and amounts the models and KPIs read; row-local."""
    df = df.toDF(*[c.strip() for c in df.columns])
    df = alias_if_missing(df, LEGACY_NAMES)
    if "Date_Added" not in df.columns:
        added = F.col("Timestamp") if "Timestamp" in df.columns else F.lit(None).cast("timestamp_ntz")
        df = df.withColumn("Date_Added", added)
    if "Last_Restock_Date" not in df.columns:
        df = df.withColumn("Last_Restock_Date", F.lit(None).cast("timestamp_ntz"))
    df = coerce_dates(df, ("Date_Added", "Expiry_Date", "Last_Restock_Date"))
    kinds = type_names(df)
    prices = ("Cost_Price", "Selling_Price", "Stock_Quantity", "Past_Sales_Volume", "Sales_Velocity")
    df = df.withColumns({c: to_number(F.col(c), kinds[c]) for c in prices if kinds.get(c) == "string"})
    days = days_until(F.col("Expiry_Date"), as_date(as_of)) if "Expiry_Date" in df.columns else F.lit(None)
    cost, volume = F.col("Cost_Price"), F.col("Past_Sales_Volume")
    return (
        df.withColumn("Days_To_Expiry", F.coalesce(days, F.lit(NO_EXPIRY_DAYS)).cast("bigint"))
        .withColumn("Inventory_Value", half_even(F.col("Stock_Quantity") * cost, 2))
        .withColumn("Revenue", half_even(volume * F.col("Selling_Price"), 2))
        .withColumn("Profit", half_even(F.col("Revenue") - volume * cost, 2))
        .withColumn("Profit_Margin", half_even(ratio_or_zero(F.col("Profit"), F.col("Revenue")), 4))
    )


def score_prep(df: DataFrame, as_of: str | dt.date, key: str = LINE_KEY, boundaries: Boundaries | None = None) -> DataFrame:
    """Scoring inputs plus the Pareto class; a table worth nothing, or less, is all A here. Without `boundaries` runs jobs."""
    return abc_class(scoring_inputs(df, as_of), "Inventory_Value", key, zero_total="A", negative_total="A", boundaries=boundaries)


def rule_predictions(df: DataFrame) -> DataFrame:
    """Predictions from the recorded risk, velocity and revenue, where no model is used."""
    return df.withColumns(
        {
            "Predicted_Expiry_Risk": F.col("Expiry_Risk"),
            "Predicted_Sales_Velocity": F.greatest(F.col("Sales_Velocity").cast("double"), F.lit(0.0)),
            "Predicted_Revenue": half_even(F.greatest(F.col("Revenue"), F.lit(0.0)), 2),
            "Predicted_Cluster": F.lit(None).cast("int"),
        }
    )


def stock_band(stock: Column, low: Column, high: Column) -> Column:
    """Inclusive bounds: a line exactly at a level is low or overstocked."""
    return F.when(stock <= low, "Low Stock").when(stock >= high, "Overstock").otherwise("Optimal Stock")


def predicted_turnover() -> Column:
    stock = F.col("Stock_Quantity") + 1
    return F.try_divide(F.col("Predicted_Sales_Velocity") * 365, stock.cast("double"))


def segment_margin() -> Column:
    revenue = F.col("Past_Sales_Volume") * F.col("Selling_Price")
    profit = revenue - F.col("Past_Sales_Volume") * F.col("Cost_Price")
    return ratio_or_zero(profit, revenue)


def score_kpis(df: DataFrame) -> DataFrame:
    """Revenue at risk and 0-100 health from the predictions."""
    risk = F.col("Predicted_Expiry_Risk")
    band = stock_band(F.col("Stock_Quantity"), F.col("Min_Stock_Level"), F.col("Max_Stock_Level"))
    penalty = (
        F.when(band.isin("Low Stock", "Overstock"), 20).otherwise(0)
        + F.when(risk == "High", 40).when(risk == "Medium", 20).otherwise(0)
        + F.when(predicted_turnover() < 1.0, 10).otherwise(0)
    )
    health = F.least(F.greatest(F.lit(100) - penalty, F.lit(0)), F.lit(100))
    at_risk = half_even(F.col("Stock_Quantity") * F.col("Selling_Price"), 2)
    return df.withColumns(
        {
            "Predicted_Revenue_at_Risk": F.when(risk.isin("High", "Medium"), at_risk).otherwise(F.lit(0.0)),
            "Predicted_Inventory_Health": health.cast("int"),
        }
    )


def score_by_rules(df: DataFrame, as_of: str | dt.date, key: str = LINE_KEY, boundaries: Boundaries | None = None) -> DataFrame:
    return df.transform(score_prep, as_of, key, boundaries).transform(rule_predictions).transform(score_kpis)
