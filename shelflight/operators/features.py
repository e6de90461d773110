"""Business features of a cleaned inventory table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import days_until, parse_timestamp, ratio_or_zero, to_number
from shelflight.operators.pareto import Boundaries, abc_class
from shelflight.schema import DATE_COLUMNS, LEGACY_NAMES, LINE_KEY, as_date, type_names

# Fixed values. Coerced to numbers with 0 for what is none. The overstock threshold is text in
# a cleaned table, so a category such as "Low" becomes a threshold of 0.
COERCED = (
    "Purchase_Price", "Selling_Price", "Current_Stock", "Reorder_Level", "Daily_Sales", "Weekly_Demand",
    "Monthly_Demand", "Past_Sales_Volume", "Days_Remaining", "Revenue_At_Risk", "Recovered_Revenue",
    "Inventory_Value", "Revenue", "Profit", "Profit_Margin", "Inventory_Turnover", "Overstock_Level",
)

# Columns the analyses read as numbers.
ANALYSIS_NUMBERS = (
    "Days_Remaining", "Purchase_Price", "Selling_Price", "Current_Stock", "Reorder_Level", "Daily_Sales",
    "Weekly_Demand", "Monthly_Demand", "Lead_Time_Days", "Demand_Forecast", "Revenue_At_Risk", "Discount_%",
    "Customer_Rating", "Waste_Cost", "Recovered_Revenue",
)


def coerce_numbers(df: DataFrame, columns: tuple[str, ...], default: float = 0) -> DataFrame:
    names = type_names(df)
    return df.withColumns({c: to_number(F.col(c), names[c], default) for c in columns if c in names})


def coerce_dates(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    names = type_names(df)
    return df.withColumns({c: parse_timestamp(F.col(c), names[c], day_first=False) for c in columns if c in names})


def alias_if_missing(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Add `new = source` for every new name that is absent while its source is there.

    In order: a name added earlier may be the source of a later one.
    """
    for name, source in aliases.items():
        if name not in df.columns and source in df.columns:
            df = df.withColumn(name, F.col(source))
    return df


def demand_level(daily_sales: Column) -> Column:
    return F.when(daily_sales >= 50, "High").when(daily_sales >= 20, "Medium").otherwise("Low")


def stock_status(stock: Column, reorder: Column, overstock: Column) -> Column:
    """Strict bounds: a line exactly at a level is optimal."""
    return F.when(stock < reorder, "Low Stock").when(stock > overstock, "Overstock").otherwise("Optimal")


def inventory_health(days: Column, status: Column) -> Column:
    expiring = F.when(days < 30, 30).otherwise(0)
    low = F.when(status == "Low Stock", 20).otherwise(0)
    over = F.when(status == "Overstock", 20).otherwise(0)
    return (F.lit(100) - expiring - low - over).cast("bigint")


def row_features(df: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Every feature that depends on one row only; no shuffle, works on streams too."""
    as_of = as_date(as_of)
    df = coerce_numbers(df, COERCED)
    df = coerce_dates(df, DATE_COLUMNS)
    for name in ("Revenue_At_Risk", "Recovered_Revenue"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0.0))
    purchase, selling, stock = F.col("Purchase_Price"), F.col("Selling_Price"), F.col("Current_Stock")
    daily = F.col("Daily_Sales")
    unit_profit = selling - purchase
    days = days_until(F.col("Expiry_Date"), as_of) if "Expiry_Date" in df.columns else F.lit(None).cast("bigint")
    df = df.withColumn("Stock_Status", stock_status(stock, F.col("Reorder_Level"), F.col("Overstock_Level")))
    df = df.withColumns(
        {
            "Inventory_Value": stock * purchase,
            "Revenue": daily * selling,
            "Profit": daily * unit_profit,
            "Profit_Margin": ratio_or_zero(unit_profit, selling) * 100,
            "Inventory_Turnover": ratio_or_zero(F.col("Monthly_Demand").cast("double"), stock),
            "Demand_Level": demand_level(daily),
            "Inventory_Health": inventory_health(days, F.col("Stock_Status")),
        }
    )
    df = alias_if_missing(df, LEGACY_NAMES)
    # These always mirror their source, also when the input had its own.
    mirrored = {k: v for k, v in LEGACY_NAMES.items() if k != "Max_Stock_Level"}
    return df.withColumns({name: F.col(source) for name, source in mirrored.items()})


def zero_missing_numbers(df: DataFrame) -> DataFrame:
    """Infinite and missing numbers become 0; text and dates stay as they are."""
    infinite = float("inf")
    fixes = {}
    for name, kind in df.dtypes:
        if kind in ("float", "double"):
            value = F.col(f"`{name}`")
            finite = ~F.isnan(value) & (value != infinite) & (value != -infinite)
            fixes[name] = F.coalesce(F.when(finite, value), F.lit(0.0))
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            fixes[name] = F.coalesce(F.col(f"`{name}`"), F.lit(0))
    return df.withColumns(fixes)


def valued_features(df: DataFrame, as_of: str | dt.date) -> DataFrame:
    """All features but the Pareto class; row-local."""
    return row_features(df, as_of).transform(zero_missing_numbers)


def engineer(df: DataFrame, as_of: str | dt.date, key: str = LINE_KEY, boundaries: Boundaries | None = None) -> DataFrame:
    """All features, the Pareto class included. A table worth nothing is all C. Without `boundaries` runs jobs."""
    return abc_class(valued_features(df, as_of), "Inventory_Value", key, zero_total="C", boundaries=boundaries)


def analysis_base(df: DataFrame) -> DataFrame:
    """Columns the interactive analyses add to an engineered (or cleaned) table."""
    df = coerce_numbers(df, ANALYSIS_NUMBERS)
    df = coerce_dates(df, DATE_COLUMNS)
    purchase, selling, stock = F.col("Purchase_Price"), F.col("Selling_Price"), F.col("Current_Stock")
    daily, risk = F.col("Daily_Sales"), F.col("Revenue_At_Risk")
    return df.withColumns(
        {
            "Inventory_Value": stock * purchase,
            "Potential_Sales_Value": stock * selling,
            "Estimated_Daily_Revenue": daily * selling,
            "Estimated_Daily_Profit": daily * (selling - purchase),
            "Profit_Margin_%": ratio_or_zero(selling - purchase, selling) * 100,
            "Recovery_Rate_%": ratio_or_zero(F.col("Recovered_Revenue"), risk) * 100,
            "Stock_Coverage_Days": ratio_or_zero(stock.cast("double"), daily),
        }
    )
