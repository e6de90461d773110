"""Groupings, trends, KPIs and correlations behind the dashboards.

Null group keys are dropped, a sum of nothing is 0, counts count non-null ids.
All aggregates combine on the map side, so a key that holds a third of the rows
reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.functions import exact_mean, exact_sum, half_even, ratio_or_zero, to_number, year_month
from shelflight.functions.numeric import is_amount
from shelflight.operators.filters import expiring_within_a_year, urgent_expiry
from shelflight.schema import type_names

_WHOLE = ("tinyint", "smallint", "int", "bigint")

# Columns the correlation view offers, in order; the first 12 are preselected.
CORRELATION_COLUMNS = (
    "Purchase_Price", "Selling_Price", "Current_Stock", "Reorder_Level", "Daily_Sales", "Weekly_Demand",
    "Monthly_Demand", "Lead_Time_Days", "Demand_Forecast", "Revenue_At_Risk", "Discount_%", "Customer_Rating",
    "Waste_Cost", "Recovered_Revenue", "Inventory_Value", "Estimated_Daily_Revenue", "Estimated_Daily_Profit",
    "Profit_Margin_%",
)
FLAG_COLUMNS = ("Low_Stock_Flag", "Overstock_Flag", "Reorder_Flag")


def total(df: DataFrame, name: str) -> Column:
    """Order-independent sum of a column, 0 for no rows."""
    kind = type_names(df)[name]
    if kind in _WHOLE:
        return F.coalesce(F.sum(F.col(name).cast("bigint")), F.lit(0))
    return exact_sum(to_number(F.col(name), kind))


def group_totals(
    df: DataFrame, by: str | Sequence[str], sums: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """Sums per group (same column names) plus any further aggregates."""
    keys = [by] if isinstance(by, str) else list(by)
    return df.dropna(subset=keys).groupBy(*keys).agg(*extra, *[total(df, c).alias(c) for c in sums])


def top(df: DataFrame, n: int, metric: str, *tie_break: str) -> DataFrame:
    """The n largest rows; a top-k per task, then one merge, never a full sort."""
    return df.orderBy(F.col(metric).desc_nulls_last(), *[F.col(c).asc() for c in tie_break]).limit(n)


def _lines() -> Column:
    return F.count("Product_ID").alias("Product_Count")


# Overview of an engineered table


def category_summary(df: DataFrame) -> DataFrame:
    return group_totals(df, "Category", ["Inventory_Value", "Revenue"], [_lines()])


def brand_summary(df: DataFrame, n: int = 10) -> DataFrame:
    return top(group_totals(df, "Brand", ["Inventory_Value"], [_lines()]), n, "Inventory_Value", "Brand")


def supplier_summary(df: DataFrame) -> DataFrame:
    out = group_totals(df, "Supplier", ["Revenue", "Recoverable_Revenue"])
    return out.orderBy(F.col("Revenue").desc(), "Supplier")


def monthly_trend(df: DataFrame, date: str = "Timestamp") -> DataFrame:
    """Onboarded revenue, value and volume per month of the record date."""
    months = df.withColumn("YearMonth", year_month(F.col(date)))
    totals = group_totals(months, "YearMonth", ["Revenue", "Inventory_Value", "Past_Sales_Volume"])
    return totals.withColumnsRenamed(
        {
            "Revenue": "Revenue_Added",
            "Inventory_Value": "Inventory_Cost_Added",
            "Past_Sales_Volume": "Sales_Volume_Added",
        }
    ).orderBy("YearMonth")


def expiry_trend(df: DataFrame) -> DataFrame:
    months = expiring_within_a_year(df).withColumn("ExpiryMonth", year_month(F.col("Expiry_Date")))
    return group_totals(months, "ExpiryMonth", ["Revenue_At_Risk"], [_lines()]).orderBy("ExpiryMonth")


def top_selling_products(df: DataFrame, n: int = 10, key: str = "Batch_No") -> DataFrame:
    lines = df.select("Product_ID", "Product_Name", key, "Past_Sales_Volume")
    return top(lines, n, "Past_Sales_Volume", "Product_ID", key)


def top_groups(df: DataFrame, by: str, metric: str, n: int = 5) -> DataFrame:
    return top(group_totals(df, by, [metric]), n, metric, by)


# Interactive analyses


def analysis_kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        F.countDistinct("Product_ID").alias("Total_Products"),
        *[total(df, c).alias(c) for c in ("Inventory_Value", "Revenue_At_Risk", "Recovered_Revenue")],
        exact_mean(F.col("Customer_Rating")).alias("Average_Rating"),
        exact_mean(F.col("Daily_Sales").cast("double")).alias("Average_Daily_Sales"),
    )


def category_analysis(df: DataFrame) -> DataFrame:
    out = group_totals(df, "Category", ["Inventory_Value", "Current_Stock", "Daily_Sales", "Revenue_At_Risk"])
    return out.orderBy(F.col("Inventory_Value").desc(), "Category")


def brand_distribution(df: DataFrame, n: int = 15) -> DataFrame:
    sums = ["Inventory_Value", "Current_Stock", "Estimated_Daily_Revenue", "Revenue_At_Risk"]
    products = F.countDistinct("Product_ID").alias("Product_Count")
    return top(group_totals(df, "Brand", sums, [products]), n, "Inventory_Value", "Brand")


def supplier_contribution(df: DataFrame, n: int = 15) -> DataFrame:
    sums = ["Inventory_Value", "Revenue_At_Risk", "Recovered_Revenue", "Waste_Cost", "Current_Stock"]
    out = group_totals(df, "Supplier", sums)
    rate = ratio_or_zero(F.col("Recovered_Revenue"), F.col("Revenue_At_Risk")) * 100
    return top(out.withColumn("Recovery_Rate_%", rate), n, "Inventory_Value", "Supplier")


def daily_trend(df: DataFrame) -> DataFrame:
    sums = ["Inventory_Value", "Estimated_Daily_Revenue", "Revenue_At_Risk", "Recovered_Revenue", "Current_Stock"]
    days = df.withColumn("Analysis_Date", F.col("Timestamp").cast("date"))
    return group_totals(days, "Analysis_Date", sums).orderBy("Analysis_Date")


def expiry_risk_summary(df: DataFrame) -> DataFrame:
    return group_totals(df, "Expiry_Risk", ["Revenue_At_Risk", "Inventory_Value"], [_lines()])


def capital_at_risk(df: DataFrame) -> DataFrame:
    out = group_totals(df, "Category", ["Revenue_At_Risk", "Waste_Cost", "Recovered_Revenue"])
    return out.orderBy(F.col("Revenue_At_Risk").desc(), "Category")


def days_histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    """Lines per equal-width bin of the remaining days and expiry risk.

    The rows are read once: they are counted per value and risk, and the bins are drawn over that small table.
    """
    days = F.col("Days_Remaining").cast("double")
    counts = df.groupBy(days.alias("days"), "Expiry_Risk").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # over one row per value and risk
    low, high = F.min("days").over(everything), F.max("days").over(everything)
    counts = counts.withColumns({"low": low, "width": (high - low) / bins})
    position = F.when(F.col("width") > 0, F.floor((F.col("days") - F.col("low")) / F.col("width"))).otherwise(F.lit(0))
    binned = counts.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
    binned = binned.withColumn("bin_start", half_even(F.col("low") + F.col("bin") * F.col("width"), 6))
    binned = binned.dropna(subset=["bin", "bin_start", "Expiry_Risk"])
    return binned.groupBy("bin", "bin_start", "Expiry_Risk").agg(F.sum("n").alias("row_count"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    out = group_totals(df, column, extra=[F.count(F.lit(1)).alias("row_count")])
    return out.orderBy(F.col("row_count").desc(), column)


def top_products(df: DataFrame, metric: str, n: int = 15, key: str = "Batch_No") -> DataFrame:
    shown = ["Product_ID", "Product_Name", "Category", "Brand", metric, "Current_Stock", "Expiry_Risk",
             "Recommended_Action"]
    return top(df.select(*shown, key), n, metric, "Product_ID", key)


def urgent_list(df: DataFrame, n: int = 100, key: str = "Batch_No") -> DataFrame:
    shown = ["Product_ID", "Product_Name", "Category", "Brand", "Days_Remaining", "Expiry_Risk", "Current_Stock",
             "Revenue_At_Risk", "Recommended_Action"]
    return top(df.filter(urgent_expiry()).select(*shown, key), n, "Revenue_At_Risk", "Product_ID", key)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns without the binary flags, from the schema alone."""
    kinds = (*_WHOLE, "float", "double")
    return [c for c, kind in df.dtypes if kind in kinds and c not in FLAG_COLUMNS]


# Pairs of columns of one aggregate.
_PAIRS = 24


def _pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows that have both; null where one of them does not vary (`corr` divides by zero there)."""
    spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), spread)


def correlations(df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """Pearson matrix in long form (a, b, corr), pairwise complete, in one pass.

    All pairs of columns are aggregates of one grouping, so a row stays one row and a shuffle moves one row of moments
    per task. Tables so wide that they have more than `_PAIRS` pairs are aggregated in blocks of pairs, one row per
    block. The moments are Spark's own, which are updated around the running means, so large means cost no digits.
    NaN and infinity are missing. A constant column has no correlation: null.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    kinds = type_names(df)

    def finite(name: str) -> Column:
        value = F.col(f"`{name}`").cast("double")
        return value if kinds[name] in _WHOLE else F.when(is_amount(value), value)

    values = df.select(*[finite(c).alias(f"c{k}") for k, c in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    blocks = [pairs[k : k + _PAIRS] for k in range(0, len(pairs), _PAIRS)]
    if len(blocks) == 1:
        moments = values.agg(*[_pearson(F.col(f"c{i}"), F.col(f"c{j}")).alias(f"m{k}") for k, (i, j) in enumerate(pairs)]).withColumn("block", F.lit(0))
    else:
        sides = [F.struct(F.lit(b).alias("block"), *[F.array(*[F.col(f"c{pair[side]}") for pair in block]).alias(name) for side, name in enumerate("xy")])
                 for b, block in enumerate(blocks)]
        no_row = df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in values.columns])  # so that no block is missing
        spread = values.unionByName(no_row).select(F.inline(F.array(*sides)))
        moments = spread.groupBy("block").agg(*[_pearson(F.get("x", F.lit(k)), F.get("y", F.lit(k))).alias(f"m{k}") for k in range(_PAIRS)])
    cells = F.posexplode(F.array(*[F.col(f"m{k}") for k in range(len(blocks[0]) if blocks else 0)])).alias("at", "corr")
    number = F.col("block") * _PAIRS + F.col("at")
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    corr = F.when(F.col("corr").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("corr"))))
    corr = F.when(F.col("i") == F.col("j"), F.when(corr.isNotNull(), F.lit(1.0))).otherwise(corr)
    label = F.array(*[F.lit(c) for c in names])
    found = (
        moments.select("block", cells).filter(number < len(pairs))
        .select(F.get(places, number).alias("place"), "corr").select("place.i", "place.j", "corr")
        .select("i", "j", (corr if digits is None else half_even(corr, digits)).alias("corr"))
    )
    # The matrix is symmetric: a cell beside the diagonal is two.
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return found.select(F.explode(both).alias("place"), "corr").select(F.get(label, F.col("place.i")).alias("a"), F.get(label, F.col("place.j")).alias("b"), "corr")


# Executive view of an engineered table


def executive_kpis(df: DataFrame) -> DataFrame:
    money = ("Inventory_Value", "Revenue", "Profit", "Revenue_At_Risk", "Recoverable_Revenue")
    return df.agg(
        F.count(F.lit(1)).alias("Total_Products"),
        *[total(df, c).alias(c) for c in money],
        exact_mean(F.col("Inventory_Health").cast("double")).alias("Average_Health"),
        F.count_if(F.col("Expiry_Risk") == "High").alias("Near_Expiry"),
        F.count_if(F.col("Stock_Status") == "Low Stock").alias("Low_Stock"),
        F.count_if(F.col("Stock_Status") == "Overstock").alias("Overstock"),
    )


def executive_categories(df: DataFrame) -> DataFrame:
    health = exact_mean(F.col("Inventory_Health").cast("double")).alias("Avg_Health")
    out = group_totals(df, "Category", ["Inventory_Value", "Revenue", "Profit"], [_lines(), health])
    return out.orderBy(F.col("Revenue").desc(), "Category")


# Command centre over a scored table


def score_dashboard_kpis(df: DataFrame) -> DataFrame:
    """KPIs that read any column leniently: missing or no number counts as 0."""
    names = type_names(df)

    def number(name: str) -> Column:
        return to_number(F.col(name), names[name], 0.0).cast("double") if name in names else F.lit(0.0)

    return df.agg(
        F.countDistinct("Product_ID").alias("Products"),
        exact_sum(number("Inventory_Value")).alias("Inventory_Value"),
        exact_sum(number("Predicted_Revenue_at_Risk")).alias("Revenue_at_Risk"),
        exact_mean(number("Predicted_Inventory_Health")).alias("Inventory_Health"),
    )


def risk_exposure(df: DataFrame) -> DataFrame:
    return group_totals(df, "Predicted_Expiry_Risk", ["Predicted_Revenue_at_Risk"])


def risk_by_category(df: DataFrame, n: int = 12) -> DataFrame:
    return top_groups(df, "Category", "Predicted_Revenue_at_Risk", n)


def value_by_category_and_risk(df: DataFrame) -> DataFrame:
    return group_totals(df, ["Category", "Predicted_Expiry_Risk"], ["Inventory_Value"])


def value_tree(df: DataFrame) -> DataFrame:
    """Leaves, category totals and grand total of the capital tree.

    `level` is 0 for a leaf, 1 for a category and 3 for the total.
    """
    keys = ["Category", "Predicted_Expiry_Risk"]
    rolled = df.dropna(subset=keys).rollup(*keys)
    return rolled.agg(
        F.grouping_id().cast("int").alias("level"), total(df, "Inventory_Value").alias("Inventory_Value")
    )


def risk_crosstab(df: DataFrame, risks: Sequence[str] = ("High", "Medium", "Low"), n: int = 12) -> DataFrame:
    """Lines per category and risk for the n largest categories; absent cells are 0.

    Risks that are not named are counted in `Other`, so a category ranks by all of its lines. One pass, no lookup
    of distinct values.
    """
    risk = F.col("Predicted_Expiry_Risk")
    cells = [F.count_if(risk == r).alias(r) for r in risks]
    other = F.count_if(~risk.isin(*risks)).alias("Other")
    table = df.dropna(subset=["Category", "Predicted_Expiry_Risk"]).groupBy("Category").agg(
        *cells, other, F.count(F.lit(1)).alias("_total")
    )
    return top(table, n, "_total", "Category").drop("_total")


def predicted_risk_distribution(df: DataFrame) -> DataFrame:
    return value_counts(df, "Predicted_Expiry_Risk")


def velocity_pairs(df: DataFrame) -> DataFrame:
    """Actual against predicted velocity: each distinct point once, with its number of lines."""
    points = df.select("Category", F.col("Sales_Velocity").cast("double"), "Predicted_Sales_Velocity")
    return group_totals(points, points.columns, extra=[F.count(F.lit(1)).alias("row_count")])


def cluster_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("Predicted_Cluster")).agg(F.count(F.lit(1)).alias("row_count")).orderBy("Predicted_Cluster")


# Records handed to the assistant as context

_PRIORITY_FIELDS = (
    "Product_ID", "Product_Name", "Category", "Supplier", "Store_City", "Current_Stock", "Days_To_Expiry",
    "Predicted_Expiry_Risk", "Predicted_Sales_Velocity", "Predicted_Revenue", "Predicted_Revenue_at_Risk",
)


def _as_json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def priority_records(df: DataFrame, n: int = 30, key: str = "Batch_No") -> DataFrame:
    """The lines with most predicted revenue at risk, one JSON record each."""
    fields = [c for c in _PRIORITY_FIELDS if c in df.columns]
    ranked = top(df.select(*fields, key), n, "Predicted_Revenue_at_Risk", "Product_ID", key)
    return ranked.select("Product_ID", key, _as_json(fields).alias("record"))


def recommendation_records(recommendations: DataFrame, n: int = 30) -> DataFrame:
    """The first recommendations in a fixed order, one JSON record each."""
    order = ["Product_ID", "Recommendation_Type", "Business_Reason", "Expected_Revenue_Recovery"]
    order += [c for c in recommendations.columns if c not in order]
    first = recommendations.orderBy(*order).limit(n)
    return first.select("Product_ID", "Recommendation_Type", _as_json(recommendations.columns).alias("record"))
