"""Prescriptive recommendations and the business impact summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import (
    contains_literal,
    decimal_round,
    first_non_empty,
    fixed_point,
    half_even,
    number_text,
    to_number,
    truncate_to_long,
)
from shelflight.functions.numeric import sum_large, sum_units, units_to_amount
from shelflight.operators.features import alias_if_missing
from shelflight.schema import LEGACY_NAMES, type_names

# Names a scored or cleaned table may use for what the rules read.
_FALLBACK_NAMES = {
    **{k: v for k, v in LEGACY_NAMES.items() if k not in ("Days_To_Expiry", "Recoverable_Revenue")},
    "Predicted_Sales_Velocity": "Sales_Velocity",
    "Predicted_Revenue": "Revenue",
    "Predicted_Revenue_at_Risk": "Revenue_At_Risk",
    "Predicted_Expiry_Risk": "Expiry_Risk",
    "Store_Location": "Store_City",
}

# Share of the at-risk value that the markdown recovers.
RECOVERY_RATES = {"High": 0.60, "Medium": 0.80}
RECOVERY_METHOD = "Expiry-risk value after recommended markdown; capped at revenue at risk"

_MAIN_TARGET, _OTHER_TARGET = "Store Front East", "Warehouse A"


def conform(df: DataFrame) -> DataFrame:
    """Every column the rules read, under one name, without nulls."""
    df = alias_if_missing(df.toDF(*[c.strip() for c in df.columns]), _FALLBACK_NAMES)
    kinds = type_names(df)
    for name in ("Stock_Quantity", "Min_Stock_Level", "Cost_Price", "Selling_Price",
                 "Predicted_Sales_Velocity", "Predicted_Revenue", "Predicted_Revenue_at_Risk"):
        value = to_number(F.col(name), kinds[name]) if name in kinds else F.lit(0)
        df = df.withColumn(name, F.coalesce(value, F.lit(0)))
    minimum = F.col("Min_Stock_Level")
    maximum = to_number(F.col("Max_Stock_Level"), kinds["Max_Stock_Level"]) if "Max_Stock_Level" in kinds else minimum
    risk = F.col("Predicted_Expiry_Risk") if "Predicted_Expiry_Risk" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("Max_Stock_Level", F.coalesce(maximum, minimum))
    return df.withColumn("Predicted_Expiry_Risk", F.coalesce(risk, F.lit("No Risk")))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _entry(kind: str, action: Column | str, recovery: Column, reason: Column | str, priority: Column | str) -> Column:
    def column(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return F.struct(
        F.lit(kind).alias("Recommendation_Type"),
        column(action).alias("Action"),
        recovery.cast("double").alias("amount"),
        column(reason).alias("Business_Reason"),
        column(priority).alias("Priority_Level"),
    )


def _candidates(df: DataFrame) -> list[tuple[Column, Column]]:
    """(condition, recommendation) per rule; a row may meet several."""
    kinds = type_names(df)
    stock, low, high = F.col("Stock_Quantity"), F.col("Min_Stock_Level"), F.col("Max_Stock_Level")
    cost, price = F.col("Cost_Price"), F.col("Selling_Price")
    velocity, revenue = F.col("Predicted_Sales_Velocity"), F.col("Predicted_Revenue")
    risk, location, supplier = F.col("Predicted_Expiry_Risk"), F.col("_location"), F.col("_supplier")

    stock_text = number_text(stock, kinds["Stock_Quantity"])
    low_text = number_text(low, kinds["Min_Stock_Level"])
    high_text = number_text(high, kinds["Max_Stock_Level"])
    pace = fixed_point(velocity, 1)
    missing = truncate_to_long(high - stock)
    excess = truncate_to_long(stock - high)
    target = F.when(location != _MAIN_TARGET, _MAIN_TARGET).otherwise(_OTHER_TARGET)

    # Wording, thresholds and rates of the rules.
    return [
        (
            risk == "High",
            _entry(
                "Discount Recommendation", "Apply 40% Liquidating Discount", stock * price * 0.6,
                _text("Product has HIGH expiry risk (expiring in <30 days). A 40% discount will accelerate sales "
                      "velocity from ", pace, "/day to liquidate stock before absolute loss."),
                "High",
            ),
        ),
        (
            risk == "Medium",
            _entry(
                "Discount Recommendation", "Apply 20% Promotional Discount", stock * price * 0.8,
                "Product has MEDIUM expiry risk (expiring in 31-90 days). A 20% discount is recommended to "
                "stimulate demand and protect margins.",
                "Medium",
            ),
        ),
        (
            stock <= low,
            _entry(
                "Reorder Recommendation", _text("Restock ", missing.cast("string"), " Units"), missing * price * 0.9,
                _text("Stock level (", stock_text, ") is below reorder point (", low_text, "). Restocking ",
                      missing.cast("string"), " units is critical to prevent stockouts and capture projected "
                      "demand of ", pace, "/day."),
                F.when(velocity >= 5.0, "High").otherwise("Medium"),
            ),
        ),
        (
            stock >= high,
            _entry(
                "Overstock Recommendation", "Run Overstock Clearance Campaign", excess * price * 0.75,
                _text("Stock level (", stock_text, ") exceeds warehouse capacity (", high_text, "). Recommend "
                      "clearing excess ", excess.cast("string"), " units at 25% discount to free up warehouse "
                      "space and capital."),
                "Medium",
            ),
        ),
        (
            stock >= high,
            _entry(
                "Transfer Recommendation", _text("Transfer ", excess.cast("string"), " Units to ", target),
                excess * cost,
                _text("Product is overstocked locally in ", location, ". Transferring excess ",
                      excess.cast("string"), " units to ", target, " optimizes stock distribution and reduces "
                      "storage carrying costs."),
                "Medium",
            ),
        ),
        (
            (stock <= low) & (velocity >= 8.0),
            _entry(
                "Supplier Recommendation", "Evaluate Lead Time Agreement / Vendor SLA", cost * stock * 0.05,
                _text("Product has high sales velocity (", pace, "/day) and is frequently low in stock. Recommend "
                      "renegotiating lead-time agreements with ", supplier, " to build safety stock buffers."),
                "Low",
            ),
        ),
        (
            velocity >= 12.0,
            _entry(
                "Purchase Planning Recommendation", "Establish Bulk Purchase Contract", revenue * 0.12,
                _text("High demand product forecasted to generate ", fixed_point(revenue, 2), " in revenue. Lock "
                      "in bulk-purchase contracts with ", supplier, " to lower unit costs by 10-15%."),
                "High",
            ),
        ),
    ]


def recommend(df: DataFrame) -> DataFrame:
    """Zero to six recommendations per row. Narrow: one array per row, exploded in place."""
    df = conform(df)
    places = [F.col(c) for c in ("Store_Location", "Store_City", "Store_ID") if c in df.columns]
    supplier = F.col("Supplier") if "Supplier" in df.columns else F.lit("Unknown Supplier")
    df = df.withColumns(
        {
            "_location": first_non_empty(places, "Unknown Location"),
            "_supplier": F.coalesce(supplier, F.lit("Unknown Supplier")),
        }
    )
    entries = F.array_compact(F.array(*[F.when(condition, entry) for condition, entry in _candidates(df)]))
    return (
        df.select(
            "Product_ID", "Product_Name", "Category", F.col("_supplier").alias("Supplier"),
            F.col("_location").alias("Store_Location"), F.inline(entries),
        )
        .withColumn("Expected_Revenue_Recovery", decimal_round(F.col("amount"), 2))
        .select(
            "Product_ID", "Product_Name", "Category", "Supplier", "Store_Location", "Recommendation_Type",
            "Action", "Expected_Revenue_Recovery", "Business_Reason", "Priority_Level",
        )
    )


def impact_summary(df: DataFrame) -> DataFrame:
    """One row of KPIs in one pass.

    Totals are formed per product first, then overall, so the distinct counts
    need no second copy of the rows and a frequent product merges map-side.
    """
    df = conform(df)
    names = type_names(df)
    reported = next((c for c in ("Recovered_Revenue", "Recoverable_Revenue") if c in names), None)
    recovered = to_number(F.col(reported), names[reported], 0.0) if reported else F.lit(0.0)
    risk_kind, at_risk = F.col("Predicted_Expiry_Risk"), F.col("Predicted_Revenue_at_Risk")
    positive_risk = F.greatest(at_risk, F.lit(0.0))
    rate = F.lit(0.0)
    for kind, share in RECOVERY_RATES.items():
        rate = F.when(risk_kind == kind, F.lit(share)).otherwise(rate)
    urgent = (risk_kind == "High") | (F.col("Stock_Quantity") <= F.col("Min_Stock_Level"))
    health = F.col("Predicted_Inventory_Health")
    amounts = {
        "risk": at_risk, "expected": positive_risk * rate, "recovered": F.least(F.greatest(recovered, F.lit(0.0)), positive_risk),
    }
    per_product = df.groupBy("Product_ID").agg(
        F.max(urgent).alias("urgent"),
        *[sum_units(amount).alias(name) for name, amount in amounts.items()],
        *[sum_large(amount).alias(f"large_{name}") for name, amount in amounts.items()],
        F.sum(health.cast("bigint")).alias("health"),
        F.count(health).alias("lines"),
    )

    def total(name: str) -> Column:
        large = F.coalesce(F.sum(f"large_{name}"), F.lit(0.0))
        return (F.coalesce(units_to_amount(F.sum(name)), F.lit(0.0)) + large).alias(name)

    totals = per_product.agg(
        F.count(F.lit(1)).alias("Products_Analysed"),
        F.count_if("urgent").alias("High_Risk_Products"),
        total("risk"), total("expected"), total("recovered"),
        F.try_divide(F.sum("health"), F.sum("lines")).alias("health"),
    )
    risk = F.col("risk")
    expected, recovered = F.least(F.col("expected"), risk), F.least(F.col("recovered"), risk)
    reduction = F.when(risk > 0, expected / risk * 100).otherwise(F.lit(0.0))
    return totals.select(
        "Products_Analysed",
        "High_Risk_Products",
        half_even(risk, 2).alias("Revenue_at_Risk"),
        decimal_round(recovered, 2).alias("Actual_Recovered_Revenue"),
        decimal_round(expected, 2).alias("Expected_Recovery"),
        reduction.alias("Estimated_Waste_Reduction_Pct"),
        half_even(F.col("health"), 2).alias("Overall_Inventory_Health_Pct"),
        F.lit(RECOVERY_METHOD).alias("Recovery_Method"),
    )


def filter_queue(
    recommendations: DataFrame,
    kind: str | None = None,
    priority: str | None = None,
    categories: list[str] | None = None,
    suppliers: list[str] | None = None,
    search: str = "",
) -> DataFrame:
    """The work queue: each filter applies only when it is set."""
    out = recommendations
    if kind:
        out = out.filter(F.col("Recommendation_Type") == kind)
    if priority:
        out = out.filter(F.col("Priority_Level") == priority)
    if categories:
        out = out.filter(F.col("Category").isin(categories))
    if suppliers:
        out = out.filter(F.col("Supplier").isin(suppliers))
    if search.strip():
        out = out.filter(
            contains_literal(F.col("Product_ID"), search) | contains_literal(F.col("Product_Name"), search)
        )
    return out.select(
        "Product_ID", "Product_Name", "Recommendation_Type", "Action", "Expected_Revenue_Recovery",
        "Priority_Level", "Business_Reason",
    )
