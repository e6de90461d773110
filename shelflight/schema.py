"""Canonical inventory schema: names, aliases, types, published tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Canonical field -> names it is known by, in matching order.
FIELD_ALIASES: dict[str, list[str]] = {
    "Product_ID": ["product id", "product code", "item id", "item code", "sku id", "barcode", "material code"],
    "SKU": ["sku", "stock keeping unit", "item sku", "product sku"],
    "Product_Name": ["product name", "item name", "description", "material name", "product"],
    "Category": ["category", "product category", "item category", "department", "segment"],
    "Subcategory": ["subcategory", "sub category", "sub-category"],
    "Brand": ["brand", "manufacturer", "make"],
    "Supplier": ["supplier", "vendor", "supplier name", "vendor name"],
    "Store_ID": ["store id", "warehouse id", "location id", "branch id"],
    "Store_City": ["store city", "city", "location", "warehouse", "branch"],
    "Batch_No": ["batch no", "batch number", "lot", "lot number", "batch id"],
    "Purchase_Price": ["purchase price", "cost price", "unit cost", "cost", "buying price", "cogs"],
    "Selling_Price": ["selling price", "sale price", "unit price", "retail price", "mrp", "price"],
    "Current_Stock": ["current stock", "stock quantity", "quantity on hand", "on hand", "inventory", "stock", "qty"],
    "Reorder_Level": ["reorder level", "reorder point", "minimum stock", "min stock", "safety stock"],
    "Daily_Sales": ["daily sales", "sales velocity", "avg daily sales", "average daily demand", "units sold per day"],
    "Weekly_Demand": ["weekly demand", "weekly sales"],
    "Monthly_Demand": ["monthly demand", "monthly sales", "past sales volume", "units sold"],
    "Lead_Time_Days": ["lead time days", "lead time", "supplier lead time"],
    "Manufacturing_Date": ["manufacturing date", "mfg date", "production date", "manufactured on"],
    "Expiry_Date": ["expiry date", "expiration date", "best before", "use by", "shelf life date"],
    "Timestamp": ["timestamp", "date added", "transaction date", "record date", "date"],
    "Discount_%": ["discount", "discount percent", "discount percentage", "markdown"],
    "Customer_Rating": ["customer rating", "rating", "review score"],
}

# Fields without which results rest on defaults, and fields the compatibility score counts.
CORE_FIELDS = ("Product_ID", "Current_Stock", "Purchase_Price", "Selling_Price")
RECOMMENDED_FIELDS = CORE_FIELDS + ("Product_Name", "Category", "Daily_Sales", "Reorder_Level", "Expiry_Date")

# Column types of a cleaned table.
STRING_COLUMNS = (
    "Product_ID", "SKU", "Product_Name", "Category", "Subcategory", "Brand", "Supplier", "Store_ID",
    "Store_City", "Batch_No", "Overstock_Level", "Expiry_Risk", "Recommended_Action", "Promotion_Type",
    "Season", "Holiday", "Weather", "Prediction_Result",
)
INTEGER_COLUMNS = (
    "Days_Remaining", "Current_Stock", "Reorder_Level", "Daily_Sales", "Weekly_Demand", "Monthly_Demand",
    "Lead_Time_Days", "Demand_Forecast",
)
FLOAT_COLUMNS = (
    "Purchase_Price", "Selling_Price", "Revenue_At_Risk", "Discount_%", "Customer_Rating", "Waste_Cost",
    "Recovered_Revenue",
)
DATE_COLUMNS = ("Manufacturing_Date", "Expiry_Date", "Timestamp")

# Numeric columns of the later stages, by the type they have there.
STAGE_INTEGERS = (
    "Stock_Quantity", "Min_Stock_Level", "Past_Sales_Volume", "Days_To_Expiry", "Inventory_Health",
    "Predicted_Inventory_Health", "Predicted_Cluster", "Low_Stock_Flag", "Overstock_Flag", "Reorder_Flag",
)
STAGE_FLOATS = (
    "Cost_Price", "Max_Stock_Level", "Sales_Velocity", "Recoverable_Revenue", "Inventory_Value", "Revenue", "Profit",
    "Profit_Margin", "Inventory_Turnover", "Potential_Sales_Value", "Estimated_Daily_Revenue",
    "Estimated_Daily_Profit", "Profit_Margin_%", "Recovery_Rate_%", "Stock_Coverage_Days",
    "Predicted_Sales_Velocity", "Predicted_Revenue", "Predicted_Revenue_at_Risk", "Expected_Revenue_Recovery",
)

# Fixed values. Same measure, second name: every later stage and the published tables use these.
LEGACY_NAMES: dict[str, str] = {
    "Cost_Price": "Purchase_Price",
    "Stock_Quantity": "Current_Stock",
    "Min_Stock_Level": "Reorder_Level",
    "Max_Stock_Level": "Reorder_Level",
    "Sales_Velocity": "Daily_Sales",
    "Past_Sales_Volume": "Monthly_Demand",
    "Days_To_Expiry": "Days_Remaining",
    "Recoverable_Revenue": "Recovered_Revenue",
}

# The order an ABC class boundary uses among lines of equal value.
LINE_KEY = "Batch_No"

# Spellings of "no value" in files.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _D, _L, _I, _N = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()

PUBLISHED_SCHEMAS: dict[str, T.StructType] = {
    "inventory": _table(
        ("Product_ID", _S, False), ("Product_Name", _S, False), ("Category", _S, True), ("Brand", _S, True),
        ("Supplier", _S, True), ("Cost_Price", _D, True), ("Selling_Price", _D, True),
        ("Stock_Quantity", _L, True), ("Min_Stock_Level", _L, True), ("Max_Stock_Level", _L, True),
        ("Sales_Velocity", _D, True), ("Past_Sales_Volume", _L, True), ("Date_Added", _N, True),
        ("Expiry_Date", _N, True), ("Last_Restock_Date", _N, True), ("Store_Location", _S, True),
        ("Status", _S, True), ("Inventory_Value", _D, True), ("Revenue", _D, True), ("Profit", _D, True),
        ("Profit_Margin", _D, True), ("Demand_Level", _S, True), ("Stock_Status", _S, True),
        ("Expiry_Risk", _S, True), ("Revenue_at_Risk", _D, True), ("Recoverable_Revenue", _D, True),
        ("Inventory_Turnover", _D, True), ("Low_Stock_Flag", _I, True), ("Overstock_Flag", _I, True),
        ("Reorder_Flag", _I, True), ("ABC_Category", _S, True), ("Inventory_Health", _I, True),
    ),
    "predictions": _table(
        ("Product_ID", _S, True), ("Predicted_Expiry_Risk", _S, True), ("Predicted_Sales_Velocity", _D, True),
        ("Predicted_Revenue", _D, True), ("Predicted_Cluster", _I, True), ("Predicted_Revenue_at_Risk", _D, True),
        ("Predicted_Inventory_Health", _I, True), ("Prediction_Date", _N, True),
    ),
    "recommendations": _table(
        ("Product_ID", _S, True), ("Recommendation_Type", _S, True), ("Action", _S, True),
        ("Expected_Revenue_Recovery", _D, True), ("Business_Reason", _S, True), ("Priority_Level", _S, True),
        ("Created_At", _N, True),
    ),
    "revenue": _table(
        ("Product_ID", _S, True), ("Historical_Revenue", _D, True), ("Predicted_Revenue", _D, True),
        ("Report_Date", _N, True),
    ),
}


def type_names(df: DataFrame) -> dict[str, str]:
    """Column name -> simple type name; metadata only, no job runs."""
    return dict(df.dtypes)


def as_date(value: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value
