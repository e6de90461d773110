"""The stages restated as SQL common table expressions.

Written from the rules, not generated from the Spark code, so that it can serve
as an independent statement of the expected results.
"""

from __future__ import annotations

RAW_SQL = """
base AS (
  SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity, l_extendedprice,
    l_discount, l_tax, l_shipdate, p_name, p_brand, p_type, p_size, p_retailprice, s_name, s_nationkey, n_name,
    CAST((l_orderkey * 13 + l_linenumber * 29) % 400 - 20 AS DOUBLE) AS days,
    CAST(20 + 3 * p_size AS DOUBLE) AS reorder_at,
    CAST((l_partkey * 7 + l_suppkey) % 60 AS DOUBLE) AS daily,
    CASE WHEN l_orderkey % 43 = 0 THEN NULL ELSE p_retailprice END AS selling
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey
),
stocked AS (
  SELECT *, CASE WHEN ok % 59 = 0 THEN NULL WHEN ok % 61 = 0 THEN -5e0 WHEN pk % 11 = 0 THEN reorder_at
    ELSE l_quantity * ((ok * 7 + ln) % 40) END AS stock
  FROM base
),
risked AS (SELECT *, CASE WHEN days <= 90 THEN stock * selling ELSE 0e0 END AS at_risk FROM stocked),
single AS (
  SELECT 'PRD' || pk AS "Product_ID", 'SKU-' || pk || '-' || sk AS "SKU",
    CASE WHEN ok % 101 = 0 THEN NULL WHEN ok % 7 = 0 THEN lower(p_name) || '  '
      WHEN ok % 10 = 3 THEN '  ' || upper(p_name) ELSE p_name END AS "Product_Name",
    CASE WHEN ok % 53 = 0 THEN NULL WHEN ok % 9 = 0 THEN lower(p_type) ELSE p_type END AS "Category",
    split_part(p_name, ' ', 2) AS "Subcategory", p_brand AS "Brand",
    CASE WHEN sk % 97 = 5 THEN NULL ELSE s_name END AS "Supplier", 'ST' || s_nationkey AS "Store_ID",
    n_name AS "Store_City",
    'B' || ok || '-' || ln || '-' || pk || '-' || sk || '-'
      || CAST(round_even(l_extendedprice * 100e0, 0) AS BIGINT) AS "Batch_No",
    CASE WHEN ok % 41 = 0 THEN NULL WHEN ok % 37 = 0 THEN 0e0
      ELSE round_even(p_retailprice * (60 + ok % 43), 0) / 100e0 END AS "Purchase_Price",
    selling AS "Selling_Price", reorder_at AS "Reorder_Level", 4e0 * reorder_at AS "Max_Stock_Level",
    stock AS "Current_Stock", 4e0 * reorder_at AS "Overstock_Level", daily AS "Daily_Sales",
    daily * 7 AS "Weekly_Demand", daily * 30 AS "Monthly_Demand",
    CASE WHEN ok % 29 = 0 THEN NULL ELSE daily * 30 + ln END AS "Demand_Forecast",
    CAST(1 + sk % 30 AS DOUBLE) AS "Lead_Time_Days", days AS "Days_Remaining",
    CASE WHEN ok % 71 = 0 THEN 'n/a' WHEN ok % 3 = 0 THEN strftime(DATE '2001-12-01' + CAST(days AS INTEGER), '%Y-%m-%d')
      WHEN ok % 3 = 1 THEN strftime(DATE '2001-12-01' + CAST(days AS INTEGER), '%d/%m/%Y')
      ELSE strftime(DATE '2001-12-01' + CAST(days AS INTEGER), '%Y/%m/%d') END AS "Expiry_Date",
    strftime(CAST(l_shipdate AS DATE) - 30, '%Y-%m-%d') AS "Manufacturing_Date",
    CASE WHEN ok % 83 = 0 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS "Timestamp",
    p_size % 6 + CASE WHEN ok % 67 = 0 THEN 0.5e0 ELSE 0e0 END AS "Customer_Rating",
    round_even(l_discount * 100e0, 0) AS "Discount_%",
    CASE WHEN ok % 31 = 0 THEN NULL WHEN days < 30 THEN 'High' WHEN days <= 90 THEN 'Medium' ELSE 'Low' END
      AS "Expiry_Risk",
    at_risk AS "Revenue_At_Risk",
    CASE ok % 4 WHEN 1 THEN 'none' WHEN 2 THEN 'bogo' WHEN 3 THEN 'flash sale' END AS "Promotion_Type",
    CASE WHEN ok % 89 = 0 THEN NULL WHEN month(l_shipdate) IN (12, 1, 2) THEN 'winter'
      WHEN month(l_shipdate) <= 5 THEN 'spring' WHEN month(l_shipdate) <= 8 THEN 'summer' ELSE 'autumn' END AS "Season",
    CASE WHEN ln % 5 = 0 THEN NULL WHEN ok % 10 = 0 THEN 'yes' ELSE 'no' END AS "Holiday",
    CASE ok % 3 WHEN 1 THEN 'sunny' WHEN 2 THEN 'rain' END AS "Weather",
    CASE pk % 3 WHEN 1 THEN 'normal' WHEN 2 THEN 'discount' END AS "Recommended_Action",
    CASE sk % 3 WHEN 1 THEN 'stable' WHEN 2 THEN 'risk' END AS "Prediction_Result",
    at_risk * l_tax * 10e0 AS "Recovered_Revenue", at_risk * 0.05e0 AS "Waste_Cost", ok
  FROM risked
),
raw AS (SELECT * EXCLUDE (ok) FROM single UNION ALL SELECT * EXCLUDE (ok) FROM single WHERE ok % 33 = 0)"""

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_TEXT = ["Product_Name", "Category", "Subcategory", "Brand", "Supplier", "Store_City", "Expiry_Risk",
         "Recommended_Action", "Promotion_Type", "Season", "Holiday", "Weather", "Prediction_Result"]
_DATES = ["Manufacturing_Date", "Expiry_Date", "Timestamp"]
_WHOLE = ["Days_Remaining", "Current_Stock", "Reorder_Level", "Daily_Sales", "Weekly_Demand", "Monthly_Demand",
          "Lead_Time_Days", "Demand_Forecast"]


def title(column: str) -> str:
    runs = f"regexp_extract_all(lower(trim(\"{column}\", ' \t\n\r')), '([{_CASED}]+|[^{_CASED}]+)', 1)"
    return f"array_to_string(list_transform({runs}, lambda x: upper(x[1:1]) || x[2:]), '')"


def day(column: str) -> str:
    formats = ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y")
    return "coalesce(" + ", ".join(f"try_strptime(\"{column}\", '{f}')" for f in formats) + ")"


CLEAN_SQL = f"""
dedup AS (SELECT DISTINCT * FROM raw),
keyed AS (SELECT * FROM dedup WHERE "Product_ID" IS NOT NULL AND "Product_Name" IS NOT NULL),
priced AS (SELECT * FROM keyed WHERE "Purchase_Price" IS NOT NULL OR "Selling_Price" IS NOT NULL),
purchased AS (
  SELECT * REPLACE (coalesce("Purchase_Price", "Selling_Price" / 1.35e0) AS "Purchase_Price",
    coalesce("Category", 'Other') AS "Category", coalesce("Subcategory", 'Other') AS "Subcategory",
    coalesce("Brand", 'Generic') AS "Brand", coalesce("Supplier", 'Unknown') AS "Supplier",
    coalesce("Store_City", 'Unknown') AS "Store_City", coalesce("Promotion_Type", 'None') AS "Promotion_Type",
    coalesce("Holiday", 'No') AS "Holiday", coalesce("Weather", 'Unknown') AS "Weather",
    coalesce("Prediction_Result", 'Unknown') AS "Prediction_Result",
    coalesce("Recommended_Action", 'Normal') AS "Recommended_Action",
    coalesce("Expiry_Risk", 'Low') AS "Expiry_Risk",
    coalesce("Current_Stock", 0) AS "Current_Stock", coalesce("Demand_Forecast", 0) AS "Demand_Forecast",
    coalesce("Revenue_At_Risk", 0) AS "Revenue_At_Risk", coalesce("Waste_Cost", 0) AS "Waste_Cost",
    coalesce("Recovered_Revenue", 0) AS "Recovered_Revenue", coalesce("Discount_%", 0) AS "Discount_%",
    coalesce("Customer_Rating", 0) AS "Customer_Rating")
  FROM priced
),
filled AS (
  SELECT * REPLACE (coalesce("Selling_Price", "Purchase_Price" * 1.35e0) AS "Selling_Price") FROM purchased
),
valid AS (
  SELECT * FROM filled WHERE "Purchase_Price" > 0 AND "Selling_Price" > 0 AND "Current_Stock" >= 0
    AND "Reorder_Level" >= 0 AND "Daily_Sales" >= 0 AND "Weekly_Demand" >= 0 AND "Monthly_Demand" >= 0
    AND "Lead_Time_Days" >= 0
),
titled AS (SELECT * REPLACE ({', '.join(f'{title(c)} AS "{c}"' for c in _TEXT)}) FROM valid),
parsed AS (SELECT * REPLACE ({', '.join(f'{day(c)} AS "{c}"' for c in _DATES)}) FROM titled),
dated AS (SELECT * FROM parsed WHERE "Manufacturing_Date" IS NOT NULL AND "Expiry_Date" IS NOT NULL),
ruled AS (
  SELECT * FROM dated WHERE "Selling_Price" >= "Purchase_Price" AND "Manufacturing_Date" <= "Expiry_Date"
    AND "Days_Remaining" >= 0 AND "Customer_Rating" BETWEEN 0 AND 5 AND "Discount_%" BETWEEN 0 AND 100
),
cleaned AS (
  SELECT * REPLACE ({', '.join(f'CAST(trunc("{c}") AS BIGINT) AS "{c}"' for c in _WHOLE)},
    CAST("Overstock_Level" AS VARCHAR) AS "Overstock_Level") FROM ruled
)"""


def units(expression: str) -> str:
    """An amount as a whole number of ten-thousandths."""
    return f"CAST(round_even(({expression}) * 10000e0, 0) AS BIGINT)"


def total(expression: str) -> str:
    return f"coalesce(CAST(sum({units(expression)}) AS DOUBLE) / 10000e0, 0e0)"


def mean(expression: str) -> str:
    return (
        f"round_even(CAST(sum({units(expression)}) AS DOUBLE) / 10000e0 / count({expression}), 6)"
    )


def pareto(source: str, value: str = '"Inventory_Value"', key: str = '"Batch_No"') -> str:
    """`source` with the running value, in units, of its lines."""
    return f"""SELECT *, sum(u) OVER (ORDER BY u DESC, md5({key}), {key} ROWS UNBOUNDED PRECEDING) AS running,
      sum(u) OVER () AS grand
    FROM (SELECT *, {units(value)} AS u FROM {source})"""


_CLASS = """CASE WHEN grand {worthless} THEN '{zero}' WHEN running * 100 <= grand * 80 THEN 'A'
    WHEN running * 100 <= grand * 95 THEN 'B' ELSE 'C' END"""

FEATURE_SQL = f"""
valued AS (
  SELECT * REPLACE (coalesce(TRY_CAST("Overstock_Level" AS DOUBLE), 0) AS "Overstock_Level"),
    "Current_Stock" * "Purchase_Price" AS "Inventory_Value", "Daily_Sales" * "Selling_Price" AS "Revenue",
    "Daily_Sales" * ("Selling_Price" - "Purchase_Price") AS "Profit",
    CASE WHEN "Selling_Price" > 0 THEN ("Selling_Price" - "Purchase_Price") / "Selling_Price" * 100 ELSE 0e0 END
      AS "Profit_Margin",
    CASE WHEN "Current_Stock" > 0 THEN "Monthly_Demand" / "Current_Stock" ELSE 0e0 END AS "Inventory_Turnover",
    CASE WHEN "Daily_Sales" >= 50 THEN 'High' WHEN "Daily_Sales" >= 20 THEN 'Medium' ELSE 'Low' END AS "Demand_Level",
    CASE WHEN "Current_Stock" < "Reorder_Level" THEN 'Low Stock'
      WHEN "Current_Stock" > TRY_CAST("Overstock_Level" AS DOUBLE) THEN 'Overstock' ELSE 'Optimal' END AS "Stock_Status",
    "Purchase_Price" AS "Cost_Price", "Current_Stock" AS "Stock_Quantity", "Reorder_Level" AS "Min_Stock_Level",
    "Daily_Sales" AS "Sales_Velocity", "Monthly_Demand" AS "Past_Sales_Volume", "Days_Remaining" AS "Days_To_Expiry",
    "Recovered_Revenue" AS "Recoverable_Revenue"
  FROM cleaned
),
healthy AS (
  SELECT *, CAST(100 - CASE WHEN date_diff('day', DATE '2001-12-01', CAST("Expiry_Date" AS DATE)) < 30 THEN 30 ELSE 0 END
    - CASE WHEN "Stock_Status" IN ('Low Stock', 'Overstock') THEN 20 ELSE 0 END AS BIGINT) AS "Inventory_Health"
  FROM valued
),
ranked AS ({pareto('healthy')}),
engineered AS (SELECT * EXCLUDE (u, running, grand), {_CLASS.format(zero='C', worthless='= 0')} AS "ABC_Category" FROM ranked),
analysis AS (
  SELECT *, "Current_Stock" * "Selling_Price" AS "Potential_Sales_Value",
    "Daily_Sales" * "Selling_Price" AS "Estimated_Daily_Revenue",
    "Daily_Sales" * ("Selling_Price" - "Purchase_Price") AS "Estimated_Daily_Profit",
    CASE WHEN "Selling_Price" > 0 THEN ("Selling_Price" - "Purchase_Price") / "Selling_Price" * 100 ELSE 0e0 END
      AS "Profit_Margin_%",
    CASE WHEN "Revenue_At_Risk" > 0 THEN "Recovered_Revenue" / "Revenue_At_Risk" * 100 ELSE 0e0 END
      AS "Recovery_Rate_%",
    CASE WHEN "Daily_Sales" > 0 THEN "Current_Stock" / "Daily_Sales" ELSE 0e0 END AS "Stock_Coverage_Days"
  FROM healthy
)"""


def cents(expression: str) -> str:
    return f"round_even(({expression}) * 100e0, 0) / 100e0"


SCORE_SQL = f"""
amounts AS (
  SELECT *, "Purchase_Price" AS "Cost_Price", "Current_Stock" AS "Stock_Quantity", "Reorder_Level" AS "Min_Stock_Level",
    "Daily_Sales" AS "Sales_Velocity", "Monthly_Demand" AS "Past_Sales_Volume",
    "Recovered_Revenue" AS "Recoverable_Revenue", "Timestamp" AS "Date_Added", CAST(NULL AS TIMESTAMP) AS "Last_Restock_Date",
    coalesce(date_diff('day', DATE '2001-12-01', CAST("Expiry_Date" AS DATE)), 9999) AS "Days_To_Expiry",
    {cents('"Current_Stock" * "Purchase_Price"')} AS "Inventory_Value",
    {cents('"Monthly_Demand" * "Selling_Price"')} AS "Revenue"
  FROM cleaned
),
profits AS (SELECT *, {cents('"Revenue" - "Past_Sales_Volume" * "Cost_Price"')} AS "Profit" FROM amounts),
margins AS (
  SELECT *, CASE WHEN "Revenue" > 0 THEN round_even("Profit" / "Revenue" * 10000e0, 0) / 10000e0 ELSE 0e0 END
    AS "Profit_Margin" FROM profits
),
score_ranked AS ({pareto('margins')}),
prepared AS (
  SELECT * EXCLUDE (u, running, grand), {_CLASS.format(zero='A', worthless='<= 0')} AS "ABC_Category" FROM score_ranked
),
guessed AS (
  SELECT *, "Expiry_Risk" AS "Predicted_Expiry_Risk", CAST("Sales_Velocity" AS DOUBLE) AS "Predicted_Sales_Velocity",
    {cents('"Revenue"')} AS "Predicted_Revenue", CAST(NULL AS INTEGER) AS "Predicted_Cluster"
  FROM prepared
),
scored AS (
  SELECT *, CASE WHEN "Predicted_Expiry_Risk" IN ('High', 'Medium')
      THEN {cents('"Stock_Quantity" * "Selling_Price"')} ELSE 0e0 END AS "Predicted_Revenue_at_Risk",
    CAST(least(greatest(100
      - CASE WHEN "Stock_Quantity" <= "Min_Stock_Level" OR "Stock_Quantity" >= "Max_Stock_Level" THEN 20 ELSE 0 END
      - CASE "Predicted_Expiry_Risk" WHEN 'High' THEN 40 WHEN 'Medium' THEN 20 ELSE 0 END
      - CASE WHEN "Predicted_Sales_Velocity" * 365 / ("Stock_Quantity" + 1) < 1 THEN 10 ELSE 0 END, 0), 100) AS INTEGER)
      AS "Predicted_Inventory_Health"
  FROM guessed
)"""

_HEAD = '"Product_ID", "Product_Name", "Category", "Supplier", "Store_City" AS "Store_Location"'
_STOCK, _LOW = 'CAST("Stock_Quantity" AS VARCHAR)', 'CAST("Min_Stock_Level" AS VARCHAR)'
_HIGH = "printf('%.1f', \"Max_Stock_Level\")"
_PACE = "printf('%.1f', \"Predicted_Sales_Velocity\")"
_SHORT = 'CAST(CAST(trunc("Max_Stock_Level" - "Stock_Quantity") AS BIGINT) AS VARCHAR)'
_EXCESS = 'CAST(CAST(trunc("Stock_Quantity" - "Max_Stock_Level") AS BIGINT) AS VARCHAR)'


def rounded(expression: str) -> str:
    """Two decimals from the exact binary value."""
    return f"CAST(printf('%.2f', {expression}) AS DOUBLE)"


def _advice(kind: str, action: str, amount: str, reason: str, priority: str, condition: str) -> str:
    return (
        f"SELECT {_HEAD}, '{kind} Recommendation' AS \"Recommendation_Type\", {action} AS \"Action\", "
        f"{rounded(amount)} AS \"Expected_Revenue_Recovery\", {reason} AS \"Business_Reason\", "
        f"{priority} AS \"Priority_Level\" FROM scored WHERE {condition}"
    )


_TARGET = "CASE WHEN \"Store_City\" <> 'Store Front East' THEN 'Store Front East' ELSE 'Warehouse A' END"

ADVICE_SQL = "\nadvice AS (\n" + "\nUNION ALL\n".join(
    [
        _advice(
            "Discount", "'Apply 40% Liquidating Discount'", '"Stock_Quantity" * "Selling_Price" * 0.6e0',
            "'Product has HIGH expiry risk (expiring in <30 days). A 40% discount will accelerate sales velocity from ' "
            f"|| {_PACE} || '/day to liquidate stock before absolute loss.'",
            "'High'", "\"Predicted_Expiry_Risk\" = 'High'",
        ),
        _advice(
            "Discount", "'Apply 20% Promotional Discount'", '"Stock_Quantity" * "Selling_Price" * 0.8e0',
            "'Product has MEDIUM expiry risk (expiring in 31-90 days). A 20% discount is recommended to stimulate "
            "demand and protect margins.'",
            "'Medium'", "\"Predicted_Expiry_Risk\" = 'Medium'",
        ),
        _advice(
            "Reorder", f"'Restock ' || {_SHORT} || ' Units'",
            'CAST(trunc("Max_Stock_Level" - "Stock_Quantity") AS BIGINT) * "Selling_Price" * 0.9e0',
            f"'Stock level (' || {_STOCK} || ') is below reorder point (' || {_LOW} || '). Restocking ' || {_SHORT} "
            f"|| ' units is critical to prevent stockouts and capture projected demand of ' || {_PACE} || '/day.'",
            "CASE WHEN \"Predicted_Sales_Velocity\" >= 5 THEN 'High' ELSE 'Medium' END",
            '"Stock_Quantity" <= "Min_Stock_Level"',
        ),
        _advice(
            "Overstock", "'Run Overstock Clearance Campaign'",
            'CAST(trunc("Stock_Quantity" - "Max_Stock_Level") AS BIGINT) * "Selling_Price" * 0.75e0',
            f"'Stock level (' || {_STOCK} || ') exceeds warehouse capacity (' || {_HIGH} || '). Recommend clearing "
            f"excess ' || {_EXCESS} || ' units at 25% discount to free up warehouse space and capital.'",
            "'Medium'", '"Stock_Quantity" >= "Max_Stock_Level"',
        ),
        _advice(
            "Transfer", f"'Transfer ' || {_EXCESS} || ' Units to ' || {_TARGET}",
            'CAST(trunc("Stock_Quantity" - "Max_Stock_Level") AS BIGINT) * "Cost_Price"',
            f"'Product is overstocked locally in ' || \"Store_City\" || '. Transferring excess ' || {_EXCESS} "
            f"|| ' units to ' || {_TARGET} || ' optimizes stock distribution and reduces storage carrying costs.'",
            "'Medium'", '"Stock_Quantity" >= "Max_Stock_Level"',
        ),
        _advice(
            "Supplier", "'Evaluate Lead Time Agreement / Vendor SLA'", '"Cost_Price" * "Stock_Quantity" * 0.05e0',
            f"'Product has high sales velocity (' || {_PACE} || '/day) and is frequently low in stock. Recommend "
            "renegotiating lead-time agreements with ' || \"Supplier\" || ' to build safety stock buffers.'",
            "'Low'", '"Stock_Quantity" <= "Min_Stock_Level" AND "Predicted_Sales_Velocity" >= 8',
        ),
        _advice(
            "Purchase Planning", "'Establish Bulk Purchase Contract'", '"Predicted_Revenue" * 0.12e0',
            "'High demand product forecasted to generate ' || printf('%.2f', \"Predicted_Revenue\") || ' in revenue. "
            "Lock in bulk-purchase contracts with ' || \"Supplier\" || ' to lower unit costs by 10-15%.'",
            "'High'", '"Predicted_Sales_Velocity" >= 12',
        ),
    ]
) + "\n)"

STAGES = "WITH" + ",".join([RAW_SQL, CLEAN_SQL, FEATURE_SQL, SCORE_SQL, ADVICE_SQL])


def over_stages(select: str) -> str:
    return f"{STAGES}\n{select}"
