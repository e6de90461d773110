"""Inventory lines over a star schema of order lines, parts and suppliers.

One line item joined to its part and supplier is one inventory line. The rules
are integer arithmetic on the keys and plant the defects that cleaning has to
handle: missing values, bad prices, mixed date spellings, exact duplicates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(2001, 12, 1)

_PRICE_AND_KEYS = {
    "Product_ID": "product_id",
    "SKU": "concat('SKU-', l_partkey, '-', l_suppkey)",
    "Product_Name": """case when l_orderkey % 101 = 0 then null
        when l_orderkey % 7 = 0 then name_lower when l_orderkey % 10 = 3 then name_upper else p_name end""",
    "Category": "case when l_orderkey % 53 = 0 then null when l_orderkey % 9 = 0 then type_lower else p_type end",
    "Subcategory": "second_word",
    "Brand": "p_brand",
    "Supplier": "case when l_suppkey % 97 = 5 then null else s_name end",
    "Store_ID": "store_id",
    "Store_City": "n_name",
    "Batch_No": """concat('B', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
        cast(rint(l_extendedprice * 100e0) as bigint))""",
    "Purchase_Price": """case when l_orderkey % 41 = 0 then null when l_orderkey % 37 = 0 then 0e0
        else rint(p_retailprice * (60 + l_orderkey % 43)) / 100e0 end""",
    "Selling_Price": "case when l_orderkey % 43 = 0 then null else p_retailprice end",
    "Reorder_Level": "cast(20 + 3 * p_size as double)",
    "Max_Stock_Level": "cast(4 * (20 + 3 * p_size) as double)",
    "Current_Stock": """case when l_orderkey % 59 = 0 then null when l_orderkey % 61 = 0 then -5e0
        when l_partkey % 11 = 0 then cast(20 + 3 * p_size as double)
        else l_quantity * ((l_orderkey * 7 + l_linenumber) % 40) end""",
    "Overstock_Level": "cast(4 * (20 + 3 * p_size) as double)",
    "Daily_Sales": "cast((l_partkey * 7 + l_suppkey) % 60 as double)",
    "Weekly_Demand": "cast((l_partkey * 7 + l_suppkey) % 60 * 7 as double)",
    "Monthly_Demand": "cast((l_partkey * 7 + l_suppkey) % 60 * 30 as double)",
    "Demand_Forecast": """case when l_orderkey % 29 = 0 then null
        else cast((l_partkey * 7 + l_suppkey) % 60 * 30 + l_linenumber as double) end""",
    "Lead_Time_Days": "cast(1 + l_suppkey % 30 as double)",
    "Days_Remaining": "cast((l_orderkey * 13 + l_linenumber * 29) % 400 - 20 as double)",
}

_DETAILS = {
    "Expiry_Date": """case when l_orderkey % 71 = 0 then 'n/a' when l_orderkey % 3 = 0 then expiry
        when l_orderkey % 3 = 1 then concat(substr(expiry, 9, 2), '/', substr(expiry, 6, 2), '/', left(expiry, 4))
        else replace(expiry, '-', '/') end""",
    "Manufacturing_Date": "cast(date_sub(cast(l_shipdate as date), 30) as string)",
    "Timestamp": "case when l_orderkey % 83 = 0 then null else cast(cast(l_shipdate as date) as string) end",
    "Customer_Rating": "p_size % 6 + case when l_orderkey % 67 = 0 then 0.5e0 else 0e0 end",
    "Discount_%": "rint(l_discount * 100e0)",
    "Expiry_Risk": """case when l_orderkey % 31 = 0 then null when Days_Remaining < 30 then 'High'
        when Days_Remaining <= 90 then 'Medium' else 'Low' end""",
    "Revenue_At_Risk": "case when Days_Remaining <= 90 then Current_Stock * Selling_Price else 0e0 end",
    "Promotion_Type": "element_at(array(null, 'none', 'bogo', 'flash sale'), cast(l_orderkey % 4 + 1 as int))",
    "Season": """case when l_orderkey % 89 = 0 then null when month(l_shipdate) in (12, 1, 2) then 'winter'
        when month(l_shipdate) <= 5 then 'spring' when month(l_shipdate) <= 8 then 'summer' else 'autumn' end""",
    "Holiday": "case when l_linenumber % 5 = 0 then null when l_orderkey % 10 = 0 then 'yes' else 'no' end",
    "Weather": "element_at(array(null, 'sunny', 'rain'), cast(l_orderkey % 3 + 1 as int))",
    "Recommended_Action": "element_at(array(null, 'normal', 'discount'), cast(l_partkey % 3 + 1 as int))",
    "Prediction_Result": "element_at(array(null, 'stable', 'risk'), cast(l_suppkey % 3 + 1 as int))",
}

_FROM_RISK = {
    "Recovered_Revenue": "Revenue_At_Risk * l_tax * 10e0",
    "Waste_Cost": "Revenue_At_Risk * 0.05e0",
}


def inventory_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """Raw inventory table with every 33rd order's lines present twice.

    Only `nation`, 25 rows by definition, is broadcast by hint. Parts and
    suppliers grow with the data, so their join strategy is left to the
    statistics and to adaptive execution, skewed keys included. `nation` is
    joined last: suppliers then keep the size of their file as an estimate. The
    number of partitions follows the data, so that no task grows with it.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{data_dir}/{name}.parquet")

    nation = table("nation").select("n_nationkey", "n_name")
    supplier = table("supplier").select(
        "s_suppkey", "s_name", "s_nationkey", F.expr("concat('ST', s_nationkey)").alias("store_id")
    )
    part = table("part").selectExpr(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "concat('PRD', p_partkey) product_id",
        "concat(lower(p_name), '  ') name_lower", "concat('  ', upper(p_name)) name_upper",
        "split_part(p_name, ' ', 2) second_word", "lower(p_type) type_lower",
    )
    expiry = F.expr("cast(date_add(date'2001-12-01', cast(Days_Remaining as int)) as string)")
    lines = (
        table("lineitem").repartition("l_orderkey", "l_linenumber")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumns({name: F.expr(rule) for name, rule in _PRICE_AND_KEYS.items()})
        .withColumn("expiry", expiry)
        .withColumns({name: F.expr(rule) for name, rule in _DETAILS.items()})
        .withColumns({name: F.expr(rule) for name, rule in _FROM_RISK.items()})
    )
    # The copies are made of finished rows. Cleaning then works on the values, as
    # it would on a stored table, and not on the rules that made them.
    names = [*_PRICE_AND_KEYS, *_DETAILS, *_FROM_RISK]
    row = F.struct(*names)
    return lines.select(F.inline(F.when(F.expr("l_orderkey % 33 = 0"), F.array(row, row)).otherwise(F.array(row))))
