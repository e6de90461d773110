"""Cleaning: duplicates, missing values, invalid records, text, dates, rules, types.

Every step is a row-local expression or filter, so the whole chain after the
duplicate removal is one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import nan_to_null, parse_timestamp, strip_whitespace, title_case, truncate_to_long
from shelflight.functions.numeric import to_number
from shelflight.operators.quality import row_digest
from shelflight.schema import (
    DATE_COLUMNS, FLOAT_COLUMNS, INTEGER_COLUMNS, STAGE_FLOATS, STAGE_INTEGERS, STRING_COLUMNS, type_names,
)
from shelflight.session import code_boundary, written

# What a missing category is filled with.
CATEGORY_FILLS = {
    "Category": "Other",
    "Subcategory": "Other",
    "Brand": "Generic",
    "Supplier": "Unknown",
    "Store_City": "Unknown",
    "Promotion_Type": "None",
    "Holiday": "No",
    "Weather": "Unknown",
    "Prediction_Result": "Unknown",
    "Recommended_Action": "Normal",
    "Expiry_Risk": "Low",
    "Overstock_Level": "Low",
}

# Numbers whose absence means none.
ZERO_FILLS = (
    "Current_Stock", "Reorder_Level", "Daily_Sales", "Weekly_Demand", "Monthly_Demand", "Demand_Forecast",
    "Revenue_At_Risk", "Waste_Cost", "Recovered_Revenue", "Discount_%", "Customer_Rating",
)

# Text columns in title case.
TITLE_CASED = (
    "Product_Name", "Category", "Subcategory", "Brand", "Supplier", "Store_City", "Overstock_Level",
    "Expiry_Risk", "Recommended_Action", "Promotion_Type", "Season", "Holiday", "Weather", "Prediction_Result",
)

# Two hashes of a row.
DIGEST = ("_row_0", "_row_1")
# Bits of the bitmap that tells rows with copies, as powers of two: one block of 4 KB at least, 32 MB at most.
_LEAST_BITS, _MOST_BITS = 15, 28

# Fixed value: selling price over purchase price where one is missing.
MARKUP = 1.35


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """One notion of "missing" for all later comparisons."""
    floats = [name for name, kind in df.dtypes if kind in ("float", "double")]
    return df.withColumns({name: nan_to_null(F.col(name)) for name in floats})


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates, nulls equal. Copies merge on the map side, so a row that
    makes up a large part of the table reaches the shuffle once per task."""
    return df.dropDuplicates()


def drop_duplicate_rows_stored(df: DataFrame) -> DataFrame:
    """The same for tables of which most columns are read: rows are stored once, and few are shuffled. Runs jobs."""
    apart = df.transform(_apart)
    return one_of_each(apart.select("*", *_digest(apart)), *DIGEST)


def _digest(df: DataFrame) -> list[Column]:
    return [part.alias(name) for part, name in zip(row_digest(df), DIGEST, strict=True)]


def one_of_each(rows: DataFrame, one: str, two: str) -> DataFrame:
    """One row of each pair of digests, without the digests. Runs jobs.

    All rows are stored once. Their first digests alone are shuffled, to find those that several rows have; these mark
    bits of a bitmap, which is broadcast. A row whose bit is free has no copy and stays where it is. Only the others
    (copies, and the few rows that share a bit with some) are shuffled, merged on the map side and stored as well. The
    bitmap has 32 bits for each digest found, 32 MB at most: beyond that more rows are shuffled, with the same result.
    """
    rows = written(rows, "rows")
    several = rows.groupBy(one).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = written(several.select(one), "several")
    number = several.count()
    if not number:
        return rows.drop(one, two)
    size = min(max(_LEAST_BITS, (32 * number - 1).bit_length()), _MOST_BITS)
    spot = F.col(one).bitwiseAND(F.lit((1 << size) - 1))  # a digest is a hash
    block, bit = F.shiftright(spot, 15), spot.bitwiseAND(F.lit(32767))
    marks = written(several.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bits")), "marks")
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    copied = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    placed = rows.withColumn("_block", block).join(F.broadcast(marks), "_block", "left")
    merged = written(placed.filter(copied).drop("_block", "_bits").dropDuplicates([one, two]), "merged")
    return placed.filter(~copied).select(*rows.columns).unionByName(merged).drop(one, two)


def _fills(df: DataFrame) -> dict[str, Column]:
    """Defaults and estimated prices, all from the columns as they come.

    Where the selling price is missing the purchase price is not, so neither
    estimate depends on the other one.
    """
    names = type_names(df)
    purchase, selling = F.col("Purchase_Price"), F.col("Selling_Price")
    fills = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in CATEGORY_FILLS.items() if names.get(c) == "string"}
    fills |= {c: F.coalesce(F.col(c), F.lit(0).cast(names[c])) for c in ZERO_FILLS if c in names}
    fills["Purchase_Price"] = F.coalesce(purchase, selling / MARKUP)
    fills["Selling_Price"] = F.coalesce(selling, purchase * MARKUP)
    return fills


def fill_missing(df: DataFrame) -> DataFrame:
    """Rows need an id, a name and a price; everything else gets a default."""
    kept = df.dropna(how="any", subset=["Product_ID", "Product_Name"])
    kept = kept.dropna(how="all", subset=["Purchase_Price", "Selling_Price"])
    return kept.withColumns(_fills(df))


def _valid_values() -> Column:
    valid = (F.col("Purchase_Price") > 0) & (F.col("Selling_Price") > 0)
    for name in ("Current_Stock", "Reorder_Level", "Daily_Sales", "Weekly_Demand", "Monthly_Demand", "Lead_Time_Days"):
        valid = valid & (F.col(name) >= 0)
    return valid


def drop_invalid(df: DataFrame) -> DataFrame:
    """Prices above zero, quantities and lead time not below; null fails."""
    return df.filter(_valid_values())


def standardize_text(df: DataFrame) -> DataFrame:
    names = type_names(df)
    return df.withColumns(
        {c: title_case(strip_whitespace(F.col(c))) for c in TITLE_CASED if names.get(c) == "string"}
    )


def _parsed_dates(df: DataFrame) -> DataFrame:
    names = type_names(df)
    return df.withColumns({c: parse_timestamp(F.col(c), names[c], day_first=True) for c in DATE_COLUMNS})


def _dates_present() -> Column:
    return F.col("Manufacturing_Date").isNotNull() & F.col("Expiry_Date").isNotNull()


def convert_dates(df: DataFrame) -> DataFrame:
    """Day-first parse; rows need both product dates, the record date may be null."""
    return df.transform(_parsed_dates).filter(_dates_present())


def _business_rules() -> Column:
    return (
        (F.col("Selling_Price") >= F.col("Purchase_Price"))
        & (F.col("Manufacturing_Date") <= F.col("Expiry_Date"))
        & (F.col("Days_Remaining") >= 0)
        & F.col("Customer_Rating").between(0, 5)
        & F.col("Discount_%").between(0, 100)
    )


def apply_business_rules(df: DataFrame) -> DataFrame:
    return df.filter(_business_rules())


def cast_types(df: DataFrame) -> DataFrame:
    names = type_names(df)
    casts: dict[str, Column] = {c: F.col(c).cast("string") for c in STRING_COLUMNS if c in names}
    casts |= {c: truncate_to_long(F.col(c)) for c in INTEGER_COLUMNS if c in names}
    casts |= {c: F.col(c).cast("double") for c in FLOAT_COLUMNS if c in names}
    return df.withColumns(casts)


def numbers_from_text(df: DataFrame) -> DataFrame:
    """Typed numbers for a table of any stage read as text; what is no number becomes null.

    Raw quantities may have decimals and stay double until cleaning truncates them. A whole column of a later
    stage becomes a whole number again if its files say so: one that no later stage has written stays double.
    """
    names = type_names(df)
    wanted = [c for c in (*INTEGER_COLUMNS, *FLOAT_COLUMNS, *STAGE_INTEGERS, *STAGE_FLOATS) if names.get(c) == "string"]
    later = "Predicted_Revenue" in names or "Inventory_Value" in names
    whole = {*STAGE_INTEGERS, *INTEGER_COLUMNS} if later else set()
    return df.withColumns(
        {c: F.floor(to_number(F.col(f"`{c}`"), "string")).cast("bigint") if c in whole else to_number(F.col(f"`{c}`"), "string") for c in wanted}
    )


def _apart(df: DataFrame) -> DataFrame:
    return df if df.isStreaming else code_boundary(df)


def _cleaned_copies(df: DataFrame) -> DataFrame:
    """The cleaned rows, duplicates included, with the digest of each row as it came."""
    raw = df.transform(_apart).transform(numbers_from_text).transform(nulls_for_nan)
    return (
        raw.select("*", *_digest(raw))
        .transform(fill_missing)
        .transform(drop_invalid)
        .transform(standardize_text)
        .transform(convert_dates)
        .transform(apply_business_rules)
        .transform(cast_types)
    )


def clean(df: DataFrame) -> DataFrame:
    """All steps in order, as one lazy plan with one shuffle (the duplicates).

    Every other step looks at one row, so copies come out alike. Duplicates are therefore dropped last, by a digest
    of the row as it came: only rows that pass every rule are sent, and of these only the columns that are read.
    The digest reads every column, so a boundary before it costs no column that could be left out.
    """
    return _cleaned_copies(df).dropDuplicates([*DIGEST]).drop(*DIGEST)


def clean_stored(df: DataFrame) -> DataFrame:
    """The same rows, stored, for tables that are read with most of their columns or more than once. Runs jobs.

    Whole rows are written once as Parquet, a fraction of what they take in a shuffle, and only copies are shuffled.
    """
    return one_of_each(_cleaned_copies(df), *DIGEST)


def cleaning_audit(df: DataFrame) -> DataFrame:
    """Rows removed per step, and rows kept, in one pass over the data.

    Distinct rows carry their number of copies and are tagged with the first
    step that would remove them, instead of counting the table between steps.
    """
    raw = df.transform(numbers_from_text).transform(nulls_for_nan)
    distinct = raw.groupBy(*[F.col(f"`{c}`") for c in raw.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    no_key = F.col("Product_ID").isNull() | F.col("Product_Name").isNull()
    no_price = F.col("Purchase_Price").isNull() & F.col("Selling_Price").isNull()
    reason = (
        F.when(F.col("_no_key"), "missing_key")
        .when(F.col("_no_price"), "missing_price")
        .when(~F.coalesce(_valid_values(), F.lit(False)), "invalid_value")
        .when(~_dates_present(), "invalid_date")
        .when(~F.coalesce(_business_rules(), F.lit(False)), "business_rule")
        .otherwise("kept")
    )
    tagged = (
        distinct.withColumns({"_no_key": no_key, "_no_price": no_price, **_fills(raw)})
        .transform(_parsed_dates)
        .select(reason.alias("step"), "_copies")
    )
    extra_copies = F.struct(F.lit("duplicate").alias("step"), (F.col("_copies") - 1).alias("n"))
    own_row = F.struct(F.col("step"), F.lit(1).cast("bigint").alias("n"))
    return (
        tagged.select(F.inline(F.array(own_row, extra_copies)))
        .groupBy("step")
        .agg(F.sum("n").alias("row_count"))
    )
