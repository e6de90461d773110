"""Every registered query with the SQL that states its result, side by side."""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.sql import mean, over_stages, rounded, total
from shelflight.functions import half_even, normalize_identifier, parse_timestamp
from shelflight.operators import analytics as an
from shelflight.operators import cleaning as cl
from shelflight.operators import features as fe
from shelflight.operators import filters as fl
from shelflight.operators import quality as qu
from shelflight.operators import recommend as rc
from shelflight.operators import scoring as sc
from shelflight.operators import splits as sp
from shelflight.operators import training as tr
from shelflight.operators.least_squares import fit_line
from shelflight.operators.mapping import standardize
from shelflight.operators.metrics import classification_report, regression_metrics
from shelflight.operators.pareto import abc_class, running_share
from shelflight.operators.segments import segment_names
from shelflight.schema import type_names
from shelflight.session import Scratch, shared_folder, tune, written
from checks.inventory_view import AS_OF, inventory_lines
from shelflight.sources.publish import conform_table, drop_generations, product_view, publish, published_tables, read_published
from shelflight.sources.readers import read_csv, read_summary
from shelflight.sources.writers import write_csv, write_summary

LOADED_AT = dt.datetime(2001, 12, 1, 8, 30)


class Stages:
    """The stages over one data folder. Lazy; every query builds its own."""

    def __init__(self, spark: SparkSession, data_dir: str, raw: DataFrame | None = None) -> None:
        self.spark, self.data_dir, self._raw = spark, data_dir, raw
        tune(spark)

    @functools.cached_property
    def raw(self) -> DataFrame:
        return inventory_lines(self.spark, self.data_dir) if self._raw is None else self._raw

    @functools.cached_property
    def cleaned(self) -> DataFrame:
        return cl.clean(self.raw)

    @functools.cached_property
    def kept(self) -> DataFrame:
        """The cleaned rows, stored once: for queries that read them again or with most of their columns."""
        return cl.clean_stored(self.raw)

    @functools.cached_property
    def whole(self) -> Stages:
        """The same stages over the cleaned rows as stored: for queries that read most columns or several stages."""
        stages = Stages(self.spark, self.data_dir, self._raw)
        stages.cleaned = stages.kept = self.kept
        return stages

    def stored(self, *columns: str) -> DataFrame:
        """Columns of all cleaned rows, stored once, for operators that read their input more than once."""
        return written(self.cleaned.select(*columns), "cleaned")

    @functools.cached_property
    def valued(self) -> DataFrame:
        """Row features without the Pareto class, for reports that do not show it."""
        return fe.row_features(self.cleaned, AS_OF).transform(fe.zero_missing_numbers)

    @functools.cached_property
    def engineered(self) -> DataFrame:
        return fe.engineer(self.kept, AS_OF)

    @functools.cached_property
    def analysis(self) -> DataFrame:
        return fe.analysis_base(self.valued)

    @functools.cached_property
    def prepared(self) -> DataFrame:
        return sc.scoring_inputs(self.cleaned, AS_OF)

    @functools.cached_property
    def guessed(self) -> DataFrame:
        """Scored by rules, without the Pareto class, which no KPI reads."""
        return self.prepared.transform(sc.rule_predictions).transform(sc.score_kpis)

    @functools.cached_property
    def scored(self) -> DataFrame:
        return sc.score_by_rules(self.kept, AS_OF)

    @functools.cached_property
    def advice(self) -> DataFrame:
        return rc.recommend(self.guessed)

    def published(self, table: str) -> DataFrame:
        sources = {"inventory": "engineered", "predictions": "guessed", "revenue": "guessed", "recommendations": "advice"}
        return conform_table(getattr(self, sources[table]), table, LOADED_AT)

    def scratch(self, name: str) -> str:
        return f"{shared_folder(self.spark).rstrip('/')}/shelflight-{name}-{uuid.uuid4().hex[:12]}"

    def model(self, kind: str) -> PipelineModel:
        """Fitted once per session and data folder, as a model store would hold it."""
        place = (self.spark.sparkContext.applicationId, self.data_dir, kind)
        if place not in _FITTED:
            train = {"expiry": tr.train_expiry, "demand": tr.train_demand, "revenue": tr.train_revenue,
                     "segment": tr.train_segments}[kind]
            _FITTED[place] = train(self.engineered)
        return _FITTED[place]

    @property
    def models(self) -> tr.Models:
        """All four; where none is fitted yet, from one learning table."""
        kinds = ("expiry", "demand", "revenue", "segment")
        places = {kind: (self.spark.sparkContext.applicationId, self.data_dir, kind) for kind in kinds}
        if not any(place in _FITTED for place in places.values()):
            fitted = tr.train_models(self.engineered)
            _FITTED.update({place: getattr(fitted, kind) for kind, place in places.items()})
        return tr.Models(*[self.model(kind) for kind in kinds])


_FITTED: dict[tuple[str, str, str], PipelineModel] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates as text, so that both engines deliver the same type."""
    kinds = type_names(df)
    dates = {c: F.col(f"`{c}`").cast("date").cast("string") for c, kind in kinds.items()
             if kind in ("date", "timestamp", "timestamp_ntz")}
    return df.withColumns(dates)


_QUERIES: dict[str, Callable[[Stages], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, build: Callable[[Stages], DataFrame], sql: str | None = None) -> None:
    assert name not in _QUERIES, name
    _QUERIES[name] = build
    if sql is not None:
        _SQL[name] = sql if sql.lstrip().startswith("WITH") else over_stages(sql)


def build(name: str, stages: Stages) -> DataFrame:
    return plain(_QUERIES[name](stages))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build: Callable[[Stages], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, data_dir: plain(build(Stages(spark, data_dir)))

    return {name: runner(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _dated(*columns: str) -> str:
    return "* REPLACE (" + ", ".join(f'strftime("{c}", \'%Y-%m-%d\') AS "{c}"' for c in columns) + ")"


_PRODUCT_DATES = _dated("Manufacturing_Date", "Expiry_Date", "Timestamp")


# --- Raw table and cleaning, step by step ------------------------------------------------

_RAW_STEPS = lambda s: s.raw.transform(cl.nulls_for_nan).transform(cl.drop_duplicate_rows_stored)


def _filled(s: Stages) -> DataFrame:
    return _RAW_STEPS(s).transform(cl.fill_missing)


register("raw_inventory", lambda s: s.raw, "SELECT * FROM raw")
register("distinct_rows", _RAW_STEPS, "SELECT * FROM dedup")
register(
    "rows_with_key",
    lambda s: s.raw.dropna(how="any", subset=["Product_ID", "Product_Name"]),
    'SELECT * FROM raw WHERE "Product_ID" IS NOT NULL AND "Product_Name" IS NOT NULL',
)
register(
    "rows_with_any_price",
    lambda s: s.raw.dropna(how="all", subset=["Purchase_Price", "Selling_Price"]),
    'SELECT * FROM raw WHERE "Purchase_Price" IS NOT NULL OR "Selling_Price" IS NOT NULL',
)
register("filled_missing", _filled, "SELECT * FROM filled")
register("valid_values", lambda s: _filled(s).transform(cl.drop_invalid), "SELECT * FROM valid")
register(
    "standardized_text",
    lambda s: _filled(s).transform(cl.drop_invalid).transform(cl.standardize_text),
    "SELECT * FROM titled",
)
register(
    "converted_dates",
    lambda s: _filled(s).transform(cl.drop_invalid).transform(cl.standardize_text).transform(cl.convert_dates),
    f"SELECT {_PRODUCT_DATES} FROM dated",
)
register(
    "business_rules",
    lambda s: _filled(s).transform(cl.drop_invalid).transform(cl.standardize_text).transform(cl.convert_dates)
    .transform(cl.apply_business_rules),
    f"SELECT {_PRODUCT_DATES} FROM ruled",
)
register("cleaned_inventory", lambda s: s.kept, f"SELECT {_PRODUCT_DATES} FROM cleaned")
register(
    "cleaning_audit",
    lambda s: cl.cleaning_audit(s.raw),
    """SELECT step, CAST(row_count AS BIGINT) AS row_count FROM (
      SELECT 'duplicate' AS step, (SELECT count(*) FROM raw) - (SELECT count(*) FROM dedup) AS row_count
      UNION ALL SELECT 'missing_key', (SELECT count(*) FROM dedup) - (SELECT count(*) FROM keyed)
      UNION ALL SELECT 'missing_price', (SELECT count(*) FROM keyed) - (SELECT count(*) FROM priced)
      UNION ALL SELECT 'invalid_value', (SELECT count(*) FROM filled) - (SELECT count(*) FROM valid)
      UNION ALL SELECT 'invalid_date', (SELECT count(*) FROM parsed) - (SELECT count(*) FROM dated)
      UNION ALL SELECT 'business_rule', (SELECT count(*) FROM dated) - (SELECT count(*) FROM ruled)
      UNION ALL SELECT 'kept', (SELECT count(*) FROM ruled)) WHERE row_count > 0 OR step = 'duplicate'""",
)

# --- Quality -------------------------------------------------------------------------------

_RAW_COLUMNS = [
    "Product_ID", "SKU", "Product_Name", "Category", "Subcategory", "Brand", "Supplier", "Store_ID", "Store_City",
    "Batch_No", "Purchase_Price", "Selling_Price", "Reorder_Level", "Max_Stock_Level", "Current_Stock",
    "Overstock_Level", "Daily_Sales", "Weekly_Demand", "Monthly_Demand", "Demand_Forecast", "Lead_Time_Days",
    "Days_Remaining", "Expiry_Date", "Manufacturing_Date", "Timestamp", "Customer_Rating", "Discount_%",
    "Expiry_Risk", "Revenue_At_Risk", "Promotion_Type", "Season", "Holiday", "Weather", "Recommended_Action",
    "Prediction_Result", "Recovered_Revenue", "Waste_Cost",
]
_CELLS = " + ".join(f'CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END' for c in _RAW_COLUMNS)
_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count(\"{c}\") AS missing, count(*) AS n FROM raw" for c in _RAW_COLUMNS
)


def _profile(side: str) -> str:
    return f"""SELECT count(*) AS row_count, CAST({len(_RAW_COLUMNS)} AS BIGINT) AS column_count,
      CAST(sum({_CELLS}) AS BIGINT) AS null_cells FROM {side}"""


register(
    "data_profile",
    lambda s: qu.profile(s.raw),
    f"""SELECT *, round_even(null_cells * 100e0 / (row_count * column_count) * 100e0, 0) / 100e0 AS null_cell_pct
    FROM ({_profile('raw')})""",
)
register(
    "missing_percentages",
    lambda s: qu.null_distribution(s.raw).select("column_name", F.round("missing_pct", 9).alias("missing_pct")),
    f"SELECT column_name, round(missing * 1e0 / n * 100, 9) AS missing_pct FROM ({_MISSING}) WHERE missing > 0",
)
register(
    "null_distribution",
    lambda s: qu.null_report(s.raw),
    f"""SELECT column_name, missing, round_even(missing * 1e0 / n * 100 * 100e0, 0) / 100e0 AS missing_pct
    FROM ({_MISSING}) WHERE missing > 0""",
)
register(
    "duplicate_rows",
    lambda s: qu.duplicate_count(s.raw),
    "SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM dedup) AS duplicate_rows",
)
register(
    "rule_violations",
    lambda s: qu.rule_violations(s.raw),
    """SELECT 'negative_stock' AS rule, count(*) AS row_count FROM raw WHERE "Current_Stock" < 0
    UNION ALL SELECT 'cost_not_positive', count(*) FROM raw WHERE "Purchase_Price" <= 0
    UNION ALL SELECT 'selling_below_cost', count(*) FROM raw WHERE "Selling_Price" < "Purchase_Price\"""",
)
register(
    "before_after_cleaning",
    lambda s: qu.compare_profiles(s.raw, s.cleaned),
    f"SELECT 'raw' AS side, * FROM ({_profile('raw')}) UNION ALL SELECT 'cleaned', * FROM ({_profile('cleaned')})",
)
register(
    "dataset_context",
    lambda s: qu.dataset_context(s.raw.select(*_RAW_COLUMNS)),
    f"SELECT count(*) AS row_count, '{', '.join(_RAW_COLUMNS)}' AS \"columns\" FROM raw",
)
register(
    "normalized_names",
    lambda s: s.raw.select("Batch_No", normalize_identifier(F.col("Product_Name")).alias("plain_name"),
                           normalize_identifier(F.col("SKU")).alias("plain_sku")),
    """SELECT "Batch_No", trim(regexp_replace(lower("Product_Name"), '[^a-z0-9]+', ' ', 'g')) AS plain_name,
      trim(regexp_replace(lower("SKU"), '[^a-z0-9]+', ' ', 'g')) AS plain_sku FROM raw""",
)

# --- Features ------------------------------------------------------------------------------

register("engineered_inventory", lambda s: s.engineered, f"SELECT {_PRODUCT_DATES} FROM engineered")
register("analysis_base", lambda s: s.whole.analysis, f"SELECT {_PRODUCT_DATES} FROM analysis")
register(
    "pareto_running_share",
    lambda s: running_share(s.valued.select("Batch_No", "Inventory_Value"), "Inventory_Value", "Batch_No")
    .withColumn("Running_Share", F.round("Running_Share", 12)),
    """SELECT "Batch_No", "Inventory_Value", CAST(running AS DOUBLE) / 10000e0 AS "Running_Value",
      round(CAST(running AS DOUBLE) / CAST(grand AS DOUBLE), 12) AS "Running_Share" FROM ranked""",
)
register(
    "abc_classes",
    lambda s: s.engineered.select("Batch_No", "Inventory_Value", "ABC_Category"),
    'SELECT "Batch_No", "Inventory_Value", "ABC_Category" FROM engineered',
)
register(
    "inventory_by_value",
    lambda s: s.valued.select("Batch_No", "Product_ID", "Inventory_Value").orderBy(F.desc("Inventory_Value"), "Batch_No"),
    'SELECT "Batch_No", "Product_ID", "Inventory_Value" FROM healthy ORDER BY "Inventory_Value" DESC, "Batch_No"',
)
register(
    "training_table",
    lambda s: tr.training_table(s.kept),
    f"""SELECT {_PRODUCT_DATES}, 'C' AS "ABC_Category" FROM (SELECT * EXCLUDE ("Demand_Level", "Stock_Status") REPLACE
      (CAST("Overstock_Level" AS VARCHAR) AS "Overstock_Level") FROM valued)""",
)

# --- Overview of the engineered table ------------------------------------------------------

_COUNT = 'count("Product_ID") AS "Product_Count"'


def _sums(*columns: str, **renamed: str) -> str:
    parts = [f'{total(chr(34) + c + chr(34))} AS "{c}"' for c in columns]
    parts += [f'{total(chr(34) + c + chr(34))} AS "{new}"' for new, c in renamed.items()]
    return ", ".join(parts)


def _whole(*columns: str) -> str:
    return ", ".join(f'CAST(sum("{c}") AS BIGINT) AS "{c}"' for c in columns)


register(
    "category_summary",
    lambda s: an.category_summary(s.valued),
    f'SELECT "Category", {_COUNT}, {_sums("Inventory_Value", "Revenue")} FROM healthy GROUP BY "Category"',
)
register(
    "brand_summary_top10",
    lambda s: an.brand_summary(s.valued),
    f"""SELECT "Brand", {_COUNT}, {_sums("Inventory_Value")} FROM healthy GROUP BY "Brand"
    ORDER BY "Inventory_Value" DESC, "Brand" LIMIT 10""",
)
register(
    "supplier_summary",
    lambda s: an.supplier_summary(s.valued),
    f'SELECT "Supplier", {_sums("Revenue", "Recoverable_Revenue")} FROM healthy GROUP BY "Supplier"',
)
register(
    "monthly_trend",
    lambda s: an.monthly_trend(s.valued),
    f"""SELECT strftime("Timestamp", '%Y-%m') AS "YearMonth",
      {_sums(Revenue_Added="Revenue", Inventory_Cost_Added="Inventory_Value")},
      CAST(sum("Past_Sales_Volume") AS BIGINT) AS "Sales_Volume_Added"
    FROM healthy WHERE "Timestamp" IS NOT NULL GROUP BY 1""",
)
register(
    "expiry_trend",
    lambda s: an.expiry_trend(s.valued),
    f"""SELECT strftime("Expiry_Date", '%Y-%m') AS "ExpiryMonth", {_COUNT}, {_sums("Revenue_At_Risk")}
    FROM healthy WHERE "Days_To_Expiry" > -365 AND "Days_To_Expiry" < 365 GROUP BY 1""",
)
register(
    "top_selling_products",
    lambda s: an.top_selling_products(s.valued),
    """SELECT "Product_ID", "Product_Name", "Batch_No", "Past_Sales_Volume" FROM healthy
    ORDER BY "Past_Sales_Volume" DESC, "Product_ID", "Batch_No" LIMIT 10""",
)
register(
    "top_categories",
    lambda s: an.top_groups(s.valued, "Category", "Revenue"),
    f'SELECT "Category", {_sums("Revenue")} FROM healthy GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5',
)
register(
    "top_suppliers",
    lambda s: an.top_groups(s.valued, "Supplier", "Inventory_Value"),
    f'SELECT "Supplier", {_sums("Inventory_Value")} FROM healthy GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5',
)


def _corr_sql(columns: list[str], digits: int, source: str) -> str:
    pairs = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            pairs.append((f'corr(CAST("{a}" AS DOUBLE), CAST("{b}" AS DOUBLE))', a, b))
    inner = ", ".join(f"{expr} AS m{i}" for i, (expr, _, _) in enumerate(pairs))
    rows = []
    for i, (_, a, b) in enumerate(pairs):
        for left, right in sorted({(a, b), (b, a)}):
            value = f"CASE WHEN isnan(m{i}) THEN NULL ELSE round_even(m{i}, {digits}) END"
            rows.append(f"SELECT '{left}' AS a, '{right}' AS b, {value} AS corr FROM moments")
    from_stages = over_stages("").rstrip()
    return f"{from_stages}, moments AS MATERIALIZED (SELECT {inner} FROM {source})\n" + "\nUNION ALL ".join(rows)


_CORRELATED = list(an.CORRELATION_COLUMNS)
register(
    "selected_correlations",
    lambda s: an.correlations(s.analysis, _CORRELATED[:12], digits=2),
    _corr_sql(_CORRELATED[:12], 2, "analysis"),
)
_ENGINEERED_NUMBERS = [
    "Purchase_Price", "Selling_Price", "Reorder_Level", "Max_Stock_Level", "Current_Stock", "Overstock_Level",
    "Daily_Sales", "Demand_Forecast", "Lead_Time_Days", "Days_Remaining", "Customer_Rating", "Discount_%",
    "Revenue_At_Risk", "Recovered_Revenue", "Waste_Cost", "Inventory_Value", "Revenue", "Profit", "Profit_Margin",
    "Inventory_Turnover", "Inventory_Health",
]
register(
    "correlation_matrix",
    lambda s: an.correlations(s.valued.select(*_ENGINEERED_NUMBERS), digits=6),
    _corr_sql(_ENGINEERED_NUMBERS, 6, "healthy"),
)



_FLAGGED = [*_ENGINEERED_NUMBERS[:6], "Category", "Inventory_Value"]
# The numeric columns are found by their types: neither the text nor the flag takes part.
register(
    "correlation_numeric_columns",
    lambda s: an.correlations(
        s.valued.select(*_FLAGGED, (F.col("Current_Stock") <= F.col("Reorder_Level")).cast("int").alias("Low_Stock_Flag")), digits=6
    ),
    _corr_sql([c for c in _FLAGGED if c != "Category"], 6, "healthy"),
)


def _large_means(s: Stages) -> DataFrame:
    lines = s.spark.read.parquet(f"{s.data_dir}/lineitem.parquet")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return lines.select((day + 1.7e9).alias("seconds"), (F.col("l_extendedprice") / 1000 + 1e8).alias("price"),
                        F.col("l_quantity").alias("quantity"), F.lit(3.5).alias("constant"))


# Pearson from centred values, so that large means cost no digits here either.
register(
    "correlation_large_mean",
    lambda s: an.correlations(_large_means(s), digits=6),
    """WITH base AS (SELECT date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS d, l_extendedprice / 1000e0 AS p,
      CAST(l_quantity AS DOUBLE) AS q FROM lineitem),
    names(n) AS (VALUES ('seconds'), ('price'), ('quantity'), ('constant')),
    r AS (SELECT corr(d, p) AS dp, corr(d, q) AS dq, corr(p, q) AS pq FROM base)
    SELECT x.n AS a, y.n AS b, CASE WHEN x.n = 'constant' OR y.n = 'constant' THEN NULL WHEN x.n = y.n THEN 1e0 ELSE round_even(
      CASE WHEN 'quantity' NOT IN (x.n, y.n) THEN dp WHEN 'price' NOT IN (x.n, y.n) THEN dq ELSE pq END, 6) END AS corr
    FROM names x CROSS JOIN names y CROSS JOIN r""",
)


def _extreme(s: Stages) -> DataFrame:
    lines = s.spark.read.parquet(f"{s.data_dir}/lineitem.parquet")
    odd = F.when(F.col("l_orderkey") % 50 == 1, F.lit(float("nan"))).when(F.col("l_orderkey") % 50 == 2, F.lit(float("inf")))
    odd = odd.when(F.col("l_orderkey") % 50 == 3, F.lit(1e15)).when(F.col("l_orderkey") % 50 == 4, F.lit(-1e15))
    return lines.select(F.col("l_linenumber").alias("Category"), odd.otherwise(F.col("l_extendedprice")).alias("Revenue"))


# NaN and infinity count as missing, amounts of 1e15 are summed exactly; compared in hundreds, below which a double of
# this size has no digits.
register(
    "extreme_amounts",
    lambda s: an.group_totals(_extreme(s), "Category", ["Revenue"]).withColumn("Revenue", F.rint(F.col("Revenue") / 100)),
    """SELECT l_linenumber AS "Category", round_even(CAST(sum(CASE l_orderkey % 50 WHEN 1 THEN NULL WHEN 2 THEN NULL
        WHEN 3 THEN CAST(10000000000000000000 AS HUGEINT) WHEN 4 THEN CAST(-10000000000000000000 AS HUGEINT)
        ELSE CAST(round_even(l_extendedprice * 10000e0, 0) AS HUGEINT) END) AS DOUBLE) / 10000e0 / 100, 0) AS "Revenue"
    FROM lineitem GROUP BY 1""",
)


def _beyond_units(s: Stages) -> DataFrame:
    """Lines of which one in fifty has an amount of 1e25, which has no ten-thousandths in 26 digits."""
    lines = s.spark.read.parquet(f"{s.data_dir}/lineitem.parquet")
    value = F.when(F.col("l_orderkey") % 50 == 5, F.lit(1e25)).when(F.col("l_orderkey") % 50 == 6, F.lit(float("nan")))
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return lines.select(F.col("l_linenumber").alias("Category"), value.otherwise(F.col("l_extendedprice")).alias("Revenue"), key.alias("line"))


# Compared in units of 1e15, below which a double of this size has no digits.
register(
    "amounts_beyond_units",
    lambda s: an.group_totals(_beyond_units(s), "Category", ["Revenue"]).withColumn("Revenue", F.rint(F.col("Revenue") / 1e15)),
    """SELECT l_linenumber AS "Category", CAST(count(*) FILTER (l_orderkey % 50 = 5) AS DOUBLE) * 1e10 AS "Revenue" FROM lineitem GROUP BY 1""",
)
# Among equal amounts the order is that of the key's MD5; the other amounts weigh nothing beside them.
register(
    "classes_beyond_units",
    lambda s: abc_class(_beyond_units(s), "Revenue", "line", "C").groupBy("ABC_Category", (F.col("Revenue") == 1e25).alias("large"))
    .agg(F.count(F.lit(1)).alias("line_count"), F.max(F.when(F.col("Revenue") == 1e25, F.md5("line"))).alias("last_hash")),
    """WITH lines AS (SELECT md5(l_orderkey || '-' || l_linenumber) AS h, CASE WHEN l_orderkey % 50 = 6 THEN NULL ELSE l_orderkey % 50 = 5 END AS big FROM lineitem),
    ranked AS (SELECT h, row_number() OVER (ORDER BY h) AS r, count(*) OVER () AS n FROM lines WHERE big),
    classes AS (SELECT CASE WHEN r * 100 <= n * 80 THEN 'A' WHEN r * 100 <= n * 95 THEN 'B' ELSE 'C' END AS c, true AS big, h FROM ranked
      UNION ALL SELECT 'C', false, NULL FROM lines WHERE big IS NULL OR NOT big)
    SELECT c AS "ABC_Category", big AS large, count(*) AS line_count, max(h) AS last_hash FROM classes GROUP BY 1, 2""",
)


def _spelled(s: Stages) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    styles = ["d MMM yyyy", "MMM d, yyyy", "dd/MM/yy", "yyyyMMdd", "d MMMM yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyy-MM-dd", "'on a day'"]
    text = F.lit(None).cast("string")
    for k, style in enumerate(styles):
        text = F.when(F.col("l_orderkey") % len(styles) == k, F.date_format(day, style)).otherwise(text)
    lines = s.spark.read.parquet(f"{s.data_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", text.alias("text"))
    return lines.select("l_orderkey", "l_linenumber", parse_timestamp(F.col("text"), "string", day_first=True).alias("day"))


# Every date is read back from its spelling; text that is no date is null.
register(
    "date_spellings",
    _spelled,
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 < 8 THEN strftime(l_shipdate, '%Y-%m-%d') END AS day FROM lineitem""",
)

# --- Interactive analyses ------------------------------------------------------------------

_CHOSEN = {"Category": ["Economy", "Promo", "Small"], "Brand": ["Brand#2", "Brand#17", "Brand#4", "Brand#11"],
           "Expiry_Risk": ["High", "Medium"]}
_CHOSEN_SQL = " AND ".join(f"\"{c}\" IN ({', '.join(repr(v) for v in vs)})" for c, vs in _CHOSEN.items())

register(
    "filtered_lines",
    lambda s: fl.select_values(s.whole.analysis, {**_CHOSEN, "Supplier": None}),
    f"SELECT {_PRODUCT_DATES} FROM analysis WHERE {_CHOSEN_SQL}",
)
register(
    "option_lists",
    lambda s: fl.option_lists(s.analysis, ["Category", "Brand", "Supplier", "Expiry_Risk"]),
    " UNION ".join(f"SELECT '{c}' AS field, \"{c}\" AS option FROM analysis" for c in
                   ("Category", "Brand", "Supplier", "Expiry_Risk")),
)
register(
    "analysis_kpis",
    lambda s: an.analysis_kpis(s.analysis),
    f"""SELECT count(DISTINCT "Product_ID") AS "Total_Products",
      {_sums("Inventory_Value", "Revenue_At_Risk", "Recovered_Revenue")}, {mean('"Customer_Rating"')} AS "Average_Rating",
      {mean('"Daily_Sales"')} AS "Average_Daily_Sales" FROM analysis""",
)
register(
    "category_analysis",
    lambda s: an.category_analysis(s.analysis),
    f"""SELECT "Category", {_sums("Inventory_Value", "Revenue_At_Risk")}, {_whole("Current_Stock", "Daily_Sales")}
    FROM analysis GROUP BY "Category\"""",
)
register(
    "brand_distribution",
    lambda s: an.brand_distribution(s.analysis),
    f"""SELECT "Brand", count(DISTINCT "Product_ID") AS "Product_Count", {_whole("Current_Stock")},
      {_sums("Inventory_Value", "Estimated_Daily_Revenue", "Revenue_At_Risk")}
    FROM analysis GROUP BY "Brand" ORDER BY "Inventory_Value" DESC, "Brand" LIMIT 15""",
)
register(
    "supplier_contribution",
    lambda s: an.supplier_contribution(s.analysis),
    f"""SELECT *, CASE WHEN "Revenue_At_Risk" > 0 THEN "Recovered_Revenue" / "Revenue_At_Risk" * 100 ELSE 0e0 END
      AS "Recovery_Rate_%" FROM (SELECT "Supplier", {_whole("Current_Stock")},
        {_sums("Inventory_Value", "Revenue_At_Risk", "Recovered_Revenue", "Waste_Cost")}
      FROM analysis GROUP BY "Supplier") ORDER BY "Inventory_Value" DESC, "Supplier" LIMIT 15""",
)
register(
    "daily_trend",
    lambda s: an.daily_trend(s.analysis),
    f"""SELECT strftime("Timestamp", '%Y-%m-%d') AS "Analysis_Date", {_whole("Current_Stock")},
      {_sums("Inventory_Value", "Estimated_Daily_Revenue", "Revenue_At_Risk", "Recovered_Revenue")}
    FROM analysis WHERE "Timestamp" IS NOT NULL GROUP BY 1""",
)
register(
    "expiry_risk_summary",
    lambda s: an.expiry_risk_summary(s.analysis),
    f'SELECT "Expiry_Risk", {_COUNT}, {_sums("Revenue_At_Risk", "Inventory_Value")} FROM analysis GROUP BY 1',
)
register(
    "capital_at_risk",
    lambda s: an.capital_at_risk(s.analysis),
    f"""SELECT "Category", {_sums("Revenue_At_Risk", "Waste_Cost", "Recovered_Revenue")}
    FROM analysis GROUP BY 1""",
)
register(
    "days_histogram",
    lambda s: an.days_histogram(s.analysis),
    over_stages("").rstrip() + """, bounds AS (SELECT CAST(min("Days_Remaining") AS DOUBLE) AS low,
      (max("Days_Remaining") - min("Days_Remaining")) / 40e0 AS width FROM analysis),
    placed AS (SELECT "Expiry_Risk", CAST(least(floor(("Days_Remaining" - low) / width), 39) AS INTEGER) AS bin, low, width
      FROM analysis CROSS JOIN bounds)
    SELECT bin, round_even((low + bin * width) * 1e6, 0) / 1e6 AS bin_start, "Expiry_Risk", count(*) AS row_count
    FROM placed GROUP BY bin, low, width, "Expiry_Risk\"""",
)
register(
    "recommended_action_counts",
    lambda s: an.value_counts(s.analysis, "Recommended_Action"),
    'SELECT "Recommended_Action", count(*) AS row_count FROM analysis GROUP BY 1',
)
register(
    "prediction_result_counts",
    lambda s: an.value_counts(s.analysis, "Prediction_Result"),
    'SELECT "Prediction_Result", count(*) AS row_count FROM analysis GROUP BY 1',
)
register(
    "urgent_expiry_list",
    lambda s: an.urgent_list(s.analysis),
    """SELECT "Product_ID", "Product_Name", "Category", "Brand", "Days_Remaining", "Expiry_Risk", "Current_Stock",
      "Revenue_At_Risk", "Recommended_Action", "Batch_No" FROM analysis
    WHERE "Days_Remaining" <= 30 OR lower("Expiry_Risk") = 'high'
    ORDER BY "Revenue_At_Risk" DESC, "Product_ID", "Batch_No" LIMIT 100""",
)
for _metric in ("Daily_Sales", "Monthly_Demand", "Demand_Forecast", "Estimated_Daily_Revenue",
                "Estimated_Daily_Profit", "Customer_Rating", "Recovered_Revenue"):
    register(
        f"top_products_by_{_metric.lower()}",
        lambda s, metric=_metric: an.top_products(s.analysis, metric),
        f"""SELECT "Product_ID", "Product_Name", "Category", "Brand", "{_metric}", "Current_Stock", "Expiry_Risk",
          "Recommended_Action", "Batch_No" FROM analysis
        ORDER BY "{_metric}" DESC, "Product_ID", "Batch_No" LIMIT 15""",
    )
register(
    "preview_rows",
    lambda s: s.analysis.select("Batch_No", "Product_ID", "Product_Name", "Category").orderBy("Batch_No").limit(10),
    'SELECT "Batch_No", "Product_ID", "Product_Name", "Category" FROM analysis ORDER BY "Batch_No" LIMIT 10',
)


def _exported(s: Stages) -> DataFrame:
    path = s.scratch("export")
    write_csv(fl.select_values(s.analysis, _CHOSEN).select("Batch_No", "Product_ID", "Category", "Revenue_At_Risk"), path)
    return read_csv(s.spark, path)


register(
    "filtered_export",
    _exported,
    f'SELECT "Batch_No", "Product_ID", "Category", "Revenue_At_Risk" FROM analysis WHERE {_CHOSEN_SQL}',
)


def _csv_round_trip(s: Stages) -> DataFrame:
    path = s.scratch("raw-csv")
    spaced = s.raw.withColumnRenamed("Product_ID", " Product_ID ").withColumnRenamed("Brand", "Brand ")
    write_csv(spaced, path)
    return read_csv(s.spark, path)


# "n/a", "none" and blank-padded text pass through the file; "n/a" is a null token.
register(
    "csv_round_trip",
    _csv_round_trip,
    """SELECT * REPLACE (CASE WHEN "Expiry_Date" <> 'n/a' THEN "Expiry_Date" END AS "Expiry_Date",
      CAST("Max_Stock_Level" AS DOUBLE) AS "Max_Stock_Level", CAST("Overstock_Level" AS VARCHAR) AS "Overstock_Level")
    FROM raw""",
)

# --- Executive view ------------------------------------------------------------------------

_MONEY = ("Inventory_Value", "Revenue", "Profit", "Revenue_At_Risk", "Recoverable_Revenue")
register(
    "executive_kpis",
    lambda s: an.executive_kpis(s.valued),
    f"""SELECT count(*) AS "Total_Products", {_sums(*_MONEY)}, {mean('"Inventory_Health"')} AS "Average_Health",
      count(*) FILTER ("Expiry_Risk" = 'High') AS "Near_Expiry",
      count(*) FILTER ("Stock_Status" = 'Low Stock') AS "Low_Stock",
      count(*) FILTER ("Stock_Status" = 'Overstock') AS "Overstock" FROM healthy""",
)
register(
    "executive_categories",
    lambda s: an.executive_categories(s.valued),
    f"""SELECT "Category", {_COUNT}, {mean('"Inventory_Health"')} AS "Avg_Health",
      {_sums("Inventory_Value", "Revenue", "Profit")} FROM healthy GROUP BY "Category\"""",
)

# --- Scoring -------------------------------------------------------------------------------

_SCORED_DATES = _dated("Manufacturing_Date", "Expiry_Date", "Timestamp", "Date_Added", "Last_Restock_Date")
# The search for the class reads the rows again, so they are stored once.
register("score_prepared", lambda s: sc.score_prep(s.kept, AS_OF), f"SELECT {_SCORED_DATES} FROM prepared")
register("scored_by_rules", lambda s: s.scored, f"SELECT {_SCORED_DATES} FROM scored")
register(
    "score_dashboard_kpis",
    lambda s: an.score_dashboard_kpis(s.guessed),
    f"""SELECT count(DISTINCT "Product_ID") AS "Products", {total('"Inventory_Value"')} AS "Inventory_Value",
      {total('"Predicted_Revenue_at_Risk"')} AS "Revenue_at_Risk",
      {mean('"Predicted_Inventory_Health"')} AS "Inventory_Health" FROM scored""",
)
register(
    "score_dashboard_filtered",
    lambda s: an.score_dashboard_kpis(
        fl.select_values(s.guessed, {"Category": ["Economy", "Large"], "Predicted_Expiry_Risk": ["High", "Medium"]})
    ),
    f"""SELECT count(DISTINCT "Product_ID") AS "Products", {total('"Inventory_Value"')} AS "Inventory_Value",
      {total('"Predicted_Revenue_at_Risk"')} AS "Revenue_at_Risk",
      {mean('"Predicted_Inventory_Health"')} AS "Inventory_Health" FROM scored
    WHERE "Category" IN ('Economy', 'Large') AND "Predicted_Expiry_Risk" IN ('High', 'Medium')""",
)
register(
    "risk_exposure",
    lambda s: an.risk_exposure(s.guessed),
    f'SELECT "Predicted_Expiry_Risk", {_sums("Predicted_Revenue_at_Risk")} FROM scored GROUP BY 1',
)
register(
    "risk_by_category",
    lambda s: an.risk_by_category(s.guessed),
    f"""SELECT "Category", {_sums("Predicted_Revenue_at_Risk")} FROM scored GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 12""",
)
register(
    "value_by_category_and_risk",
    lambda s: an.value_by_category_and_risk(s.guessed),
    f'SELECT "Category", "Predicted_Expiry_Risk", {_sums("Inventory_Value")} FROM scored GROUP BY 1, 2',
)
register(
    "value_tree",
    lambda s: an.value_tree(s.guessed),
    f"""SELECT "Category", "Predicted_Expiry_Risk", {_sums("Inventory_Value")},
      CAST(grouping("Category", "Predicted_Expiry_Risk") AS INTEGER) AS level
    FROM scored GROUP BY ROLLUP ("Category", "Predicted_Expiry_Risk")""",
)
register(
    "risk_crosstab",
    lambda s: an.risk_crosstab(s.guessed),
    """SELECT "Category", count(*) FILTER ("Predicted_Expiry_Risk" = 'High') AS "High",
      count(*) FILTER ("Predicted_Expiry_Risk" = 'Medium') AS "Medium",
      count(*) FILTER ("Predicted_Expiry_Risk" = 'Low') AS "Low",
      count(*) FILTER ("Predicted_Expiry_Risk" NOT IN ('High', 'Medium', 'Low')) AS "Other"
    FROM scored GROUP BY "Category" ORDER BY count(*) DESC, "Category" LIMIT 12""",
)
_FOURTH_RISK = """CASE WHEN "Stock_Quantity" % 5 = 0 THEN 'No Risk' WHEN "Stock_Quantity" % 7 = 0 THEN NULL ELSE "Predicted_Expiry_Risk" END"""
register(
    "risk_crosstab_fourth_risk",
    lambda s: an.risk_crosstab(s.guessed.withColumn("Predicted_Expiry_Risk", F.expr(_FOURTH_RISK.replace('"', "`"))), n=4),
    f"""SELECT "Category", count(*) FILTER (risk = 'High') AS "High", count(*) FILTER (risk = 'Medium') AS "Medium",
      count(*) FILTER (risk = 'Low') AS "Low", count(*) FILTER (risk = 'No Risk') AS "Other"
    FROM (SELECT "Category", {_FOURTH_RISK} AS risk FROM scored) WHERE risk IS NOT NULL
    GROUP BY "Category" ORDER BY count(*) DESC, "Category" LIMIT 4""",
)
register(
    "predicted_risk_distribution",
    lambda s: an.predicted_risk_distribution(s.guessed),
    'SELECT "Predicted_Expiry_Risk", count(*) AS row_count FROM scored GROUP BY 1',
)
register(
    "velocity_pairs",
    lambda s: an.velocity_pairs(s.guessed),
    """SELECT "Category", CAST("Sales_Velocity" AS DOUBLE) AS "Sales_Velocity", "Predicted_Sales_Velocity",
      count(*) AS row_count FROM scored GROUP BY ALL""",
)

_PREPARED_FROM = (
    "Batch_No", "Purchase_Price", "Selling_Price", "Current_Stock", "Reorder_Level", "Daily_Sales", "Monthly_Demand",
    "Expiry_Date", "Timestamp",
)
register(
    "score_negative_total",
    lambda s: sc.score_prep(s.stored(*_PREPARED_FROM).withColumn("Purchase_Price", -F.col("Purchase_Price")), AS_OF)
    .select("Batch_No", "Inventory_Value", "ABC_Category"),
    """SELECT "Batch_No", 0e0 - "Inventory_Value" AS "Inventory_Value", 'A' AS "ABC_Category" FROM margins""",
)

# --- Recommendations -----------------------------------------------------------------------


def _scored_file(s: Stages) -> DataFrame:
    """The scored table written as CSV and read back, as the next stage gets it."""
    path = s.scratch("scored")
    write_csv(plain(s.whole.guessed), path, "gzip")
    return read_csv(s.spark, path)


register("recommendations_from_file", lambda s: rc.recommend(_scored_file(s)), "SELECT * FROM advice")

register("recommendations", lambda s: s.advice, "SELECT * FROM advice")
register(
    "recommendations_from_cleaned",
    # No score columns: every input of the rules comes from its fallback.
    lambda s: rc.recommend(s.cleaned.drop("Max_Stock_Level")).groupBy("Recommendation_Type", "Priority_Level").agg(
        F.count(F.lit(1)).alias("row_count"), an.exact_sum(F.col("Expected_Revenue_Recovery")).alias("recovery")
    ),
    over_stages("").rstrip() + f""", fallback AS (
      SELECT 'Discount Recommendation' AS kind, "Expiry_Risk" AS priority,
        {rounded('"Current_Stock" * "Selling_Price" * CASE "Expiry_Risk" WHEN ' + "'High'" + ' THEN 0.6e0 ELSE 0.8e0 END')} AS v
      FROM cleaned WHERE "Expiry_Risk" IN ('High', 'Medium')
      UNION ALL SELECT 'Reorder Recommendation', CASE WHEN "Daily_Sales" >= 5 THEN 'High' ELSE 'Medium' END,
        {rounded('("Reorder_Level" - "Current_Stock") * "Selling_Price" * 0.9e0')}
      FROM cleaned WHERE "Current_Stock" <= "Reorder_Level"
      UNION ALL SELECT 'Overstock Recommendation', 'Medium',
        {rounded('("Current_Stock" - "Reorder_Level") * "Selling_Price" * 0.75e0')}
      FROM cleaned WHERE "Current_Stock" >= "Reorder_Level"
      UNION ALL SELECT 'Transfer Recommendation', 'Medium',
        {rounded('("Current_Stock" - "Reorder_Level") * "Purchase_Price"')}
      FROM cleaned WHERE "Current_Stock" >= "Reorder_Level"
      UNION ALL SELECT 'Supplier Recommendation', 'Low', {rounded('"Purchase_Price" * "Current_Stock" * 0.05e0')}
      FROM cleaned WHERE "Current_Stock" <= "Reorder_Level" AND "Daily_Sales" >= 8
      UNION ALL SELECT 'Purchase Planning Recommendation', 'High', 0e0 FROM cleaned WHERE "Daily_Sales" >= 12)
    SELECT kind AS "Recommendation_Type", priority AS "Priority_Level", count(*) AS row_count,
      {total('v')} AS recovery FROM fallback GROUP BY 1, 2""",
)
register(
    "recommendation_queue",
    lambda s: rc.filter_queue(s.advice, "Reorder Recommendation", "High", ["Economy", "Small"], None, "RED"),
    """SELECT "Product_ID", "Product_Name", "Recommendation_Type", "Action", "Expected_Revenue_Recovery",
      "Priority_Level", "Business_Reason" FROM advice
    WHERE "Recommendation_Type" = 'Reorder Recommendation' AND "Priority_Level" = 'High'
      AND "Category" IN ('Economy', 'Small')
      AND (contains(lower("Product_ID"), 'red') OR contains(lower("Product_Name"), 'red'))""",
)
register(
    "recommendation_search",
    lambda s: rc.filter_queue(s.advice, search=" prd1% "),
    """SELECT "Product_ID", "Product_Name", "Recommendation_Type", "Action", "Expected_Revenue_Recovery",
      "Priority_Level", "Business_Reason" FROM advice
    WHERE contains(lower("Product_ID"), 'prd1%') OR contains(lower("Product_Name"), 'prd1%')""",
)
register(
    "recommendation_search_hits",
    lambda s: rc.filter_queue(s.advice, search="  ReD "),
    """SELECT "Product_ID", "Product_Name", "Recommendation_Type", "Action", "Expected_Revenue_Recovery",
      "Priority_Level", "Business_Reason" FROM advice
    WHERE contains(lower("Product_ID"), 'red') OR contains(lower("Product_Name"), 'red')""",
)
register(
    "recommendation_options",
    lambda s: fl.option_lists(s.advice, ["Recommendation_Type", "Category", "Supplier"]),
    " UNION ".join(f"SELECT '{c}' AS field, \"{c}\" AS option FROM advice" for c in
                   ("Recommendation_Type", "Category", "Supplier")),
)

_URGENT = "\"Predicted_Expiry_Risk\" = 'High' OR \"Stock_Quantity\" <= \"Min_Stock_Level\""
_RATE = "CASE \"Predicted_Expiry_Risk\" WHEN 'High' THEN 0.6e0 WHEN 'Medium' THEN 0.8e0 ELSE 0e0 END"
_SUMMARY_SQL = over_stages("").rstrip() + f""", sums AS (
  SELECT count(DISTINCT "Product_ID") AS products, count(DISTINCT "Product_ID") FILTER ({_URGENT}) AS urgent,
    {total('"Predicted_Revenue_at_Risk"')} AS risk,
    {total('greatest("Predicted_Revenue_at_Risk", 0) * ' + _RATE)} AS expected,
    {total('least(greatest("Recovered_Revenue", 0), greatest("Predicted_Revenue_at_Risk", 0))')} AS recovered,
    avg("Predicted_Inventory_Health") AS health FROM scored)
SELECT products AS "Products_Analysed", urgent AS "High_Risk_Products",
  round_even(risk * 100e0, 0) / 100e0 AS "Revenue_at_Risk", {rounded('least(recovered, risk)')} AS "Actual_Recovered_Revenue",
  {rounded('least(expected, risk)')} AS "Expected_Recovery",
  CASE WHEN risk > 0 THEN least(expected, risk) / risk * 100 ELSE 0e0 END AS "Estimated_Waste_Reduction_Pct",
  round_even(health * 100e0, 0) / 100e0 AS "Overall_Inventory_Health_Pct",
  'Expiry-risk value after recommended markdown; capped at revenue at risk' AS "Recovery_Method" FROM sums"""
register("impact_summary", lambda s: rc.impact_summary(s.guessed), _SUMMARY_SQL)


def _summary_document(s: Stages) -> DataFrame:
    path = s.scratch("summary")
    write_summary(rc.impact_summary(s.guessed), path)
    return read_summary(s.spark, path)


register("summary_document", _summary_document, _SUMMARY_SQL)
register(
    "priority_records",
    lambda s: an.priority_records(s.guessed),
    """SELECT "Product_ID", "Batch_No", '{"Product_ID":"' || "Product_ID" || '","Product_Name":"' || "Product_Name"
      || '","Category":"' || "Category" || '","Supplier":"' || "Supplier" || '","Store_City":"' || "Store_City"
      || '","Current_Stock":' || "Current_Stock" || ',"Days_To_Expiry":' || "Days_To_Expiry"
      || ',"Predicted_Expiry_Risk":"' || "Predicted_Expiry_Risk" || '","Predicted_Sales_Velocity":'
      || "Predicted_Sales_Velocity" || ',"Predicted_Revenue":' || "Predicted_Revenue"
      || ',"Predicted_Revenue_at_Risk":' || "Predicted_Revenue_at_Risk" || '}' AS record
    FROM scored ORDER BY "Predicted_Revenue_at_Risk" DESC, "Product_ID", "Batch_No" LIMIT 30""",
)
register(
    "priority_records_from_file",
    lambda s: an.priority_records(_scored_file(s)),
    _SQL["priority_records"],
)
register("impact_summary_from_file", lambda s: rc.impact_summary(_scored_file(s)), _SUMMARY_SQL)
register(
    "recommendation_records",
    lambda s: an.recommendation_records(s.advice),
    """SELECT "Product_ID", "Recommendation_Type", '{"Product_ID":"' || "Product_ID" || '","Product_Name":"'
      || "Product_Name" || '","Category":"' || "Category" || '","Supplier":"' || "Supplier" || '","Store_Location":"'
      || "Store_Location" || '","Recommendation_Type":"' || "Recommendation_Type" || '","Action":"' || "Action"
      || '","Expected_Revenue_Recovery":' || "Expected_Revenue_Recovery" || ',"Business_Reason":"'
      || "Business_Reason" || '","Priority_Level":"' || "Priority_Level" || '"}' AS record
    FROM advice ORDER BY "Product_ID", "Recommendation_Type", "Business_Reason", "Expected_Revenue_Recovery",
      "Product_Name", "Category", "Supplier", "Store_Location", "Action", "Priority_Level" LIMIT 30""",
)

# --- Published tables ----------------------------------------------------------------------

register(
    "published_inventory",
    lambda s: s.published("inventory"),
    """SELECT "Product_ID", "Product_Name", "Category", "Brand", "Supplier", "Cost_Price", "Selling_Price",
      "Stock_Quantity", "Min_Stock_Level", CAST(trunc("Max_Stock_Level") AS BIGINT) AS "Max_Stock_Level",
      CAST("Sales_Velocity" AS DOUBLE) AS "Sales_Velocity", "Past_Sales_Volume", CAST(NULL AS VARCHAR) AS "Date_Added",
      strftime("Expiry_Date", '%Y-%m-%d') AS "Expiry_Date", CAST(NULL AS VARCHAR) AS "Last_Restock_Date",
      CAST(NULL AS VARCHAR) AS "Store_Location", CAST(NULL AS VARCHAR) AS "Status", "Inventory_Value", "Revenue",
      "Profit", "Profit_Margin", "Demand_Level", "Stock_Status", "Expiry_Risk", "Revenue_At_Risk" AS "Revenue_at_Risk",
      "Recoverable_Revenue", "Inventory_Turnover", CAST(NULL AS INTEGER) AS "Low_Stock_Flag",
      CAST(NULL AS INTEGER) AS "Overstock_Flag", CAST(NULL AS INTEGER) AS "Reorder_Flag", "ABC_Category",
      CAST("Inventory_Health" AS INTEGER) AS "Inventory_Health" FROM engineered""",
)
register(
    "published_predictions",
    lambda s: s.published("predictions"),
    """SELECT "Product_ID", "Predicted_Expiry_Risk", "Predicted_Sales_Velocity", "Predicted_Revenue",
      "Predicted_Cluster", "Predicted_Revenue_at_Risk", "Predicted_Inventory_Health", '2001-12-01' AS "Prediction_Date"
    FROM scored""",
)
register(
    "published_revenue",
    lambda s: s.published("revenue"),
    """SELECT "Product_ID", "Revenue" AS "Historical_Revenue", "Predicted_Revenue", '2001-12-01' AS "Report_Date"
    FROM scored""",
)
register(
    "published_recommendations",
    lambda s: s.published("recommendations"),
    """SELECT "Product_ID", "Recommendation_Type", "Action", "Expected_Revenue_Recovery", "Business_Reason",
      "Priority_Level", '2001-12-01' AS "Created_At" FROM advice""",
)
register(
    "published_by_product",
    lambda s: product_view(published_tables(s.whole.valued, s.whole.guessed, s.whole.advice, LOADED_AT)),
    f"""SELECT * REPLACE (coalesce(recommendations, 0) AS recommendations, coalesce(expected_recovery, 0) AS expected_recovery)
    FROM (SELECT "Product_ID", count(*) AS inventory_lines, {total('"Inventory_Value"')} AS inventory_value
      FROM engineered GROUP BY 1)
    LEFT JOIN (SELECT "Product_ID", {total('"Predicted_Revenue_at_Risk"')} AS predicted_risk,
      min("Predicted_Inventory_Health") AS lowest_health, {total('"Revenue"')} AS historical_revenue,
      {total('"Predicted_Revenue"')} AS predicted_revenue FROM scored GROUP BY 1) USING ("Product_ID")
    LEFT JOIN (SELECT "Product_ID", count(*) AS recommendations, {total('"Expected_Revenue_Recovery"')} AS expected_recovery
      FROM advice GROUP BY 1) USING ("Product_ID")""",
)

# --- Schema mapping ------------------------------------------------------------------------


def _foreign(s: Stages) -> DataFrame:
    """The raw table under the column names another system might use."""
    return s.raw.select(
        F.col("Product_ID").alias("Item Code"), F.col("Product_Name").alias("Description"),
        F.col("Category").alias("Department"), F.col("Current_Stock").alias("Qty"),
        F.col("Purchase_Price").alias("Unit Cost"), F.col("Selling_Price").alias("Retail Price"),
        F.col("Daily_Sales").alias("Avg Daily Sales"),
        F.when(F.col("Expiry_Date") != "n/a", F.date_format(F.date_add(F.lit(AS_OF), F.col("Days_Remaining").cast("int")), "yyyy-MM-dd"))
        .alias("Best Before"),
        F.col("Batch_No").alias(" Lot Number "),
    )


_MAPPED = """SELECT "Product_ID", "Product_ID" AS "SKU", "Product_Name", "Category", 'General' AS "Subcategory",
  'Unknown' AS "Brand", 'Unknown' AS "Supplier", 'MAIN' AS "Store_ID", 'Unknown' AS "Store_City", "Batch_No",
  coalesce("Purchase_Price", 0) AS "Purchase_Price", coalesce("Selling_Price", 0) AS "Selling_Price",
  coalesce("Current_Stock", 0) AS "Current_Stock", ceil("Daily_Sales" * 7 * 1.5e0) AS "Reorder_Level", "Daily_Sales",
  "Daily_Sales" * 7 AS "Weekly_Demand", "Daily_Sales" * 30 AS "Monthly_Demand", 7e0 AS "Lead_Time_Days",
  CASE WHEN "Expiry_Date" = 'n/a' THEN 0 ELSE CAST("Days_Remaining" AS BIGINT) END AS "Days_Remaining",
  CASE WHEN "Expiry_Date" = 'n/a' OR "Days_Remaining" < 30 THEN 'High' WHEN "Days_Remaining" <= 90 THEN 'Medium'
    ELSE 'Low' END AS "Expiry_Risk",
  greatest(ceil("Daily_Sales" * 7 * 1.5e0) * 3, coalesce("Current_Stock", 0)) AS "Overstock_Level",
  'Analyze' AS "Recommended_Action", 'Unknown' AS "Season", '2001-12-01' AS "Timestamp",
  '2000-12-01' AS "Manufacturing_Date", 88.9e0 AS "_Schema_Compatibility_Pct" FROM raw"""
_MAPPED_COLUMNS = [
    "Product_ID", "SKU", "Product_Name", "Category", "Subcategory", "Brand", "Supplier", "Store_ID", "Store_City",
    "Batch_No", "Purchase_Price", "Selling_Price", "Current_Stock", "Reorder_Level", "Daily_Sales", "Weekly_Demand",
    "Monthly_Demand", "Lead_Time_Days", "Days_Remaining", "Expiry_Risk", "Overstock_Level", "Recommended_Action",
    "Season", "Timestamp", "Manufacturing_Date", "_Schema_Compatibility_Pct",
]
register("mapped_schema", lambda s: standardize(_foreign(s), AS_OF)[0].select(*_MAPPED_COLUMNS), _MAPPED)


def _mapping_report(s: Stages) -> DataFrame:
    df, report = standardize(_foreign(s), AS_OF)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in report.matches])
    filled = F.array(*[F.struct(F.lit(c).alias("canonical_field"), F.col(f"`{c}`").alias("filled_rows"))
                       for c in report.matches])
    return report.to_frame(s.spark).join(F.broadcast(counts.select(F.inline(filled))), "canonical_field")


# The report rows, with the number of rows that hold a value.
register(
    "mapping_report",
    _mapping_report,
    " UNION ALL ".join(
        f"SELECT '{c}' AS canonical_field, '{src}' AS source_column, 'alias' AS method, count({e}) AS filled_rows FROM raw"
        for c, src, e in (
            ("Product_ID", "Item Code", '"Product_ID"'), ("Product_Name", "Description", '"Product_Name"'),
            ("Category", "Department", '"Category"'), ("Batch_No", "Lot Number", '"Batch_No"'),
            ("Purchase_Price", "Unit Cost", "1"), ("Selling_Price", "Retail Price", "1"),
            ("Current_Stock", "Qty", "1"), ("Daily_Sales", "Avg Daily Sales", "1"),
            ("Expiry_Date", "Best Before", "1"),
        )
    ),
)


def _near_names(s: Stages) -> DataFrame:
    """Order lines under names that are like canonical ones without being any of theirs."""
    lines = s.spark.read.parquet(f"{s.data_dir}/lineitem.parquet")
    return lines.select(
        F.col("l_suppkey").alias("Warehouse"), F.col("l_partkey").cast("string").alias("Product"), F.col("l_returnflag").alias("Subcategory"),
        F.col("l_extendedprice").alias("Sell Price"), F.col("l_quantity").alias("Daily Sale"), F.col("l_linestatus").alias("Remarks"),
    )


def _matched(s: Stages, overrides: dict[str, str] | None = None) -> DataFrame:
    """Every field with the column that serves it, how it was found, and how many different values it has then."""
    df, coverage = standardize(_near_names(s), AS_OF, overrides)
    counts = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in coverage.matches])
    values = F.array(*[F.struct(F.lit(c).alias("canonical_field"), F.col(f"`{c}`").alias("different")) for c in coverage.matches])
    return coverage.to_frame(s.spark).join(F.broadcast(counts.select(F.inline(values))), "canonical_field")


_NEAR_NAMES = (
    ("Product_ID", "Product", "fuzzy:0.82", "CAST(l_partkey AS VARCHAR)"), ("Category", "Subcategory", "fuzzy:0.84", "l_returnflag"),
    ("Store_ID", "Warehouse", "fuzzy:0.86", "l_suppkey"), ("Selling_Price", "Sell Price", "fuzzy:0.87", "l_extendedprice"),
    ("Daily_Sales", "Daily Sale", "fuzzy:0.95", "l_quantity"),
)


def _matched_sql(rows) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS canonical_field, '{src}' AS source_column, '{how}' AS method, count(DISTINCT {e}) AS different FROM lineitem"
        for c, src, how, e in rows
    )


register("mapping_fuzzy", _matched, _matched_sql(_NEAR_NAMES))
# An override serves a field that is open, from a column that is free: the last four are neither.
register(
    "mapping_overrides",
    lambda s: _matched(s, {"Brand": "Remarks", "Store_ID": "Remarks", "Supplier": "Warehouse", "SKU": "No Such", "No_Such": "Remarks"}),
    _matched_sql([*_NEAR_NAMES, ("Brand", "Remarks", "override", "l_linestatus")]),
)


def _gaps(s: Stages) -> DataFrame:
    """What a mapping leaves open, one row each, beside the table's row count."""
    df, coverage = standardize(_near_names(s), AS_OF)
    found = {"spare": coverage.spare_columns, "analysis": coverage.analyses, "missing": coverage.missing, "derived": coverage.by("derived")}
    items = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name")) for kind, names in found.items() for name in names])
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min("Weekly_Demand").alias("least_weekly"), F.max("Monthly_Demand").alias("most_monthly")).select(
        F.inline(items), "row_count", "least_weekly", "most_monthly"
    )


register(
    "mapping_gaps",
    _gaps,
    """SELECT kind, name, (SELECT count(*) FROM lineitem) AS row_count, (SELECT min(l_quantity) * 7 FROM lineitem) AS least_weekly,
      (SELECT max(l_quantity) * 30 FROM lineitem) AS most_monthly
    FROM (VALUES ('spare', 'Remarks'), ('missing', 'Current_Stock'), ('missing', 'Purchase_Price'), ('derived', 'Weekly_Demand'), ('derived', 'Monthly_Demand'), ('derived', 'Reorder_Level')) AS gaps(kind, name)""",
)


def _monthly_only(s: Stages) -> DataFrame:
    """Only monthly demand is given: the daily one is derived from it, and the others from that."""
    lines = s.spark.read.parquet(f"{s.data_dir}/lineitem.parquet")
    given = lines.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("Item Code"), F.col("l_quantity").alias("Monthly Sales"))
    return standardize(given, AS_OF)[0].select("Product_ID", "Monthly_Demand", "Daily_Sales", "Weekly_Demand", "Reorder_Level")


register(
    "mapping_monthly_only",
    _monthly_only,
    """SELECT l_orderkey || '-' || l_linenumber AS "Product_ID", l_quantity AS "Monthly_Demand", l_quantity / 30e0 AS "Daily_Sales",
      l_quantity / 30e0 * 7 AS "Weekly_Demand", ceil(l_quantity / 30e0 * 7 * 1.5e0) AS "Reorder_Level" FROM lineitem""",
)


def _numbered(s: Stages) -> DataFrame:
    """Order lines have no column that maps to a product id: ids come from the input order."""
    source = s.spark.read.parquet(f"{s.data_dir}/lineitem.parquet").select(
        F.col("l_quantity").alias("Qty"), F.col("l_extendedprice").alias("MRP"), "l_tax"
    )
    return standardize(source, AS_OF)[0].select("Product_ID", "SKU", "Batch_No", "Current_Stock", "Selling_Price", "l_tax")


register(
    "generated_row_ids",
    _numbered,
    """WITH numbered AS (SELECT row_number() OVER () AS n, l_quantity, l_extendedprice, l_tax FROM lineitem)
    SELECT printf('ROW-%06d', n) AS "Product_ID", printf('ROW-%06d', n) AS "SKU", printf('ROW-%06d', n) AS "Batch_No",
      l_quantity AS "Current_Stock", l_extendedprice AS "Selling_Price", l_tax FROM numbered""",
)

# --- Models --------------------------------------------------------------------------------

register(
    "classification_report",
    lambda s: classification_report(
        s.cleaned.withColumn("by_days", F.when(F.col("Days_Remaining") < 30, "High")
                             .when(F.col("Days_Remaining") <= 90, "Medium").otherwise("Low")),
        "Expiry_Risk", "by_days",
    ),
    over_stages("").rstrip() + """, pairs AS (SELECT "Expiry_Risk" AS actual, CASE WHEN "Days_Remaining" < 30 THEN 'High'
      WHEN "Days_Remaining" <= 90 THEN 'Medium' ELSE 'Low' END AS guess FROM cleaned),
    names AS (SELECT actual AS label FROM pairs UNION SELECT guess FROM pairs),
    classes AS (SELECT label, (SELECT count(*) FROM pairs WHERE actual = label) AS support,
      (SELECT count(*) FROM pairs WHERE guess = label) AS guessed,
      (SELECT count(*) FROM pairs WHERE guess = label AND actual = label) AS hits FROM names),
    scores AS (SELECT label, hits * 1e0 / guessed AS p, hits * 1e0 / support AS r, 2e0 * hits / (support + guessed) AS f,
      support, hits FROM classes)
    SELECT label, round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(f, 6) AS f1_score, support FROM scores
    UNION ALL SELECT 'accuracy', NULL, NULL, round_even(sum(hits) * 1e0 / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scores
    UNION ALL SELECT 'macro avg', round_even(avg(p), 6), round_even(avg(r), 6), round_even(avg(f), 6),
      CAST(sum(support) AS BIGINT) FROM scores
    UNION ALL SELECT 'weighted avg', round_even(sum(p * support) / sum(support), 6),
      round_even(sum(r * support) / sum(support), 6), round_even(sum(f * support) / sum(support), 6),
      CAST(sum(support) AS BIGINT) FROM scores""",
)
register(
    "regression_metrics",
    lambda s: regression_metrics(
        s.cleaned.withColumn("forecast", F.col("Demand_Forecast") / 30), "Daily_Sales", "forecast"
    ),
    """SELECT count(*) AS row_count, round_even(sqrt(avg(("Daily_Sales" - "Demand_Forecast" / 30e0)
        * ("Daily_Sales" - "Demand_Forecast" / 30e0))), 6) AS rmse,
      round_even(1 - avg(("Daily_Sales" - "Demand_Forecast" / 30e0) * ("Daily_Sales" - "Demand_Forecast" / 30e0))
        / var_pop("Daily_Sales"), 6) AS r2 FROM cleaned""",
)
register(
    "stratified_split_sizes",
    lambda s: sp.split_sizes(sp.split(s.stored("Batch_No", "Expiry_Risk"), "Batch_No", "Expiry_Risk"), "Expiry_Risk"),
    """SELECT "Expiry_Risk", is_train, CASE WHEN is_train THEN train ELSE n - train END AS row_count
    FROM (SELECT "Expiry_Risk", count(*) AS n, CAST(floor(count(*) * 0.8) AS BIGINT) AS train FROM cleaned GROUP BY 1)
      CROSS JOIN (VALUES (true), (false)) AS sides(is_train)""",
)
register(
    "random_split_sizes",
    lambda s: sp.split_sizes(sp.split(s.stored("Batch_No"), "Batch_No")),
    """SELECT is_train, CASE WHEN is_train THEN train ELSE n - train END AS row_count
    FROM (SELECT count(*) AS n, CAST(floor(count(*) * 0.8) AS BIGINT) AS train FROM cleaned)
      CROSS JOIN (VALUES (true), (false)) AS sides(is_train)""",
)
register("expiry_model_report", lambda s: tr.evaluate_expiry(s.engineered, s.model("expiry")))
register("demand_model_metrics", lambda s: tr.evaluate_demand(s.engineered, s.model("demand")))
register("revenue_model_metrics", lambda s: tr.evaluate_revenue(s.engineered, s.model("revenue")))
def _coefficients(s: Stages) -> DataFrame:
    """The plain least squares line of the price by three columns that are not collinear, and its rank with a copy of one."""
    lines = s.spark.read.parquet(f"{s.data_dir}/lineitem.parquet").withColumn("copy", F.col("l_tax") * 3 + 1)
    line = fit_line(lines, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    doubled = fit_line(lines, ["l_quantity", "l_discount", "l_tax", "copy"], "l_extendedprice")
    rows = [*line.coefficients.items(), ("intercept", line.intercept)]
    rows += [("rank", float(doubled.rank)), ("tax_in_all", doubled.coefficients["l_tax"] + 3 * doubled.coefficients["copy"])]
    cells = F.array(*[F.struct(F.lit(name).alias("name"), half_even(F.lit(value), 4).alias("value")) for name, value in rows])
    return s.spark.range(1).select(F.inline(cells))


register(
    "least_squares_coefficients",
    _coefficients,
    """WITH m AS (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_quantity, l_tax) AS c,
      covar_pop(l_discount, l_discount) AS d, covar_pop(l_discount, l_tax) AS e, covar_pop(l_tax, l_tax) AS f,
      covar_pop(l_quantity, l_extendedprice) AS x, covar_pop(l_discount, l_extendedprice) AS y, covar_pop(l_tax, l_extendedprice) AS z,
      avg(l_quantity) AS q, avg(l_discount) AS s, avg(l_tax) AS t, avg(l_extendedprice) AS p FROM lineitem),
    w AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
    k AS (SELECT *, (x * (d * f - e * e) - b * (y * f - z * e) + c * (y * e - z * d)) / det AS kq,
      (a * (y * f - z * e) - x * (b * f - c * e) + c * (b * z - c * y)) / det AS ks,
      (a * (d * z - e * y) - b * (b * z - c * y) + x * (b * e - c * d)) / det AS kt FROM w)
    SELECT name, CAST(round_even(value, 4) AS DOUBLE) AS value FROM (SELECT 'l_quantity' AS name, kq AS value FROM k UNION ALL SELECT 'l_discount', ks FROM k
      UNION ALL SELECT 'l_tax', kt FROM k UNION ALL SELECT 'tax_in_all', kt FROM k UNION ALL SELECT 'rank', 3e0
      UNION ALL SELECT 'intercept', p - kq * q - ks * s - kt * t FROM k)""",
)
register(
    "segment_sizes",
    lambda s: an.cluster_sizes(s.model("segment").transform(tr.segment_inputs(tr.training_table(s.engineered)))),
)
register(
    "segment_silhouette",
    lambda s: s.spark.createDataFrame([(tr.silhouette(s.engineered, s.model("segment")),)], "silhouette double"),
)
register("scored_by_models", lambda s: tr.score_by_models(s.kept, s.models, AS_OF))
register(
    "recommendations_by_models", lambda s: rc.recommend(tr.score_by_models(s.kept, s.models, AS_OF))
)


def _stored_models(s: Stages) -> DataFrame:
    folder = s.scratch("models")
    s.models.save(folder)
    loaded = tr.Models.load(folder)
    return rc.impact_summary(tr.score_by_models(s.kept, loaded, AS_OF))


register("impact_summary_by_stored_models", _stored_models)


def _published_round_trip(s: Stages) -> DataFrame:
    """The four published tables, the real class included, to a folder and to a catalog database, and read back.

    Rows, rows that changed, and rows of class A where there is a class. A publication that fails stays unread.
    """
    # All four start from the cleaned rows as stored, which are cleaned once and go when the tables are stored.
    with Scratch(s.spark) as cleaned:
        guessed = sc.scoring_inputs(s.kept, AS_OF).transform(sc.rule_predictions).transform(sc.score_kpis)
        tables, out = published_tables(s.engineered, guessed, rc.recommend(guessed), LOADED_AT), None
    with Scratch(s.spark) as stored:
        tables = {name: written(df, f"published-{name}") for name, df in tables.items()}
    cleaned.drop()
    database = f"published_{uuid.uuid4().hex[:12]}"
    s.spark.sql(f"CREATE DATABASE {database}")
    for sink in (s.scratch("published") + "/", database):
        publish(tables, sink)
        try:
            publish({**tables, "revenue": tables["revenue"].select(F.raise_error(F.lit("stopped")).alias("x"))}, sink)
        except PySparkException:
            back = read_published(s.spark, sink)
        drop_generations(s.spark, sink)  # what the publication that failed has left
        for name in sorted(tables):
            changed = qu.changed_rows(tables[name], back[name])
            first = F.count_if(F.col("ABC_Category") == "A") if "ABC_Category" in back[name].columns else F.lit(None).cast("bigint")
            row = back[name].agg(
                F.lit("folder" if "/" in sink else "database").alias("sink"), F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("table_rows"),
                F.lit(changed).cast("bigint").alias("changed_rows"), first.alias("class_a"),
            )
            row = s.spark.createDataFrame(row.collect(), row.schema)  # the database goes
            out = row if out is None else out.unionByName(row)
        drop_generations(s.spark, sink, keep=0)
    s.spark.sql(f"DROP DATABASE {database} CASCADE")
    stored.drop()
    return out


register(
    "published_round_trip", _published_round_trip,
    """SELECT sink, table_name, table_rows, CAST(0 AS BIGINT) AS changed_rows, class_a FROM (VALUES ('folder'), ('database')) AS sinks(sink) CROSS JOIN (
    SELECT 'inventory' AS table_name, count(*) AS table_rows, count(*) FILTER ("ABC_Category" = 'A') AS class_a FROM engineered
    UNION ALL SELECT 'predictions', count(*), NULL FROM scored UNION ALL SELECT 'revenue', count(*), NULL FROM scored
    UNION ALL SELECT 'recommendations', count(*), NULL FROM advice) AS counts""",
)


def _model_kpis(s: Stages) -> DataFrame:
    """Amount at risk and health, recomputed by SQL text from the written predictions of the models."""
    scored = written(tr.score_by_models(s.kept, s.models, AS_OF), "scored-by-models")
    scored.createOrReplaceTempView("scored_by_models")
    return s.spark.sql("""
    WITH again AS (
        SELECT *, CASE WHEN Predicted_Expiry_Risk IN ('High', 'Medium') THEN rint(Stock_Quantity * Selling_Price * 100) / 100 ELSE 0 END AS risk,
            100 - CASE WHEN Stock_Quantity <= Min_Stock_Level OR Stock_Quantity >= Max_Stock_Level THEN 20 ELSE 0 END
            - CASE Predicted_Expiry_Risk WHEN 'High' THEN 40 WHEN 'Medium' THEN 20 ELSE 0 END
            - CASE WHEN Predicted_Sales_Velocity * 365 / nullif(Stock_Quantity + 1, 0) < 1 THEN 10 ELSE 0 END AS health
        FROM scored_by_models
    )
    SELECT count(*) AS row_count, count_if(NOT risk <=> Predicted_Revenue_at_Risk) AS other_risk,
        count_if(NOT CAST(greatest(least(health, 100), 0) AS INT) <=> Predicted_Inventory_Health) AS other_health,
        count_if(Predicted_Expiry_Risk IS NULL) AS no_risk,
        count_if(Predicted_Revenue IS NULL OR Predicted_Revenue < 0 OR Predicted_Sales_Velocity < 0) AS below_zero,
        count_if(Predicted_Cluster IS NULL OR Predicted_Cluster NOT BETWEEN 0 AND 3) AS no_segment
    FROM again""")


register(
    "kpis_of_model_predictions", _model_kpis,
    """SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS other_risk, CAST(0 AS BIGINT) AS other_health, CAST(0 AS BIGINT) AS no_risk,
    CAST(0 AS BIGINT) AS below_zero, CAST(0 AS BIGINT) AS no_segment FROM cleaned""",
)


def _loaded_models(s: Stages) -> DataFrame:
    """Lines on which stored and loaded models answer otherwise than the fitted ones."""
    folder = s.scratch("models")
    s.models.save(folder)
    answers = ["Predicted_Expiry_Risk", "Predicted_Sales_Velocity", "Predicted_Revenue", "Predicted_Cluster"]
    prepared = sc.score_prep(s.kept, AS_OF)
    one, two = (tr.apply_models(prepared, m).select("Batch_No", F.struct(*answers).alias(name)) for m, name in ((s.models, "fitted"), (tr.Models.load(folder), "loaded")))
    return one.join(two, "Batch_No").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(~F.col("fitted").eqNullSafe(F.col("loaded"))).alias("different"))


register("loaded_models_answer_alike", _loaded_models, "SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS different FROM cleaned")


def _segments_again(s: Stages) -> DataFrame:
    """Sizes and silhouette from the written assignments by SQL text, beside the library's own."""
    model = s.model("segment")
    assigned = model.transform(tr.segment_inputs(tr.training_table(s.engineered)))
    written(assigned.select("Predicted_Cluster", vector_to_array("features").alias("v")), "assigned").createOrReplaceTempView("assigned")
    own = tr.silhouette(s.engineered, model)
    # Mean squared distance to a cluster = |x|^2 + mean |y|^2 - 2 x . mean y.
    return s.spark.sql(f"""
    WITH points AS (SELECT Predicted_Cluster AS c, v, aggregate(v, 0D, (t, x) -> t + x * x) AS q FROM assigned),
    parts AS (SELECT c, count(*) AS n, avg(q) AS mean_q, array(avg(v[0]), avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])) AS mean_v FROM points GROUP BY c),
    far AS (
        SELECT p.c, p.v, p.q, d.c AS other, d.n, p.q + d.mean_q - 2 * aggregate(zip_with(p.v, d.mean_v, (x, y) -> x * y), 0D, (t, x) -> t + x) AS dist
        FROM points p JOIN parts d ON d.c <> p.c
    ),
    near AS (SELECT c, v, q, min(dist) AS b, count(*) AS copies FROM far GROUP BY c, v, q),
    own AS (
        SELECT n.c, n.v, n.b, p.n, (n.q + p.mean_q - 2 * aggregate(zip_with(n.v, p.mean_v, (x, y) -> x * y), 0D, (t, x) -> t + x)) * p.n / greatest(p.n - 1, 1) AS a
        FROM near n JOIN parts p ON n.c = p.c
    ),
    worth AS (SELECT c, v, CASE WHEN n = 1 THEN 0D WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0D END AS s FROM own),
    total AS (SELECT avg(w.s) AS s, count(*) AS n FROM points p JOIN worth w ON p.c = w.c AND p.v = w.v)
    SELECT n AS row_count, abs(s - {own!r}D) < 1e-6 AS same_silhouette, (SELECT count(*) FROM parts) AS segments FROM total""")


register("segments_recomputed", _segments_again, "SELECT count(*) AS row_count, true AS same_silhouette, CAST(4 AS BIGINT) AS segments FROM cleaned")


def _segment_names(s: Stages) -> DataFrame:
    """Names of the segments, with whether the written assignments bear them out."""
    assigned = s.model("segment").transform(tr.segment_inputs(tr.training_table(s.engineered)))
    assigned = written(assigned.select("Predicted_Cluster", "Inventory_Value", "Sales_Velocity"), "assigned")
    names = segment_names(assigned)
    total = F.sum("row_count").over(Window.partitionBy())
    fast, high = F.col("Segment_Name").startswith("Fast"), F.col("Segment_Name").endswith("High Value")
    half = Window.partitionBy(high)
    least_high = F.min(F.when(high, F.col("mean_value"))).over(Window.partitionBy())
    most_low = F.max(F.when(~high, F.col("mean_value"))).over(Window.partitionBy())
    faster = F.max("mean_velocity").over(half) == F.col("mean_velocity")
    return names.select("Segment_Name", total.alias("row_count"), ((least_high >= most_low) & (faster == fast)).alias("borne_out"))


register(
    "segment_names", _segment_names,
    """SELECT name AS "Segment_Name", (SELECT count(*) FROM cleaned) AS row_count, true AS borne_out
    FROM (VALUES ('Fast Moving High Value'), ('Slow Moving High Value'), ('Fast Moving Low Value'), ('Dead Stock')) AS names(name)""",
)
