"""Pareto ranking of lines by value: ABC class and running share.

The order is value descending, then a hash of the line key, then the key. The
hash makes the order of equal values arbitrary but fixed, and lets a large group
of equal values be split evenly by hash prefix.

A running sum over one global window would sort the whole table in one task.
Both operators avoid that:

* `abc_class` needs only the places where the running sum passes 80 % and 95 % of the total. One aggregate builds
  a radix histogram: number and exact sum of the values by their leading digits. It tells the digits at which each
  limit is passed, and only the rows with these digits are looked at again. No row is shuffled or sorted.
* `running_share` sorts the rows by ranges once, adds up each range by itself, and adds what earlier ranges hold.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from shelflight.functions.numeric import UNIT_DIGITS, digits_for, is_amount, to_units, units_to_amount
from shelflight.session import written

# Share of the total value, in percent, up to which a line is A or B.
CLASS_LIMITS = (("A", 80), ("B", 95))

_WIDE = "decimal(38,0)"
# Leading digits of the first histogram: at most 9,000 groups for each length of a number, half a million in all.
_DIGITS = 4
# Digits, of values and then of key hashes, by which a group that is still too large is divided: a million groups.
_MORE, _HASH_DIGITS = 6, 5
# A group of so many rows is small enough to be read in order by one task.
_FEW = 1_000_000


@dataclass(frozen=True)
class Boundaries:
    """For each class the first line beyond it (value `u`, hash `h`, key `k`), in units of 10 ** -digits."""

    edges: dict[str, Row | None]
    total: Decimal
    digits: int


@dataclass(frozen=True)
class _Search:
    """Where a limit is passed: rows of table `of` with values from `lo` to `hi` and keys whose hash starts with `hashed`."""

    item: int
    of: int
    limit: int
    total: Decimal
    base: Decimal
    lo: Decimal
    hi: Decimal
    n: int
    hashed: str = ""
    digits: int = _DIGITS

    def rows(self) -> Column:
        inside = (F.col("of") == self.of) & F.col("u").between(self.lo, self.hi)
        return inside & F.md5("k").startswith(self.hashed) if self.hashed else inside

    def place(self) -> tuple[Column, Column, Column]:
        """Value (falling), hash and key by which the rows are grouped next."""
        h, none = F.md5("k"), F.lit(None).cast("string")
        if self.n <= _FEW or len(self.hashed) >= 32:
            return F.col("u").cast("decimal(28,0)"), h, F.col("k")
        if self.lo < self.hi:
            return _value_prefix(F.col("u"), self.digits + _MORE), none, none
        return F.col("u").cast("decimal(28,0)"), F.left(h, F.lit(len(self.hashed) + _HASH_DIGITS)), none


def _value_prefix(units: Column, digits: int) -> Column:
    """`units` with all but the leading digits set to zero; keeps the order."""
    more = F.greatest(F.length(F.abs(units).cast("string")) - digits, F.lit(0))
    step = F.rpad(F.lit("1"), more + 1, F.lit("0")).cast("decimal(27,0)")
    return (units - F.pmod(units, step)).cast("decimal(28,0)")


def _key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def _facts() -> list[Column]:
    # A unit amount has 26 digits, so a sum of 38 has room for 10^12 rows of the largest.
    return [
        F.sum(F.col("u").cast("decimal(28,0)")).cast(_WIDE).alias("s"), F.count(F.lit(1)).alias("n"),
        F.min("u").alias("lo"), F.max("u").alias("hi"),
    ]


def _crossed(groups: DataFrame, order: list[Column], carry: list[str]) -> DataFrame:
    """First group, per item, whose running sum passes the limit.

    `groups` has columns item, limit (percent), total, base (sum of all earlier rows) and s (sum of the group).
    """
    ordered = Window.partitionBy("item").orderBy(*order)
    running = F.col("base") + F.sum("s").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast(_WIDE)
    sign = F.signum(F.col("total"))
    crossed = (F.col("running") * 100 - F.col("total") * F.col("limit")) * sign > 0
    return (
        groups.withColumns({"running": running, "position": F.row_number().over(ordered)})
        .filter(crossed)
        .withColumn("base", (F.col("running") - F.col("s")).cast(_WIDE))
        .groupBy("item", "limit")
        .agg(*[F.min_by(c, "position").alias(c) for c in ("total", "base", *carry)])
    )


def _boundaries(rows: DataFrame) -> DataFrame:
    """Per table (`of`) and limit, the group of the radix histogram at which the limit is passed.

    The histogram is one aggregate with map-side combine. A row without limit has the number of amounts that are
    too large for these units.
    """
    rows = rows if "of" in rows.columns else rows.withColumn("of", F.lit(0))
    histogram = rows.groupBy("of", _value_prefix(F.col("u"), _DIGITS).alias("p")).agg(*_facts())
    total = F.sum("s").over(Window.partitionBy("of")).cast(_WIDE)
    percents = [percent for _, percent in CLASS_LIMITS]
    limits = F.posexplode(F.array(*[F.lit(percent) for percent in percents])).alias("at", "limit")
    groups = histogram.filter("p is not null").withColumns({"total": total, "base": F.lit(0).cast(_WIDE)}).select("*", limits)
    groups = groups.withColumn("item", F.col("of") * len(percents) + F.col("at"))
    found = _crossed(groups, [F.col("p").desc()], ["of", "lo", "hi", "n"])
    return found.unionByName(histogram.filter("p is null").select("of", "n"), allowMissingColumns=True)


def _narrowed(rows: DataFrame, searches: list[_Search]) -> DataFrame:
    """One step further into each group: the same histogram by more digits, or the rows themselves in order."""
    kind = "struct<item:int,limit:int,total:decimal(38,0),base:decimal(38,0),g:decimal(28,0),h:string,k:string>"

    def match(search: _Search) -> Column:
        g, h, k = search.place()
        known = [F.lit(search.item), F.lit(search.limit), F.lit(search.total).cast(_WIDE), F.lit(search.base).cast(_WIDE)]
        return F.when(search.rows(), F.struct(*known, g, h, k).cast(kind))

    any_of = searches[0].rows()
    for search in searches[1:]:
        any_of = any_of | search.rows()
    matched = F.inline(F.array_compact(F.array(*map(match, searches))))
    inside = rows.filter(any_of).select("u", matched)
    groups = inside.groupBy("item", "limit", "total", "base", "g", "h", "k").agg(*_facts())
    return _crossed(groups, [F.col("g").desc(), F.col("h").asc(), F.col("k").asc()], ["lo", "hi", "n", "g", "h", "k"])


def find_boundaries(tables: Mapping[str, tuple[DataFrame, str]], key: str) -> dict[str, Boundaries]:
    """The class boundaries of every (table, value column), all in one search. Runs jobs.

    Every job reads value and key of the tables, and nothing else: the first builds the histogram, the next look at
    the rows near the limits, most often only one. Tables should be stored, or cheap. What comes back to the driver
    is one row per table and limit.
    """
    digits = dict.fromkeys(tables, UNIT_DIGITS)

    def rows() -> DataFrame:
        parts = [
            df.filter(is_amount(F.col(value))).select(F.lit(i).alias("of"), to_units(F.col(value), digits[name]).alias("u"), _key_text(F.col(key)).alias("k"))
            for i, (name, (df, value)) in enumerate(tables.items())
        ]
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        return both

    first = _boundaries(rows()).collect()
    names = list(tables)
    large = {names[row["of"]] for row in first if row["limit"] is None and row["n"]}
    if large:
        for name in large:
            df, value = tables[name]
            digits[name] = digits_for(df.filter(is_amount(F.col(value))).agg(F.max(F.abs(F.col(value)))).first()[0])
        first = _boundaries(rows()).collect()
    known = {row["item"]: row for row in first if row["limit"] is not None}
    searches = [_Search(i, r["of"], r["limit"], r["total"], r["base"], r["lo"], r["hi"], r["n"]) for i, r in known.items()]
    edges: dict[int, Row] = {}
    while searches:
        further = []
        for row in _narrowed(rows(), searches).collect():
            before = next(s for s in searches if s.item == row["item"])
            if row["k"] is not None:
                edges[row["item"]] = Row(u=row["lo"], h=row["h"], k=row["k"])
                continue
            deeper = before.digits + (_MORE if row["h"] is None else 0)
            further.append(_Search(
                before.item, before.of, before.limit, before.total, row["base"], row["lo"], row["hi"], row["n"], row["h"] or "", deeper
            ))
        searches = further
    out = {}
    for i, name in enumerate(names):
        mine = {class_name: edges.get(i * len(CLASS_LIMITS) + at) for at, (class_name, _) in enumerate(CLASS_LIMITS)}
        total = next((r["total"] for r in known.values() if r["of"] == i), Decimal(0))
        out[name] = Boundaries(mine, total, digits[name])
    return out


def abc_boundaries(df: DataFrame, value: str, key: str) -> Boundaries:
    """The class boundaries of one table. Runs jobs."""
    return find_boundaries({"": (df, value)}, key)[""]


def abc_class(
    df: DataFrame, value: str, key: str, zero_total: str, negative_total: str | None = None, boundaries: Boundaries | None = None
) -> DataFrame:
    """Add `ABC_Category`: A up to 80 % of the running value share, B to 95 %, else C.

    A line without value is C; NaN and infinity are no values. When all lines together are worth nothing there
    is no share, and every line gets `zero_total`; when they are worth less than
    nothing, `negative_total` if given. Without `boundaries`, runs the jobs that find them;
    the classification itself is a comparison per row.
    """
    found = boundaries or abc_boundaries(df, value, key)
    if not any(found.edges.values()):
        return df.withColumn("ABC_Category", F.lit(zero_total))
    if negative_total is not None and found.total < 0:
        return df.withColumn("ABC_Category", F.lit(negative_total))
    units, name = to_units(F.col(value), found.digits), _key_text(F.col(key))
    hashed = F.md5(name)

    def before(edge: Row) -> Column:
        same_value = (hashed < edge["h"]) | ((hashed == edge["h"]) & (name < edge["k"]))
        return (units > edge["u"]) | ((units == edge["u"]) & same_value)

    category = F.when(units.isNull(), F.lit("C"))
    for class_name, edge in found.edges.items():
        category = category.when(before(edge) if edge is not None else F.lit(True), F.lit(class_name))
    return df.withColumn("ABC_Category", category.otherwise(F.lit("C")))


def running_share(df: DataFrame, value: str, key: str) -> DataFrame:
    """Add `Running_Value` and `Running_Share`, inclusive of the row itself.

    The rows are sorted by ranges of value, key hash and key and written; rows that share all three are spread over
    ranges by a hash of their place. Each range is then added up by itself, and what earlier ranges hold, one row
    per range, is added back: two shuffles of the rows, whatever share of them one value has. Pass only the columns
    wanted: all of them are written, twice. Rows without a value have neither. Runs jobs.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64(F.monotonically_increasing_id())
    keyed = written(df.withColumns({"_k": _key_text(F.col(key)), "_spread": spread}), "keyed")
    largest = keyed.filter(is_amount(F.col(value))).agg(F.max(F.abs(F.col(value)))).first()[0]
    digits = digits_for(largest)
    order = [F.col("_u").desc_nulls_last(), F.col("_h").asc(), F.col("_k").asc(), F.col("_spread").asc()]
    ranges = keyed.withColumns({"_u": to_units(F.col(value), digits), "_h": F.md5("_k")}).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ranges = written(ranges.drop("_h", "_k", "_spread").withColumn("_place", F.monotonically_increasing_id()), "ranges")
    ranges = ranges.withColumn("_range", F.shiftright("_place", 33))

    units = F.col("_u").cast("decimal(28,0)")
    sums = ranges.groupBy("_range").agg(F.sum(units).cast(_WIDE).alias("s"))
    earlier = F.sum("s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("s").over(Window.partitionBy())
    before = sums.select("_range", F.coalesce(earlier, F.lit(0)).cast(_WIDE).alias("_before"), total.cast(_WIDE).alias("_total"))
    inside = F.sum(units).over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    running = F.when(F.col("_u").isNotNull(), (F.col("_before") + F.col("_inside").cast(_WIDE)).cast(_WIDE))
    return (
        ranges.repartition(tasks, "_range")
        .withColumn("_inside", inside)
        .join(F.broadcast(before), "_range")  # one row per range
        .withColumn("_running", running)
        .withColumn("Running_Value", units_to_amount(F.col("_running"), digits))
        .withColumn("Running_Share", F.try_divide(F.col("_running").cast("double"), F.col("_total").cast("double")))
        .drop("_u", "_place", "_range", "_inside", "_before", "_total", "_running")
    )
