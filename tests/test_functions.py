import datetime as dt
import math
import random
import time

from pyspark.sql import functions as F

from shelflight.functions import (
    contains_literal, decimal_round, fixed_point, half_even, number_text, parse_timestamp, strip_whitespace,
    title_case, to_number,
)


def _apply(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_title_case_as_in_python(spark):
    texts = ["Levi's", "T-SHIRT", "501abc", "\tpadded\n", "two  words", "a1b2", "ÉCLAIR au chocolat", "x.y", "", None]
    assert _apply(spark, texts, "string", lambda c: title_case(strip_whitespace(c))) == [
        t if t is None else t.strip().title() for t in texts
    ]


def test_title_case_finds_the_odd_texts_among_plain_ones(spark):
    generator = random.Random(7)
    texts = ["".join(generator.choice("aBz 1#'.-_éØ\t") for _ in range(generator.randrange(6))) for _ in range(2000)]
    assert _apply(spark, texts, "string", title_case) == [t.title() for t in texts]


def test_title_case_of_plain_text_costs_a_few_times_its_lower_case(spark):
    lines = spark.range(0, 400_000, 1, 8).select(F.concat(F.lit("large blue widget "), F.col("id").cast("string")).alias("v"))

    def seconds(build):
        taken = []
        for _ in range(4):
            start = time.perf_counter()
            lines.select(*[build(F.concat(F.col("v"), F.lit(f" {i}"))).alias(f"c{i}") for i in range(8)]).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        return min(taken)

    assert seconds(title_case) < 20 * seconds(F.lower)


def test_rounding_as_in_python(spark):
    generator = random.Random(3)
    values = [2.675, 0.125, 1.005, 0.35, 0.25, -2.675, 1e9 + 0.005, 0.0]
    values += [generator.randrange(10**7) / 1000 for _ in range(500)]
    assert _apply(spark, values, "double", lambda c: decimal_round(c, 2)) == [round(v, 2) for v in values]
    assert _apply(spark, values, "double", lambda c: fixed_point(c, 1)) == [f"{v:.1f}".replace("-0.0", "0.0") for v in values]


def test_array_style_rounding(spark):
    assert _apply(spark, [2.675, 0.125, 0.375], "double", lambda c: half_even(c, 2)) == [2.68, 0.12, 0.38]


def test_lenient_numbers(spark):
    texts = ["1.5", " 2 ", "x", "", "12d", "nan", "1e3", None]
    assert _apply(spark, texts, "string", lambda c: to_number(c, "string", 0)) == [1.5, 2.0, 0, 0, 0, 0, 1000.0, 0]
    assert _apply(spark, [math.nan, 1.0, None], "double", lambda c: to_number(c, "double")) == [None, 1.0, None]


def test_dates_row_by_row(spark):
    texts = ["2024-03-04", "2024/03/04", "04/03/2024", "25/12/2024", "2024-03-04 10:15:00", "n/a", "31/02/2024", None]
    day_first = _apply(spark, texts, "string", lambda c: parse_timestamp(c, "string", True))
    march = dt.datetime(2024, 3, 4)
    assert day_first == [march, march, march, dt.datetime(2024, 12, 25), dt.datetime(2024, 3, 4, 10, 15), None, None, None]
    month_first = _apply(spark, texts, "string", lambda c: parse_timestamp(c, "string", False))
    assert month_first[2:4] == [dt.datetime(2024, 4, 3), dt.datetime(2024, 12, 25)]


def test_search_is_literal(spark):
    assert _apply(spark, ["50% off", "50x off"], "string", lambda c: contains_literal(c, " 50% ")) == [True, False]


def test_number_text(spark):
    assert _apply(spark, [45.0, 2.5], "double", lambda c: number_text(c, "double")) == ["45.0", "2.5"]
    assert _apply(spark, [45], "bigint", lambda c: number_text(c, "bigint")) == ["45"]
