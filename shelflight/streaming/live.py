"""Recommendations for inventory lines as they arrive.

Cleaning without the duplicate removal, scoring without the Pareto class and the
recommendations look at one row at a time. The same functions therefore take a
streaming table and need neither state nor watermark.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelflight.operators import cleaning as cl
from shelflight.operators.recommend import recommend
from shelflight.operators.scoring import rule_predictions, score_kpis, scoring_inputs


def live_recommendations(lines: DataFrame, as_of: str | dt.date) -> DataFrame:
    cleaned = (
        lines.transform(cl.numbers_from_text)
        .transform(cl.nulls_for_nan)
        .transform(cl.fill_missing)
        .transform(cl.drop_invalid)
        .transform(cl.standardize_text)
        .transform(cl.convert_dates)
        .transform(cl.apply_business_rules)
        .transform(cl.cast_types)
    )
    return cleaned.transform(scoring_inputs, as_of).transform(rule_predictions).transform(score_kpis).transform(recommend)


def write_live(recommendations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet files, exactly once, until the available input is used up."""
    return (
        recommendations.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
