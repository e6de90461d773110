"""The stages in order: as plans on top of one another, or each written and read back."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelflight.operators.cleaning import clean
from shelflight.operators.features import engineer, valued_features
from shelflight.operators.mapping import Coverage, standardize
from shelflight.operators.pareto import Boundaries, find_boundaries
from shelflight.operators.recommend import impact_summary, recommend
from shelflight.operators.scoring import score_by_rules, scoring_inputs
from shelflight.operators.training import Models, score_by_models
from shelflight.schema import LINE_KEY
from shelflight.sources.publish import publish, published_tables
from shelflight.sources.readers import read_summary
from shelflight.sources.writers import write_csv, write_parquet, write_summary


@dataclass
class Run:
    """Tables of one run, computed when they are read or written."""

    cleaned: DataFrame
    engineered: DataFrame
    scored: DataFrame
    recommendations: DataFrame
    summary: DataFrame
    report: Coverage | None = None


def class_boundaries(cleaned: DataFrame, as_of: str | dt.date, key: str) -> dict[str, Boundaries]:
    """Class boundaries by the values of the features and by those of the scores, in one search. Runs jobs."""
    tables = {"features": valued_features(cleaned, as_of), "scores": scoring_inputs(cleaned, as_of)}
    return find_boundaries({name: (df, "Inventory_Value") for name, df in tables.items()}, key)


def plan_run(
    raw: DataFrame,
    as_of: str | dt.date,
    models: Models | None = None,
    map_columns: bool = False,
    overrides: Mapping[str, str] | None = None,
    key: str = LINE_KEY,
) -> Run:
    """Clean, engineer, score and recommend. Without models the rules score.

    Not lazy throughout: one search for the boundaries of the Pareto class, of features and scores together,
    runs jobs over the cleaned rows here. `execute_run` stores the cleaned rows first; with this function, pass `raw`
    from a stored table that is cheap to clean again.
    """
    report = None
    if map_columns:
        raw, report = standardize(raw, as_of, overrides)
    cleaned = clean(raw)
    found = class_boundaries(cleaned, as_of, key)
    scored = _score(cleaned, as_of, models, key, found["scores"])
    return Run(
        cleaned=cleaned,
        engineered=engineer(cleaned, as_of, key, found["features"]),
        scored=scored,
        recommendations=recommend(scored),
        summary=impact_summary(scored),
        report=report,
    )


def _score(cleaned: DataFrame, as_of: str | dt.date, models: Models | None, key: str, boundaries: Boundaries) -> DataFrame:
    if models:
        return score_by_models(cleaned, models, as_of, key, boundaries)
    return score_by_rules(cleaned, as_of, key, boundaries)


def execute_run(
    raw: DataFrame,
    as_of: str | dt.date,
    out: str,
    loaded_at: dt.datetime,
    models: Models | None = None,
    sink: str | None = None,
    key: str = LINE_KEY,
    overrides: Mapping[str, str] | None = None,
    map_columns: bool = False,
) -> Run:
    """Write every stage under `out` and publish the tables. Runs jobs.

    Each stage is written once and read back by the next, so a lost executor
    costs at most one stage, and the reports read only the columns they need.
    """
    spark = raw.sparkSession
    report = None
    if map_columns:
        raw, report = standardize(raw, as_of, overrides)

    def stage(name: str, df: DataFrame) -> DataFrame:
        write_parquet(df, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    cleaned = stage("cleaned", clean(raw))
    found = class_boundaries(cleaned, as_of, key)
    engineered = stage("engineered", engineer(cleaned, as_of, key, found["features"]))
    scored = stage("scored", _score(cleaned, as_of, models, key, found["scores"]))
    advice = stage("recommendations", recommend(scored))
    write_csv(advice, f"{out}/recommendations_csv")
    write_summary(impact_summary(scored), f"{out}/summary")
    summary = read_summary(spark, f"{out}/summary")
    tables = published_tables(engineered, scored, advice, loaded_at)
    publish(tables, sink or f"{out}/published/")
    return Run(cleaned, engineered, scored, advice, summary, report)
