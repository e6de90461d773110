"""Quality of predictions, from one pass over labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import half_even


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows.

    The rows are reduced to the confusion counts first; all the rest works on a
    table with one row per pair of classes.
    """
    pairs = df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("guess")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # Both structs have the same types as they are: a cast of a whole struct fixes which fields are never null, and a plan
    # in which the optimizer finds otherwise is refused.
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("actual") == F.col("guess"), F.col("n")).otherwise(none)
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), none.alias("guessed"),
                 hit.alias("hits")),
        F.struct(F.col("guess").alias("label"), none.alias("support"), F.col("n").alias("guessed"),
                 none.alias("hits")),
    )
    classes = pairs.select(F.inline(sides)).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits")
    )

    def share(numerator: Column, denominator: Column) -> Column:
        return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))

    hits, support, guessed = F.col("hits"), F.col("support"), F.col("guessed")
    classes = classes.select(
        "label", share(hits, guessed).alias("precision"), share(hits, support).alias("recall"),
        share(hits * 2, support + guessed).alias("f1_score"), "support", "hits", F.lit(False).alias("rest"),
    )
    scores = ("precision", "recall", "f1_score")
    # A row of nulls, so that a table without rows has the last three rows, too. The classes themselves and all of them
    # together are groups of one aggregate: `df` is read once.
    rest = df.sparkSession.range(1).select(F.lit(True).alias("rest"))
    groups = classes.unionByName(rest, allowMissingColumns=True).groupingSets([["label", "rest"], []], "label", "rest").agg(
        F.grouping("rest").alias("together"), *[F.avg(s).alias(s) for s in scores],
        *[share(F.sum(F.col(s) * support), F.sum("support")).alias(f"weighted_{s}") for s in scores],
        share(F.sum("hits"), F.sum("support")).alias("accuracy"), F.sum("support").alias("support"),
    )
    nothing = F.lit(None).cast("double")

    def row(label: Column, *values: Column) -> Column:
        return F.struct(label.cast("string").alias("label"), *[v.alias(s) for v, s in zip(values, scores, strict=True)], "support")

    means = [F.col(s) for s in scores]
    overall = F.array(
        row(F.lit("accuracy"), nothing, nothing, F.col("accuracy")), row(F.lit("macro avg"), *means),
        row(F.lit("weighted avg"), *[F.col(f"weighted_{s}") for s in scores]),
    )
    report = groups.filter("together = 1 or not rest").select(
        F.inline(F.when(F.col("together") == 1, overall).otherwise(F.array(row(F.col("label"), *means))))
    )
    return report.select("label", *[half_even(F.col(s), 6).alias(s) for s in scores], "support")


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Root mean squared error and coefficient of determination."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    both = df.filter(y.isNotNull() & p.isNotNull()).select(y.alias("y"), p.alias("p"))
    sums = both.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("mse"),
        F.var_pop("y").alias("variance"),
    )
    r2 = (
        F.when(F.col("variance") > 0, F.lit(1.0) - F.col("mse") / F.col("variance"))
        .when(F.col("mse") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return sums.select("row_count", half_even(F.sqrt("mse"), 6).alias("rmse"), half_even(r2, 6).alias("r2"))
