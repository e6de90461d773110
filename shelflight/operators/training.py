"""The four models: expiry risk, demand, revenue and segments, on pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.functions import half_even, ratio_or_zero
from shelflight.operators.features import alias_if_missing, coerce_numbers, zero_missing_numbers
from shelflight.operators.least_squares import fit_line
from shelflight.operators.metrics import classification_report, regression_metrics
from shelflight.operators.pareto import Boundaries
from shelflight.operators.scoring import predicted_turnover, score_kpis, score_prep, segment_margin
from shelflight.operators.segments import assigning, fit_centres
from shelflight.operators.splits import SEED, split
from shelflight.operators.trees import fit_boosted, fit_forest
from shelflight.schema import LEGACY_NAMES, LINE_KEY
from shelflight.session import ensure_checkpoint_dir

# Columns the models read as numbers.
TRAINING_NUMBERS = (
    "Purchase_Price", "Selling_Price", "Current_Stock", "Reorder_Level", "Daily_Sales", "Weekly_Demand",
    "Monthly_Demand", "Demand_Forecast", "Days_Remaining", "Revenue_At_Risk", "Recovered_Revenue", "Waste_Cost",
)

# Inputs and settings of the models.
EXPIRY_CATEGORIES = ["Category", "Brand"]
EXPIRY_NUMBERS = ["Cost_Price", "Selling_Price", "Stock_Quantity", "Min_Stock_Level", "Sales_Velocity"]
DEMAND_CATEGORIES = ["Category", "ABC_Category"]
DEMAND_NUMBERS = ["Cost_Price", "Selling_Price", "Stock_Quantity", "Min_Stock_Level", "Max_Stock_Level"]
REVENUE_NUMBERS = [
    "Cost_Price", "Selling_Price", "Stock_Quantity", "Sales_Velocity", "Past_Sales_Volume", "Inventory_Value",
]
SEGMENT_NUMBERS = [
    "Inventory_Value", "Sales_Velocity", "Past_Sales_Volume", "Inventory_Turnover", "Profit_Margin",
]
FOREST_TREES, FOREST_DEPTH = 100, 10
BOOST_ROUNDS, BOOST_RATE, BOOST_DEPTH = 100, 0.08, 5
SEGMENTS, SEGMENT_STARTS = 4, 10


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing model features: {missing}; available columns: {df.columns}")


def training_table(df: DataFrame) -> DataFrame:
    """Numbers coerced, names aliased, value and margin columns derived where absent."""
    df = coerce_numbers(df.toDF(*[c.strip() for c in df.columns]), TRAINING_NUMBERS)
    df = alias_if_missing(df, LEGACY_NAMES)
    purchase, selling, stock = F.col("Purchase_Price"), F.col("Selling_Price"), F.col("Current_Stock")
    derived = {
        "Inventory_Value": stock * purchase,
        "Revenue": F.col("Daily_Sales") * selling,
        "Profit": F.col("Daily_Sales") * (selling - purchase),
        "Profit_Margin": ratio_or_zero(selling - purchase, selling) * 100,
        "Inventory_Turnover": ratio_or_zero(F.col("Monthly_Demand").cast("double"), stock),
        "ABC_Category": F.lit("C"),
    }
    df = df.withColumns({name: value for name, value in derived.items() if name not in df.columns})
    return df.transform(zero_missing_numbers)


def _scaling(numbers: list[str]) -> list:
    return [
        VectorAssembler(inputCols=numbers, outputCol="numbers", handleInvalid="error"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["scaled"], outputCol="features"),
    ]


@dataclass
class Models:
    expiry: PipelineModel
    demand: PipelineModel
    revenue: PipelineModel
    segment: PipelineModel

    def save(self, folder: str) -> None:
        for name, model in vars(self).items():
            model.write().overwrite().save(f"{folder}/{name}")

    @classmethod
    def load(cls, folder: str) -> Models:
        """All four, or an error naming the ones that are not there."""
        loaded, missing = {}, []
        for name in ("expiry", "demand", "revenue", "segment"):
            try:
                loaded[name] = PipelineModel.load(f"{folder}/{name}")
            except (Py4JJavaError, PySparkException) as error:  # what the reader raises, by file system
                missing.append(f"{name} ({type(error).__name__})")
        if missing:
            raise FileNotFoundError(f"models not readable under {folder}: {', '.join(missing)}; train them first")
        return cls(**loaded)


def fit_expiry(train: DataFrame, key: str = LINE_KEY) -> PipelineModel:
    """Random forest that answers with the class name."""
    require_columns(train, EXPIRY_CATEGORIES + EXPIRY_NUMBERS + ["Expiry_Risk", key])
    forest = fit_forest(
        train, EXPIRY_CATEGORIES, EXPIRY_NUMBERS, "Expiry_Risk", key, "Predicted_Expiry_Risk",
        trees=FOREST_TREES, depth=FOREST_DEPTH, seed=SEED,
    )
    return PipelineModel(stages=[forest])


def fit_demand(train: DataFrame, key: str = LINE_KEY) -> PipelineModel:
    """Gradient-boosted trees for the daily velocity."""
    require_columns(train, DEMAND_CATEGORIES + DEMAND_NUMBERS + ["Sales_Velocity", key])
    trees = fit_boosted(
        train, DEMAND_CATEGORIES, DEMAND_NUMBERS, "Sales_Velocity", key, "Predicted_Sales_Velocity",
        rounds=BOOST_ROUNDS, rate=BOOST_RATE, depth=BOOST_DEPTH,
    )
    return PipelineModel(stages=[trees])


def fit_revenue(train: DataFrame) -> PipelineModel:
    """Plain least squares from one aggregate over the rows.

    Velocity and volume are proportional in most tables; the solution of least norm on scaled inputs shares the
    weight between the two.
    """
    require_columns(train, REVENUE_NUMBERS + ["Revenue"])
    return PipelineModel(stages=[fit_line(train, REVENUE_NUMBERS, "Revenue").stage("Predicted_Revenue")])


def segment_inputs(df: DataFrame) -> DataFrame:
    """The five segment features, the same for training and for scoring.

    Turnover and margin follow the scoring formulas. `Predicted_Sales_Velocity`
    is used where it is there, the recorded velocity otherwise.
    """
    if "Predicted_Sales_Velocity" not in df.columns:
        df = df.withColumn("Predicted_Sales_Velocity", F.col("Sales_Velocity").cast("double"))
    return df.withColumns(
        {
            "Inventory_Turnover": F.coalesce(predicted_turnover(), F.lit(0.0)),
            "Profit_Margin": segment_margin(),
            "Sales_Velocity": F.col("Predicted_Sales_Velocity"),
        }
    )


def fit_segments(df: DataFrame) -> PipelineModel:
    """K-means on scaled features, the best of ten starts, all of which pass over the rows together."""
    require_columns(df, SEGMENT_NUMBERS)
    prepare = Pipeline(stages=_scaling(SEGMENT_NUMBERS)).fit(df)
    scaler = next(stage for stage in prepare.stages if isinstance(stage, StandardScalerModel))
    means, deviations = scaler.mean.toArray(), scaler.std.toArray()
    scaled = [
        ((F.col(c).cast("double") - F.lit(float(m))) * F.lit(1 / float(d) if d else 0.0)).alias(f"x{i}")
        for i, (c, m, d) in enumerate(zip(SEGMENT_NUMBERS, means, deviations, strict=True))
    ]
    with _kept(df.select(*scaled)) as points:
        centres, _ = fit_centres(points, SEGMENTS, SEGMENT_STARTS, seed=SEED)
    return PipelineModel(stages=[*prepare.stages, assigning(SEGMENT_NUMBERS, means, deviations, centres, "Predicted_Cluster")])


_LEARNED_FROM = sorted(
    {*EXPIRY_CATEGORIES, *EXPIRY_NUMBERS, *DEMAND_CATEGORIES, *DEMAND_NUMBERS, *REVENUE_NUMBERS, "Revenue",
     "Expiry_Risk"}
)


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table in executor memory, spilling to disk, while fits pass over it.

    A lost executor's share is computed again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _learning_table(df: DataFrame, key: str) -> DataFrame:
    """Only the columns the models read, of an engineered table."""
    table = training_table(df)
    require_columns(table, _LEARNED_FROM)
    return table.select(*_LEARNED_FROM, key)


def train_expiry(df: DataFrame, key: str = LINE_KEY) -> PipelineModel:
    """Fit on 80 % of each risk class. Runs jobs, like all training functions."""
    with _kept(_learning_table(df, key)) as table:
        return fit_expiry(split(table, key, "Expiry_Risk").filter("is_train"), key)


def train_demand(df: DataFrame, key: str = LINE_KEY) -> PipelineModel:
    with _kept(_learning_table(df, key)) as table:
        return fit_demand(split(table, key).filter("is_train"), key)


def train_revenue(df: DataFrame, key: str = LINE_KEY) -> PipelineModel:
    with _kept(_learning_table(df, key)) as table:
        return fit_revenue(split(table, key).filter("is_train"))


def train_segments(df: DataFrame, key: str = LINE_KEY) -> PipelineModel:
    return fit_segments(segment_inputs(_learning_table(df, key)))


def train_models(df: DataFrame, key: str = LINE_KEY) -> Models:
    """Fit all four models on an engineered table, which is computed once for them."""
    with _kept(_learning_table(df, key)) as table:
        with _kept(split(table, key).filter("is_train")) as overall:
            return Models(
                expiry=fit_expiry(split(table, key, "Expiry_Risk").filter("is_train"), key),
                demand=fit_demand(overall, key),
                revenue=fit_revenue(overall),
                segment=fit_segments(segment_inputs(table)),
            )


def evaluate_expiry(df: DataFrame, model: PipelineModel, key: str = LINE_KEY) -> DataFrame:
    """Classification report on the fifth of each class that training did not see."""
    held_out = split(training_table(df), key, "Expiry_Risk").filter("not is_train")
    return classification_report(model.transform(held_out), "Expiry_Risk", "Predicted_Expiry_Risk")


def evaluate_demand(df: DataFrame, model: PipelineModel, key: str = LINE_KEY) -> DataFrame:
    held_out = split(training_table(df), key).filter("not is_train")
    return regression_metrics(model.transform(held_out), "Sales_Velocity", "Predicted_Sales_Velocity")


def evaluate_revenue(df: DataFrame, model: PipelineModel, key: str = LINE_KEY) -> DataFrame:
    held_out = split(training_table(df), key).filter("not is_train")
    return regression_metrics(model.transform(held_out), "Revenue", "Predicted_Revenue")


def silhouette(df: DataFrame, model: PipelineModel) -> float:
    """Mean silhouette with squared distances, which needs cluster sums only. Runs jobs."""
    scored = model.transform(segment_inputs(training_table(df)))
    return ClusteringEvaluator(featuresCol="features", predictionCol="Predicted_Cluster").evaluate(scored)


def _apply(model: PipelineModel, df: DataFrame, *outputs: str) -> DataFrame:
    """Add only the named outputs of a model, none of its working columns."""
    return model.transform(df).select(*[F.col(f"`{c}`") for c in df.columns if c not in outputs], *outputs)


def apply_models(df: DataFrame, models: Models) -> DataFrame:
    """The four predictions on a prepared table; narrow, so no shuffle.

    Revenue is projected with the predicted velocity in place of the recorded one.
    """
    out = _apply(models.expiry, df, "Predicted_Expiry_Risk")
    out = _apply(models.demand, out, "Predicted_Sales_Velocity")
    out = out.withColumn("Predicted_Sales_Velocity", F.greatest(F.col("Predicted_Sales_Velocity"), F.lit(0.0)))
    recorded = {c: f"recorded_{c}" for c in ("Sales_Velocity", "Inventory_Turnover", "Profit_Margin") if c in out.columns}
    out = out.withColumns({copy: F.col(c) for c, copy in recorded.items()})
    out = _apply(models.revenue, out.withColumn("Sales_Velocity", F.col("Predicted_Sales_Velocity")), "Predicted_Revenue")
    out = out.withColumn("Predicted_Revenue", half_even(F.greatest(F.col("Predicted_Revenue"), F.lit(0.0)), 2))
    out = _apply(models.segment, segment_inputs(out), "Predicted_Cluster")
    return out.withColumns({c: F.col(copy) for c, copy in recorded.items()}).drop(*recorded.values())


def score_by_models(df: DataFrame, models: Models, as_of, key: str = LINE_KEY, boundaries: Boundaries | None = None) -> DataFrame:
    return df.transform(score_prep, as_of, key, boundaries).transform(apply_models, models).transform(score_kpis)


