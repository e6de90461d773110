"""Linear regression from one aggregate, for inputs of any rank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.functions.numeric import is_amount

# Directions of the scaled inputs with less than this share of the variance of the largest are taken for none.
RANK_TOLERANCE = 1e-10


@dataclass(frozen=True)
class Line:
    """A fitted linear function of named columns."""

    coefficients: dict[str, float]
    intercept: float
    rank: int

    def stage(self, prediction: str) -> SQLTransformer:
        """The function as a pipeline stage: one expression, which can be stored and loaded with a pipeline."""
        terms = [f"{weight!r}D * CAST(`{name}` AS DOUBLE)" for name, weight in self.coefficients.items()]
        return SQLTransformer(statement=f"SELECT *, {' + '.join([*terms, f'{self.intercept!r}D'])} AS `{prediction}` FROM __THIS__")


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows that have all columns, their means, and the matrix of covariances: one aggregate, one row.

    Covariances are updated around the running means, so that large means cost no digits.
    """
    values = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    rows = df.select(*values)
    for i in range(len(columns)):
        rows = rows.filter(is_amount(F.col(f"x{i}")))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    means = [F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *means, *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    matrix = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = found[f"c{i}_{j}"] or 0.0
    return found["n"], np.array([found[f"m{i}"] or 0.0 for i in range(len(columns))]), matrix


def least_norm(matrix: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, int]:
    """The shortest solution, in inputs of variance one, of normal equations of any rank; and the rank."""
    scale = np.sqrt(np.diag(matrix))
    used = scale > 0
    weights = np.zeros(len(scale))
    if not used.any():
        return weights, 0
    scaled = matrix[np.ix_(used, used)] / np.outer(scale[used], scale[used])
    sizes, axes = np.linalg.eigh(scaled)
    held = sizes > RANK_TOLERANCE * sizes.max()
    axes = axes[:, held]
    weights[used] = axes @ ((axes.T @ (target[used] / scale[used])) / sizes[held]) / scale[used]
    return weights, int(held.sum())


def fit_line(df: DataFrame, features: Sequence[str], label: str) -> Line:
    """Plain least squares. Runs one job; what reaches the driver is one row.

    Columns that depend on others share the weight, constant ones have none. Rows without a value in any of the
    columns are left out; without rows everything is 0.
    """
    _, means, matrix = moments(df, [*features, label])
    weights, rank = least_norm(matrix[:-1, :-1], matrix[:-1, -1])
    return Line(dict(zip(features, map(float, weights), strict=True)), float(means[-1] - weights @ means[:-1]), rank)
