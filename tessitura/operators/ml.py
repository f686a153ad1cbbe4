"""Model training and batch scoring with ``pyspark.ml`` (M-12..M-15, A-11).

The reference trains neural networks on one machine; here the same roles
(multiclass emotions, multilabel keywords, chunk scoring) are distributed
``pyspark.ml`` estimators over per-track vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .quasi_newton import L2, MAX_ROUNDS, TOLERANCE, train_linear


def with_vector(df: DataFrame, array_col: str, out_col: str = "features") -> DataFrame:
    return df.withColumn(out_col, array_to_vector(F.col(array_col)))


def train_multiclass(train: DataFrame, features_col: str = "features", label_col: str = "label", reg: float = 0.01, max_iter: int = 50) -> LogisticRegressionModel:
    """M-12: multinomial logistic regression on per-track vectors."""
    lr = LogisticRegression(featuresCol=features_col, labelCol=label_col, family="multinomial", regParam=reg, maxIter=max_iter)
    return lr.fit(train.withColumn(label_col, F.col(label_col).cast("double")))


def label_numbers(labels_col: str, names: Sequence[str]) -> Column:
    """Positions of a track's label names in ``names``; others are left out."""
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return F.transform(F.filter(F.col(labels_col), lambda x: F.array_contains(listed, x)), lambda x: (F.array_position(listed, x) - 1).cast("int"))


def train_multilabel(train: DataFrame, vector_col: str, labels_col: str, names: Sequence[str], rounds: int = MAX_ROUNDS, l2: float = L2, tolerance: float = TOLERANCE, path: str | None = None) -> np.ndarray:
    """M-13: one logistic model per label name, all fitted together until the gradient vanishes (``rounds`` at most).

    A round is one pass in which Spark adds up the gradients of all labels
    (:mod:`.quasi_newton`); with ``path`` a broken run is continued.  Returns the
    weights, the bias last.
    """
    data = materialize(train.select(F.col(vector_col).alias("x"), label_numbers(labels_col, names).alias("y")), "multilabel-train")
    state = train_linear(data, "logistic", len(names), l2, tolerance=tolerance, max_rounds=rounds, path=path)
    return state.w.reshape(len(names), -1)


def score(model: LogisticRegressionModel, df: DataFrame, features_col: str = "features") -> DataFrame:
    """M-14: class probabilities as ``array<double>`` plus the predicted index."""
    out = model.setFeaturesCol(features_col).transform(df)
    return out.withColumn("scores", vector_to_array("probability")).withColumn("pred", F.col("prediction").cast("int")).drop(
        "rawPrediction", "probability", "prediction"
    )


def _dot(vector, weights) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def score_multilabel(df: DataFrame, vector_col: str, weights: np.ndarray, names: Sequence[str], out_col: str = "p") -> DataFrame:
    """M-13 scoring: ``array<struct<label, p>>`` with one probability per label name."""

    @F.pandas_udf("array<double>")
    def probabilities(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
        return pd.Series(list(1.0 / (1.0 + np.exp(-(x @ weights[:, :-1].T + weights[:, -1])))), index=vectors.index)

    labels = F.array(*[F.lit(n) for n in names])
    return df.withColumn(out_col, F.arrays_zip(labels.alias("label"), probabilities(F.col(vector_col)).alias("p")))


def softmax_scores(df: DataFrame, vector_col: str, weights: np.ndarray, out_col: str = "scores") -> DataFrame:
    """M-14: class probabilities of a softmax model (rows of ``weights``: one class each, the bias last) as ``array<double>``."""

    @F.pandas_udf("array<double>")
    def probabilities(vectors: pd.Series) -> pd.Series:
        z = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1) @ weights[:, :-1].T + weights[:, -1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return pd.Series(list(z / z.sum(axis=1, keepdims=True)), index=vectors.index)

    return df.withColumn(out_col, probabilities(F.col(vector_col)))


def load_linear(model: DataFrame) -> list[list[float]]:
    """A linear model table ``(label, w)`` as rows in label order; its size is the number of classes."""
    return [list(r["w"]) for r in model.orderBy("label").collect()]


def linear_scores(df: DataFrame, vector_col: str, weights: Sequence[Sequence[float]], out_col: str = "scores") -> DataFrame:
    """M-14: the scores of a supplied linear model, one per class."""
    return df.withColumn(out_col, F.array(*[F.round(_dot(F.col(vector_col), w), 9) for w in weights]))
