"""90-day customer value with boosted regression on the log of discounted spend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.functions.rules import clv_back_transform
from subscope.models.folds import held_out_r2
from subscope.models.matrix import assembler, contiguous_folds, training_rows, training_vectors
from subscope.operators.value import clv_target, with_clv_tier
from subscope.session import checkpoint_root


def _booster(trees: int, depth: int, step: float) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol="clv_log_target", predictionCol="clv_log",
        maxIter=trees, maxDepth=depth, stepSize=step, seed=K.SEED,
    )


def fit_clv(
    df: DataFrame, features: Sequence[str], trees: int = 200, depth: int = 4, step: float = 0.05
) -> PipelineModel:
    """Boosted trees on the log target, which is worked out here unless ``df`` holds it."""
    checkpoint_root(df.sparkSession)
    rows = df if "clv_log_target" in df.columns else clv_target(df)
    rows = training_vectors(rows, features, ["clv_log_target"], "clv-rows")
    return PipelineModel(stages=[assembler(features), _booster(trees, depth, step).fit(rows)])


def predict_clv(model: PipelineModel, df: DataFrame) -> DataFrame:
    return (
        model.transform(df)
        .withColumn("clv_90d", clv_back_transform(F.col("clv_log")))
        .drop("features", "clv_log")
    )


def score_clv(model: PipelineModel, df: DataFrame, thresholds: dict[float, float]) -> DataFrame:
    """Value, tier, budget and monthly estimate; thresholds are spend percentiles of the training rows."""
    return with_clv_tier(predict_clv(model, df).select("customer_id", "clv_90d"), thresholds)


def fold_r2(
    df: DataFrame, features: Sequence[str], folds: int = K.FOLDS, trees: int = 200, depth: int = 4,
    step: float = 0.05,
) -> list[float]:
    """R2 on the log target of each contiguous fold, by a model of the other folds.

    Vectors are assembled and stored once. The folds' models are boosted together: a pass over that table serves all of
    them. No model of all rows is fitted.
    """
    checkpoint_root(df.sparkSession)
    vectors = assembler(features).transform(contiguous_folds(clv_target(df), folds))
    rows = training_rows(vectors.select("features", "clv_log_target", "fold"), "cv-rows")
    return held_out_r2(rows, folds, trees, depth, step, "clv_log_target")


def cv_r2(
    df: DataFrame, features: Sequence[str], folds: int = K.FOLDS, trees: int = 200, depth: int = 4,
    step: float = 0.05,
) -> float:
    """Mean R2 on the log target over contiguous folds."""
    found = fold_r2(df, features, folds, trees, depth, step)
    return sum(found) / len(found)
