"""Churn probability with gradient-boosted trees."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.functions.rules import risk_action, risk_tier
from subscope.models.matrix import assembler, class_weights, training_vectors
from subscope.models.rounds import PATIENCE, best_round, first_rounds, round_aucs
from subscope.operators.metrics import best_threshold
from subscope.session import checkpoint_root, materialize


class Fit(NamedTuple):
    """A model of the best rounds, and the held-out AUC after each round that was looked at."""

    model: PipelineModel
    quality: list[float | None]


def fit_rounds(
    marked: DataFrame,
    features: Sequence[str],
    label: str = "churn_label",
    trees: int = 300,
    depth: int = 5,
    step: float = 0.05,
    patience: int = PATIENCE,
) -> Fit:
    """Boost on the rows with ``is_test`` false until the AUC on the others has not improved for ``patience`` rounds.

    Rounds are looked at in growing batches: the first ones of a longer run are those of a shorter one. The model is cut
    after the best round. The rarer class is weighted up by the class ratio. Without rows of both classes held out,
    all rounds are kept.
    """
    checkpoint_root(marked.sparkSession)  # boosting cuts its lineage there
    neg, pos = class_weights(marked, label)
    weight = float(neg) / pos if pos else 1.0
    columns = [
        F.col(label).cast("double").alias("label"),
        "is_test",
        F.when(F.col(label) == 1, weight).otherwise(1.0).alias("row_weight"),
    ]
    rows = training_vectors(marked, features, columns, "churn-rows")
    train, held_out = rows.where("not is_test"), rows.where("is_test")

    def boosted(rounds: int) -> GBTClassificationModel:
        booster = GBTClassifier(
            featuresCol="features", labelCol="label", weightCol="row_weight",
            maxIter=rounds, maxDepth=depth, stepSize=step, seed=K.SEED,
        )
        return booster.fit(train)

    rounds = max(1, min(trees, max(5 * patience, trees // 4)))
    while True:
        model = boosted(rounds)
        quality = round_aucs(model, held_out)
        best = best_round(quality, patience)
        if rounds >= trees or best + patience <= rounds:
            break
        rounds = min(trees, 2 * rounds)
    return Fit(PipelineModel(stages=[assembler(features), model if best >= rounds else first_rounds(model, best)]), quality)


def fit_churn(marked: DataFrame, features: Sequence[str], label: str = "churn_label", **options) -> PipelineModel:
    """The model of ``fit_rounds``."""
    return fit_rounds(marked, features, label, **options).model


def churn_probability(model: PipelineModel, df: DataFrame, out: str = "churn_risk_score") -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def tuned_threshold(model: PipelineModel, held_out: DataFrame, label: str = "churn_label") -> float:
    """The threshold of the best F1 on rows the model was not fitted on."""
    scored = churn_probability(model, held_out).select("churn_risk_score", label)
    return best_threshold(materialize(scored, "held-out"), "churn_risk_score", label)


def score_churn(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability, flag at the tuned threshold, tier and action of every customer."""
    score = F.col("churn_risk_score")
    return churn_probability(model, df).select(
        "customer_id",
        score,
        (score >= threshold).alias("churn_predicted"),
        risk_tier(score).alias("risk_tier"),
        risk_action(score).alias("recommended_action"),
    )
