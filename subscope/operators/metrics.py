"""Model quality from grouped counts: no score list is sorted in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope.functions.rules import lookup
from subscope.operators.ordering import running_sums
from subscope.session import materialize

F1_GRID = [0.3 + 0.05 * i for i in range(11)]


def class_balance(df: DataFrame, label: str) -> DataFrame:
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(
        neg.alias("n_neg"),
        pos.alias("n_pos"),
        F.try_divide(neg, pos).alias("pos_weight"),
        F.try_divide(pos, neg + pos).alias("positive_rate"),
    )


def _quality(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0 where undefined."""
    zero = F.lit(0.0)
    return (
        F.coalesce(F.try_divide(tp, tp + fp), zero),
        F.coalesce(F.try_divide(tp, tp + fn), zero),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
    )


def f1_sweep(df: DataFrame, score: str, label: str, grid: Sequence[float] = F1_GRID) -> DataFrame:
    """F1 at each threshold and which one is best (the first at the maximum)."""
    rows = []
    for t in grid:
        hit, pos = F.col(score) >= F.lit(t), F.col(label) == 1
        tp, fp, fn = F.count_if(hit & pos), F.count_if(hit & ~pos), F.count_if(~hit & pos)
        rows.append(F.struct(F.lit(t).alias("threshold"), _quality(tp, fp, fn)[2].alias("f1")))
    swept = df.agg(F.array(*rows).alias("r")).withColumn("top", F.array_max(F.col("r.f1")))
    best = F.element_at(F.filter("r", lambda x: x["f1"] == F.col("top")), 1)["threshold"]
    return swept.select(best.alias("best"), F.inline("r")).select(
        "threshold", "f1", (F.col("threshold") == F.col("best")).alias("is_best")
    )


def best_threshold(df: DataFrame, score: str, label: str) -> float:
    row = f1_sweep(df, score, label).where("is_best").first()
    return row.threshold if row.f1 > 0 else 0.5


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score with running counts in ascending order."""
    counted = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return running_sums(counted, ["s"], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")})


def auc_roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve as the Mann-Whitney statistic, ties counting half."""
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    below = F.col("cum_neg").cast("double") - F.col("neg") / 2.0
    return _by_score(df, score, label).agg(
        F.try_divide(F.sum(F.col("pos") * below), pos * neg).alias("auc_roc")
    )


def auc_roc_each(df: DataFrame, scores: Sequence[str], label: str) -> DataFrame:
    """(score_name, auc_roc) of several score columns, ranked together in one job."""
    cells = F.array(*[F.struct(F.lit(c).alias("score_name"), F.col(c).cast("double").alias("s")) for c in scores])
    counted = df.select(label, F.inline(cells)).where(F.col("s").isNotNull()).groupBy("score_name", "s").agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    ranked = running_sums(counted, ["s"], {"cum_neg": F.col("neg")}, by=["score_name"])
    below = F.col("cum_neg").cast("double") - F.col("neg") / 2.0
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy("score_name").agg(F.try_divide(F.sum(F.col("pos") * below), pairs).alias("auc_roc"))


def quality_each(long: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """All classification metrics of several models from one table of (model, score, label), one row per model.

    Scores are counted once per (model, score) and ranked together, models side by side.
    """
    positive, negative = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    counted = long.where(F.col("score").isNotNull()).groupBy("model", F.col("score").cast("double").alias("s"))
    counted = materialize(counted.agg(positive.alias("pos"), negative.alias("neg")), "score-counts")
    hit = F.col("s") >= lookup(F.col("model"), thresholds, None)
    totals = counted.groupBy("model").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("fp"),
    )
    ranked = running_sums(counted, ["s"], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, by=["model"])
    ranked = ranked.join(F.broadcast(totals), "model")  # one row per model
    above = F.col("p") - F.col("cum_pos") + F.col("pos")
    wrong = F.col("q") - F.col("cum_neg") + F.col("neg")
    won = F.sum(F.col("pos") * (F.col("cum_neg").cast("double") - F.col("neg") / 2.0))
    p, q, tp, fp = (F.max(c) for c in ("p", "q", "tp", "fp"))
    names = ("precision", "recall", "f1_score")
    return ranked.groupBy("model").agg(
        (p + q).alias("rows"),
        F.try_divide(won, p.cast("double") * q.cast("double")).alias("auc_roc"),
        F.try_divide(F.sum(F.col("pos") * F.try_divide(above, above + wrong)), p).alias("average_precision"),
        *[m.alias(n) for n, m in zip(names, _quality(tp, fp, p - tp))],
    )


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Step-wise average precision over distinct scores from high to low."""
    ranked = _by_score(df, score, label)
    total = df.where(F.col(score).isNotNull()).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")
    )
    p, q = total.select("p").scalar(), total.select("q").scalar()
    tp = p - F.col("cum_pos") + F.col("pos")
    fp = q - F.col("cum_neg") + F.col("neg")
    return ranked.agg(
        F.try_divide(F.sum(F.col("pos") * F.try_divide(tp, tp + fp)), F.sum("pos")).alias(
            "average_precision"
        )
    )


def classification_report(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    parts = F.count_if(hit & pos), F.count_if(hit & ~pos), F.count_if(~hit & pos)
    names = ("precision", "recall", "f1_score")
    return df.agg(*[q.alias(n) for n, q in zip(names, _quality(*parts))])


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """MAE, RMSE and R2; the total sum of squares is taken around the mean."""
    err = F.col(y) - F.col(yhat)
    return df.agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(y))).alias("r2"),
    )


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """z-scores with the population deviation; a constant column becomes 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    ).first()
    return df.withColumns(
        {
            f"{c}{suffix}": (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"])
            if stats[f"s_{c}"]
            else F.lit(0.0)
            for c in cols
        }
    )


def soft_assign(
    df: DataFrame, cols: Sequence[str], centroids: Sequence[Sequence[float]], eps: float = 1e-5
) -> DataFrame:
    """Membership weight per cluster, 1/(distance + eps) normalised per row.

    Centroids are model parameters (k rows), so they enter the plan as literals.
    """
    inverse = []
    for centre in centroids:
        squares = sum(
            ((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols, centre)),
            start=F.lit(0.0),
        )
        inverse.append(F.lit(1.0) / (F.sqrt(squares) + eps))
    total = sum(inverse[1:], start=inverse[0])
    return df.withColumns({f"weight_{i}": w / total for i, w in enumerate(inverse)})


