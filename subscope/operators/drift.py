"""Distribution drift between a reference table and a current batch.

Features are unpivoted to (feature, value) rows so one job serves them all. Every statistic
comes from grouped counts over the full tables, with no sample and no per-feature loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.functions.stats import bin_index, ks_log10_p_value, ks_p_value
from subscope.operators.ordering import running_sums

EPS = 1e-4


def long_format(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value) rows, nulls left out."""
    cells = ", ".join(
        f"named_struct('feature_name', '{c}', 'value', cast(`{c}` AS double))" for c in features
    )
    return df.select(F.expr(f"inline(array({cells}))")).where(F.col("value").isNotNull())


def _both(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    r = long_format(ref, features).withColumn("is_ref", F.lit(True))
    return r.unionByName(long_format(cur, features).withColumn("is_ref", F.lit(False)))


def reference_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation and range of every feature."""
    return long_format(df, features).groupBy("feature_name").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def _stats(both: DataFrame) -> DataFrame:
    """One row per feature present on both sides: counts, means and the reference range.

    The result has at most one row per listed feature; it is computed once and enters the
    following plans as a small local table.
    """
    is_ref = F.col("is_ref")
    r, c = F.when(is_ref, F.col("value")), F.when(~is_ref, F.col("value"))
    found = (
        both.groupBy("feature_name")
        .agg(
            F.count(r).alias("n_ref"),
            F.count(c).alias("n_cur"),
            F.avg(r).alias("reference_mean"),
            F.avg(c).alias("current_mean"),
            F.min(r).alias("lo"),
            F.max(r).alias("hi"),
        )
        .where((F.col("n_ref") > 0) & (F.col("n_cur") > 0))
    )
    return F.broadcast(both.sparkSession.createDataFrame(found.toArrow(), found.schema))


def _psi(both: DataFrame, stats: DataFrame, bins: int) -> DataFrame:
    idx = bin_index("value", "lo", "hi", bins)
    counts = (
        both.join(stats.select("feature_name", "lo", "hi"), "feature_name")
        .groupBy("feature_name", idx.alias("bin"))
        .agg(F.count_if("is_ref").alias("c_ref"), F.count_if(~F.col("is_ref")).alias("c_cur"))
    )
    grid = stats.select(
        "feature_name", "lo", "hi", "n_ref", "n_cur",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    )

    def share(count: str, n: str) -> Column:
        return (F.coalesce(F.col(count), F.lit(0)) / F.col(n) + EPS) / (1.0 + bins * EPS)

    e, a = share("c_ref", "n_ref"), share("c_cur", "n_cur")
    term = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise((a - e) * F.log(a / e))
    return (
        grid.join(counts, ["feature_name", "bin"], "left")
        .groupBy("feature_name")
        .agg(F.sum(term).alias("psi"))
    )


def psi(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index over equal-width bins of the reference range.

    Current values outside the range count in the end bins; a constant reference is one bin.
    """
    both = _both(ref, cur, features)
    return _psi(both, _stats(both), bins)


def _ks(both: DataFrame, stats: DataFrame) -> DataFrame:
    counted = both.groupBy("feature_name", "value").agg(
        F.count_if("is_ref").alias("c_ref"), F.count_if(~F.col("is_ref")).alias("c_cur")
    )
    upto = running_sums(
        counted, ["value"], {"r": F.col("c_ref"), "c": F.col("c_cur")}, by=["feature_name"]
    )
    gap = F.abs(F.col("r") / F.col("n_ref") - F.col("c") / F.col("n_cur"))
    sizes = stats.select("feature_name", "n_ref", "n_cur")
    return upto.join(sizes, "feature_name").groupBy("feature_name").agg(
        F.max(gap).alias("ks_statistic"),
        F.max("n_ref").alias("n_ref"),
        F.max("n_cur").alias("n_cur"),
    )


def ks_statistic(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """Largest gap between the two empirical distribution functions, and both sizes.

    Values are counted first, so repeated values collapse; the running counts are then
    spread over ranges of (feature, value).
    """
    both = _both(ref, cur, features)
    return _ks(both, _stats(both))


def _p_value() -> Column:
    return ks_p_value(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur"))


def ks_test(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """Statistic, p-value and its decimal logarithm, which tells small p-values apart where the value itself has run out."""
    log_p = ks_log10_p_value(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur"))
    return ks_statistic(ref, cur, features).select(
        "feature_name", "ks_statistic", _p_value().alias("ks_p_value"), log_p.alias("ks_log10_p_value")
    )


def drift_report(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """One row per feature: PSI, KS, means, shift, flag and severity."""
    both = _both(ref, cur, features)
    stats = _stats(both)
    ks = _ks(both, stats).select("feature_name", "ks_statistic", _p_value().alias("ks_p_value"))
    score = F.col("psi")
    return (
        _psi(both, stats, bins)
        .join(ks, "feature_name")
        .join(stats, "feature_name")
        .select(
            "feature_name",
            "psi",
            "ks_statistic",
            "ks_p_value",
            ((score > K.PSI_THRESHOLD) | (F.col("ks_p_value") < K.KS_ALPHA)).alias("drift_detected"),
            F.when(score >= 0.2, "severe").when(score >= 0.1, "moderate").otherwise("none").alias("severity"),
            "reference_mean",
            "current_mean",
            F.expr("(current_mean - reference_mean) / (reference_mean + 1e-9D)").alias("mean_shift_pct"),
        )
    )


def prediction_drift(ref: DataFrame, cur: DataFrame, score: str) -> DataFrame:
    """The drift row of a model score, under the fixed name of that report."""
    return drift_report(ref, cur, [score]).withColumn("feature_name", F.lit("prediction_scores"))


def seeded_sample(df: DataFrame, fraction: float, seed: int = K.SEED, id_col: str = "customer_id") -> DataFrame:
    """A repeatable row sample by id hash: the same rows whatever the partitioning."""
    cut = f"{int(fraction * 16**8):08x}"
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    return df.where(F.substring(digest, 1, 8) < cut)
