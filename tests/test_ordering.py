"""Ranks, bins, quantiles and running sums against pandas, with heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from subscope.operators import ordering


def sample(n: int) -> pd.DataFrame:
    rng = np.random.default_rng(n)
    ties = np.where(rng.random(n) < 0.4, 0.0, rng.integers(0, 5, n))
    return pd.DataFrame(
        {"customer_id": [f"c{i}" for i in rng.permutation(n)], "ties": ties, "spread": rng.normal(size=n)}
    )


@pytest.mark.parametrize("n", [1, 2, 5, 7, 43, 1500])
@pytest.mark.parametrize("q", [4, 5])
def test_bins_match_quantile_cut(spark, n, q):
    pdf = sample(n)
    df = spark.createDataFrame(pdf)
    bins = ordering.quantile_bins(df, {c: F.col(c) for c in ("ties", "spread")}, q)
    got = pytest.frame(df.select("customer_id", *[b.alias(c) for c, b in bins.items()]), "customer_id")
    ordered = pdf.sort_values("customer_id").reset_index(drop=True)
    for c in ("ties", "spread"):
        rank = ordered[c].rank(method="first")
        if n >= q:
            want = pd.qcut(rank, q, labels=False) + 1
        else:
            want = np.maximum(1, np.ceil((rank - 1) * q / max(n - 1, 1)))
        assert list(got[c]) == [int(x) for x in want]


@pytest.mark.parametrize("n", [1, 2, 43, 1500])
def test_quantiles_match_numpy(spark, n):
    pdf = sample(n)
    got = ordering.quantiles(spark.createDataFrame(pdf), {"ties": [0.2, 0.5], "spread": [0.25, 0.9]})
    for c, ps in got.items():
        for p, v in ps.items():
            assert v == pytest.approx(np.quantile(pdf[c], p), abs=1e-12)


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([("a", None)], "customer_id string, x double")
    assert ordering.quantiles(df, {"x": [0.5]}) == {"x": {0.5: None}}


def test_approximate_quantiles(spark):
    pdf = sample(1500)
    got = ordering.quantiles(spark.createDataFrame(pdf), {"spread": [0.5]}, exact=False)
    assert got["spread"][0.5] == pytest.approx(pdf.spread.median(), abs=0.05)


@pytest.mark.parametrize("parts", [2, 3, 16])
def test_running_sums_and_ranks(spark, parts):
    pdf = sample(700).assign(g=lambda d: np.where(d.index < 300, "hot", d.customer_id.str[-1]), w=2)
    df = spark.createDataFrame(pdf)
    got = ordering.running_sums(
        df, ["spread", "customer_id"], {"total": F.col("w").cast("bigint")}, by=["g"], parts=parts
    ).toPandas()
    want = pdf.sort_values(["spread", "customer_id"])
    want = want.assign(total=want.groupby("g").w.cumsum())
    key = ["customer_id"]
    assert list(got.sort_values(key).total) == list(want.sort_values(key).total)
    ranked = ordering.global_rank(df, ["ties", "customer_id"], "rank").toPandas()
    assert list(ranked.sort_values(["ties", "customer_id"])["rank"]) == list(range(1, 701))


def test_tied_value_is_spread_over_ranges(spark):
    """A value shared by every row must not end in one range."""
    df = spark.range(20000).select(F.lit(0.0).alias("v"), F.col("id").cast("string").alias("k"))
    sizes = [r["count"] for r in ordering.with_range(df, ["v", "k"], 8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 20000 / 8 * 1.6
