"""Model fits on a planted signal, repeatability and exactness of the attribution."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from subscope.models import attribution, churn, clv, evaluation, matrix, persist, propensity, rounds, scoring, segments
from subscope.operators import encoding, metrics, value
from subscope import constants as K

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(size=(n, 4)).round(3)
    y = (x[:, 0] + 0.8 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.4, n) > 0.8).astype(int)
    pdf = pd.DataFrame(x, columns=FEATURES).assign(customer_id=[f"c{i}" for i in range(n)], churn_label=y)
    return spark.createDataFrame(pdf).cache()


@pytest.fixture(scope="module")
def churn_model(planted):
    return churn.fit_churn(matrix.mark_split(planted, "churn_label"), FEATURES, trees=6, depth=4, step=0.3)


def test_split_is_stratified_and_repeatable(planted):
    marked = matrix.mark_split(planted, "churn_label")
    for r in marked.groupBy("churn_label").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect():
        assert r.t == int(r.n * 0.2 + 0.5)
    again = matrix.mark_split(planted.repartition(3), "churn_label")
    assert marked.where("is_test").exceptAll(again.where("is_test")).count() == 0
    train, test = matrix.stratified_split(planted, "churn_label")
    assert train.count() + test.count() == planted.count()


def test_folds_are_contiguous(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(13)], "customer_id string")
    got = matrix.contiguous_folds(df, 5).orderBy("customer_id").toPandas()
    assert list(got.fold) == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 2 + [4] * 2


def test_churn_scores(planted, churn_model):
    scored = churn.churn_probability(churn_model, planted)
    assert scored.where("churn_risk_score not between 0 and 1").count() == 0
    assert metrics.auc_roc(scored, "churn_risk_score", "churn_label").first().auc_roc > 0.85


def test_roundtrip_keeps_predictions(spark, planted, churn_model, tmp_path):
    path = str(tmp_path / "model")
    persist.save_model(churn_model, path)
    first = churn.score_churn(churn_model, planted)
    assert first.exceptAll(churn.score_churn(persist.load_model(path), planted)).count() == 0


def test_contributions_add_up_to_the_margin(planted, churn_model):
    got = attribution.attribute(churn_model, planted).join(
        churn.churn_probability(churn_model, planted).select("customer_id", "churn_risk_score"), "customer_id"
    ).toPandas()
    margin = got.base_value + got.contributions.map(sum)
    assert np.allclose(1 / (1 + np.exp(-2 * margin)), got.churn_risk_score, atol=1e-9)


def test_contributions_are_shapley_values(spark, planted, churn_model, tmp_path):
    """Brute force over all coalitions of the four features."""
    path = str(tmp_path / "trees")
    trees = churn_model.stages[-1]
    trees.write().overwrite().save(path)
    nodes = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData

    def expected(tree, at, x, known):
        n = tree[at]
        if n.leftChild < 0:
            return n.prediction
        left, right = tree[n.leftChild], tree[n.rightChild]
        if n.split.featureIndex in known:
            below = x[n.split.featureIndex] <= n.split.leftCategoriesOrThreshold[0]
            return expected(tree, left.id if below else right.id, x, known)
        wl, wr = left.impurityStats[0], right.impurityStats[0]
        return (wl * expected(tree, left.id, x, known) + wr * expected(tree, right.id, x, known)) / (wl + wr)

    def game(x, known):
        return sum(w * expected(nodes[t], 0, x, known) for t, w in enumerate(trees.treeWeights))

    some = planted.limit(5)
    got = {r.customer_id: r.contributions for r in attribution.attribute(churn_model, some).collect()}
    for r in some.collect():
        x = [r[f] for f in FEATURES]
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            want = sum(
                factorial(k) * factorial(3 - k) / factorial(4) * (game(x, {*s, i}) - game(x, set(s)))
                for k in range(4)
                for s in combinations(rest, k)
            )
            assert got[r.customer_id][i] == pytest.approx(want, abs=1e-9)


def test_patience():
    rising = [0.5 + i / 1000 for i in range(50)]
    assert rounds.best_round(rising) == 50
    assert rounds.best_round([*rising, *[0.52] * 19, 0.9]) == 70  # the 20th round is better
    assert rounds.best_round([*rising, *[0.549] * 20, 0.9]) == 50  # too late, and equal ones do not count
    assert rounds.best_round([0.7, 0.7, 0.6]) == 1
    assert rounds.best_round([None, None]) == 2 and rounds.best_round([None, 0.6, 0.5], patience=1) == 2


def test_round_aucs(planted, churn_model):
    """The AUC after each round, against the model of so many rounds."""
    vectors, trees = churn_model.stages
    held_out = vectors.transform(matrix.mark_split(planted, "churn_label").where("is_test")).withColumnRenamed("churn_label", "label")
    got = rounds.round_aucs(trees, held_out.select("features", "label"), ranges=1 << 20)
    x = np.array([r.features.toArray() for r in held_out.select("features").collect()])
    y = np.array([r.label for r in held_out.select("label").collect()])
    each = np.array([[w * t.predict(r) for t, w in zip(trees.trees, trees.treeWeights)] for r in map(Vectors.dense, x)])
    assert len(got) == len(trees.treeWeights)
    for k, auc in enumerate(got, 1):
        s = each[:, :k].sum(axis=1).round(9)
        wins = (s[y == 1][:, None] > s[y == 0]).sum() + 0.5 * (s[y == 1][:, None] == s[y == 0]).sum()
        assert auc == pytest.approx(wins / ((y == 1).sum() * (y == 0).sum()), abs=1e-9)
    assert rounds.round_aucs(trees, held_out.select("features", "label").where("label = 1")) == [None] * len(got)


def test_boosting_stops_by_patience(planted):
    """Every round up to the best and ``patience`` more are looked at, and the best one is kept."""
    marked = matrix.mark_split(planted, "churn_label")
    fit = churn.fit_rounds(marked, FEATURES, trees=24, depth=3, step=0.3, patience=4)
    kept = fit.model.stages[-1].getNumTrees
    assert kept == rounds.best_round(fit.quality, 4) and (len(fit.quality) == 24 or len(fit.quality) >= kept + 4)
    whole = churn.fit_rounds(marked.where("not is_test"), FEATURES, trees=5, depth=2)
    assert whole.model.stages[-1].getNumTrees == 5 and whole.quality == [None] * 5


def test_evaluation(master):
    names = encoding.numeric_columns(master, [*K.NON_FEATURES, "cluster"])
    models = scoring.fit_all(master, names, churn_trees=2, forest_trees=2, clv_trees=2, n_init=1)
    got = pytest.rows(evaluation.evaluate(models, master), "model")
    assert set(got) == {"churn", *propensity.OFFERS, "clv", "segments"}
    held_out = matrix.mark_split(master, "churn_label").where("is_test")
    report = metrics.classification_report(
        churn.churn_probability(models.churn, held_out.drop("churn_risk_score")), "churn_risk_score", "churn_label", models.churn_threshold
    )
    assert {k: got["churn"][k] for k in report.columns} == pytest.approx(report.first().asDict())
    assert got["clv"]["rmse"] >= got["clv"]["mae"] > 0 and got["clv"]["rows"] == master.count() and -1 <= got["segments"]["silhouette"] <= 1


def test_components_do_not_depend_on_order(master):
    cols = ["arpu", "tenure_months", "days_since_last_recharge", "engagement_score"]
    a, b = (pytest.frame(segments.pca_2d(df, c), "customer_id") for df, c in ((master, cols), (master.repartition(3), cols[::-1])))
    assert np.allclose(a[["pc1", "pc2"]], b[["pc1", "pc2"]], atol=1e-9)


def test_unknown_offer(planted):
    with pytest.raises(ValueError):
        propensity.fit_propensity(planted, "nope", FEATURES)


def test_segments(spark, master):
    cols = ["arpu", "tenure_months", "days_since_last_recharge"]
    model = segments.fit_segments(master, cols, k=6, n_init=2)
    got = segments.assign_segments(model, master.drop("cluster"))
    assert got.count() == master.count()
    assert got.select("segment_label").distinct().count() == 6
    chosen = segments.k_selection(master, cols, [3, 4])
    assert chosen.where("is_best").count() == 1
    assert segments.pca_2d(master, cols).count() == master.count()


def test_clv(master):
    cols = ["recharge_count_90d", "avg_recharge_amount", "churn_label"]
    cut = value.clv_thresholds(master)
    got = clv.score_clv(clv.fit_clv(master, cols, trees=4), master.drop("clv_90d"), cut)
    assert got.where("clv_90d < 0 or clv_tier not in ('Platinum', 'Gold', 'Silver', 'Bronze')").count() == 0
    assert clv.cv_r2(master, cols, folds=2, trees=2) > 0


def test_score_all(master):
    names = encoding.numeric_columns(master, [*K.NON_FEATURES, "cluster"])
    models = scoring.fit_all(master, names, churn_trees=2, forest_trees=2, clv_trees=2, n_init=1)
    got = scoring.score_all(models, master)
    assert got.count() == master.count() and got.where("ml_segment is null").count() == 0
    with pytest.raises(ValueError):
        scoring.score_all(models, master.drop(names[0]))


def test_queries_fit_the_default_models(spark, sf_dir, monkeypatch):
    """score_all_models and cv_r2 run the job that the operators run at their defaults."""
    from subscope.models import clv, scoring
    from subscope.plans import catalog

    calls = []
    monkeypatch.setattr(scoring, "fit_all", lambda m, names, *a, **k: calls.append((a, k)))
    monkeypatch.setattr(scoring, "score_all", lambda models, m: m)
    monkeypatch.setattr(clv, "cv_r2", lambda m, names, *a, **k: calls.append((a, k)) or 0.5)
    monkeypatch.setattr(catalog, "_fitted", {})  # nothing fitted yet, whatever ran before
    for name in ("score_all_models", "cv_r2"):
        catalog.QUERIES[name](spark, sf_dir)
    assert calls == [((), {}), ((), {})]


def test_rounds_are_boosted_once(planted, monkeypatch):
    """A best round among the first ones needs one fit; the model cut there scores as one of so many rounds."""
    fits = []
    fit = churn.GBTClassifier.fit
    monkeypatch.setattr(churn.GBTClassifier, "fit", lambda self, rows: fits.append(self.getMaxIter()) or fit(self, rows))
    marked = matrix.mark_split(planted, "churn_label")
    found = churn.fit_rounds(marked, FEATURES, trees=24, depth=3, step=0.3, patience=4)
    kept = found.model.stages[-1].getNumTrees
    assert fits == [20] and kept < 20
    whole = churn.fit_rounds(marked.where("not is_test"), FEATURES, trees=6, depth=3, step=0.3)
    cut = rounds.first_rounds(whole.model.stages[-1], 4)
    again = churn.fit_rounds(marked.where("not is_test"), FEATURES, trees=4, depth=3, step=0.3).model.stages[-1]
    assert cut.numFeatures == 4 and cut.treeWeights == again.treeWeights
    rows = whole.model.stages[0].transform(planted).select("customer_id", "features")
    assert cut.transform(rows).select("customer_id", "probability").exceptAll(again.transform(rows).select("customer_id", "probability")).count() == 0


def test_training_rows_are_even_and_no_more_than_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = matrix.training_rows(spark.range(0, 1000, 1, 7).where("id < 900"), "rows", 10)
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert rows.count() == 900 and len(sizes) == min(cores, 90) and max(sizes) <= 900 / len(sizes) + 10


def test_forest_keeps_nodes_between_levels(planted, monkeypatch):
    made = []
    forest = propensity.RandomForestClassifier
    monkeypatch.setattr(propensity, "RandomForestClassifier", lambda **options: made.append(options) or forest(**options))
    labelled = planted.withColumn("label_bundle_upgrade", F.col("churn_label"))
    model = propensity.fit_propensity(labelled, "bundle_upgrade", FEATURES, trees=3)
    assert made[0]["cacheNodeIds"] and made[0]["maxDepth"] == 30 and model.stages[-1].getNumTrees == 3


def test_folds_are_boosted_as_spark_boosts_them(planted, monkeypatch):
    """All folds in the same passes, each of them as Spark's trees on the other folds' rows; a constant column too."""
    from pyspark.ml.evaluation import RegressionEvaluator

    from subscope.models import folds

    names = [*FEATURES, "e"]
    rows = matrix.contiguous_folds(planted.withColumns({"e": F.lit(1.0), "y": F.col("a") * F.col("b") + F.col("c")}), 3)
    rows = matrix.assembler(names).transform(rows).select("features", "y", "fold").coalesce(1).cache()
    got = folds.held_out_r2(rows, 3, trees=5, depth=3, step=0.3, label="y")
    monkeypatch.setattr(folds, "CHECKPOINT", 2)
    assert got == pytest.approx(folds.held_out_r2(rows.repartition(3), 3, trees=5, depth=3, step=0.3, label="y"), abs=1e-9)
    booster = clv._booster(5, 3, 0.3).setLabelCol("y").setPredictionCol("p")
    judge = RegressionEvaluator(labelCol="y", predictionCol="p", metricName="r2")
    want = [judge.evaluate(booster.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k))) for k in range(3)]
    assert got == pytest.approx(want, abs=1e-9) and min(got) > 0.3
    with pytest.raises(Exception, match="finite"):
        folds.held_out_r2(rows.withColumn("y", F.when(F.col("fold") > 0, F.col("y"))), 3, 1, 1, 0.3, "y")


def test_folds_share_their_passes(planted, monkeypatch):
    """A level of the trees is one pass for all folds, and no fit of a fold runs beside it."""
    from subscope.models import folds

    passes, level = [], folds._split
    monkeypatch.setattr(folds, "_split", lambda *a: passes.append(1) or level(*a))
    monkeypatch.setattr(clv.GBTRegressor, "fit", lambda *a: pytest.fail("a fold was fitted by itself"))
    rows = planted.withColumn("total_recharge_90d", F.abs("a") * 100)
    monkeypatch.setattr(clv, "training_rows", lambda df, name: df.repartition(2))
    assert all(r <= 1 for r in clv.fold_r2(rows, FEATURES, folds=3, trees=2, depth=2)) and len(passes) == 2 * 2 * 3


def test_features_of_few_bins_are_counted_together(planted, monkeypatch):
    """Grouped counts find the trees that counts of each feature find."""
    from subscope.models import folds

    binary = {f"b{i}": (F.col(c) > 0).cast("double") for i, c in enumerate(FEATURES)}
    rows = matrix.contiguous_folds(planted.withColumns({**binary, "y": F.col("a") + F.col("b") * (F.col("c") > 0).cast("double")}), 3)
    rows = matrix.assembler([*FEATURES, *binary]).transform(rows).select("features", "y", "fold").coalesce(1).cache()
    monkeypatch.setattr(folds, "SAMPLE", 250)
    found = []
    for cells in (512, 1):
        monkeypatch.setattr(folds, "CELLS", cells)
        found.append((len(folds.Grid.of(rows, 3, "y", "fold").groups), folds.held_out_r2(rows, 3, 4, 3, 0.3, "y")))
    assert [groups for groups, _ in found] == [1, 0] and found[0][1] == pytest.approx(found[1][1], abs=1e-9)
