"""Tasks that stay small on large inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_plans import plan

from subscope import constants as K
from subscope.models import attribution, clv, matrix, persist, propensity, scoring, segments
from subscope.operators import encoding, events
from subscope.plans import catalog, fixtures
from subscope.session import SMALL_TASKS, small_tasks


def test_customers_are_summed_up_where_their_rollup_lies(spark, sf_dir):
    """Features from the stored rollup shuffle nothing."""
    rolled = fixtures.rollup(spark, sf_dir)
    assert rolled.count() == events.channel_rollup(fixtures.event_log(spark, sf_dir)).count()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(events.event_block(rolled, ref="2000-12-31"))
    assert "Exchange hashpartitioning" not in text and "rangepartitioning" not in text
    assert "HashAggregate" in text and "Exchange" not in plan(rolled.groupBy("customer_id", "event_date").count())


def test_small_tasks_set_the_session_for_a_while(spark):
    before = {key: spark.conf.get(key) for key in [*SMALL_TASKS, "spark.sql.shuffle.partitions"]}
    with small_tasks(spark, rows=50_000_000):
        assert {key: spark.conf.get(key) for key in SMALL_TASKS} == SMALL_TASKS
        assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
    with small_tasks(spark, rows=10):
        assert spark.conf.get("spark.sql.shuffle.partitions") == before["spark.sql.shuffle.partitions"]
    assert {key: spark.conf.get(key) for key in before} == before


def test_fits_over_many_rows_do_not_run_side_by_side(spark, monkeypatch):
    rows = spark.range(60).selectExpr("cast(id % 3 * 10 + id / 100 as double) as a", "cast(id % 3 as double) as b")
    limits, together = [], segments.side_by_side
    monkeypatch.setattr(segments, "side_by_side", lambda tasks, limit=8: limits.append(limit) or together(tasks, limit))
    few = segments.k_selection(rows, ["a", "b"], ks=[3, 4], n_init=2).collect()
    monkeypatch.setattr(matrix, "ROWS_AT_ONCE", 100)
    assert few == segments.k_selection(rows, ["a", "b"], ks=[3, 4], n_init=2).collect()
    assert limits[0] == 8 and limits[2] == 1


def test_values_of_a_leaf_are_worked_out_once(monkeypatch):
    """Later batches reuse the values of each leaf's patterns; all patterns are covered and other leaves stay exact."""
    x = np.random.default_rng(5).random((300, 4))
    leaves = [
        attribution.Leaf([0, 2], [(0, 0.5, True), (1, 0.3, False), (0, 0.2, False)], np.array([0.4, 0.7]), 1.5),
        attribution.Leaf([1, 2, 3], [(1, 0.3, True), (0, 0.6, True), (2, 0.1, False)], np.array([0.2, 0.5, 0.9]), -2.0),
    ]
    calls, shapley = [], attribution._shapley
    monkeypatch.setattr(attribution, "_shapley", lambda *a: calls.append(1) or shapley(*a))
    tables: dict = {}
    got = np.vstack([attribution.contributions_of(part, leaves, tables) for part in (x[:120], x[120:299], x[299:])])
    assert len(calls) == len(leaves)
    want = np.zeros_like(x)
    for leaf in leaves:
        met = np.ones((len(x), len(leaf.features)), dtype=int)
        for i, threshold, left in leaf.splits:
            met[:, i] &= (x[:, leaf.features[i]] <= threshold) == left
        want[:, leaf.features] += shapley(met, leaf.shares, leaf.value)
    assert np.array_equal(got, want)
    monkeypatch.setattr(attribution, "TABLE_BITS", 0)
    assert np.array_equal(attribution.contributions_of(x, leaves), want)


def test_forests_over_many_rows_are_not_fitted_side_by_side(spark, sf_dir, monkeypatch):
    limits = []

    class Stop(Exception):
        pass

    def stop(tasks, limit=8):
        limits.append((len(tasks), limit))
        raise Stop

    monkeypatch.setattr(matrix, "ROWS_AT_ONCE", fixtures.master(spark, sf_dir).count())
    monkeypatch.setattr(catalog, "side_by_side", stop)
    monkeypatch.setattr(catalog, "_fitted", {})
    with pytest.raises(Stop):
        catalog._propensity_models(spark, sf_dir)
    assert limits == [(3, 1)]


def test_fits_share_one_table_of_vectors(master, monkeypatch):
    """Columns are assembled and dealt out once for all models, which predict what those fitted on the columns do."""
    names = encoding.numeric_columns(master, [*K.NON_FEATURES, "cluster"])
    stored, write = [], matrix.materialize
    monkeypatch.setattr(matrix, "materialize", lambda df, name="table": stored.append(name) or write(df, name))
    models = scoring.fit_all(master, names, churn_trees=2, forest_trees=2, clv_trees=2, n_init=1)
    assert sorted(stored) == ["matrix", "scaled"]
    alone = {r["customer_id"]: r["clv_90d"] for r in clv.predict_clv(clv.fit_clv(master, names, trees=2), master.drop("clv_90d")).collect()}
    shared = clv.predict_clv(models.clv, master.drop("clv_90d")).collect()
    assert len(shared) == len(alone) and all(r["clv_90d"] == pytest.approx(alone[r["customer_id"]], abs=1e-6) for r in shared)


@pytest.fixture(scope="module")
def offered(spark):
    rows = spark.range(400).selectExpr("cast(id as string) as customer_id", "cast(id % 17 as double) as a", "cast(id % 5 as double) as b")
    return rows.withColumn("label_bundle_upgrade", F.expr("cast(a + b > 10 as int)")).cache()


def test_trees_over_many_rows_grow_in_parts(offered, monkeypatch, tmp_path):
    """Parts of a forest vote as one forest of all trees, also after a reload; few rows grow all trees together."""
    parts, kind = [], propensity.RandomForestClassifier
    fit = kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, rows: parts.append(fit(self, rows)) or parts[-1])
    propensity.fit_propensity(offered, "bundle_upgrade", ["a", "b"], trees=5)
    assert [part.getNumTrees for part in parts] == [5]
    parts.clear()
    monkeypatch.setattr(propensity, "ROWS_BY_TREES", 900)
    model = propensity.fit_propensity(offered, "bundle_upgrade", ["a", "b"], trees=5)
    assert [part.getNumTrees for part in parts] == [1, 2, 2] and model.stages[-1].getNumTrees == 5
    persist.save_model(model, str(tmp_path / "forest"))
    for whole in (model, persist.load_model(str(tmp_path / "forest"))):
        got = [r["p"] for r in propensity.propensity_score(whole, offered, "p").orderBy("customer_id").select("p").collect()]
        rows = model.stages[0].transform(offered).orderBy("customer_id")
        votes = [[r["probability"][1] * part.getNumTrees for r in part.transform(rows).select("probability").collect()] for part in parts]
        assert got == pytest.approx([sum(v) / 5 for v in zip(*votes)])


def test_scores_are_stored_before_they_are_ranked(offered):
    """Ranking reads stored scores: no filter of it walks down the trees again."""
    model = propensity.fit_propensity(offered, "bundle_upgrade", ["a", "b"], trees=3)
    ranked = propensity.score_propensity(model, offered)
    assert "UDF" not in plan(ranked) and ranked.count() == 400
    assert ranked.where("targetable").agg(F.max("priority_rank")).first()[0] == ranked.where("propensity_score >= 0.5").count()


def test_all_models_over_many_rows_are_not_fitted_side_by_side(master, monkeypatch):
    limits = []

    class Stop(Exception):
        pass

    def stop(tasks, limit=8):
        limits.append((len(tasks), limit))
        raise Stop

    monkeypatch.setattr(scoring, "side_by_side", stop)
    for at_once in (master.count(), 2 * master.count(), 100 * master.count()):
        monkeypatch.setattr(matrix, "ROWS_AT_ONCE", at_once)
        with pytest.raises(Stop):
            scoring.fit_all(master, ["arpu", "tenure_months"])
    assert limits == [(6, 1), (6, 2), (6, 8)]
