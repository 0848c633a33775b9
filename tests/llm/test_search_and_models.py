"""Nearest neighbours against brute force, toxicity on held-out labels, the pipeline against its plain steps."""

import re
import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry_module
import corpus_pipeline
from subscope.llm import common, decontamination, permutation_index, toxicity
from subscope.llm import queries as q


def test_recall_and_order(spark, sf_dir):
    rows = common.read(spark, sf_dir, "embeddings").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    out = {}
    for r in q.op1_permutation_index(spark, sf_dir).collect():
        out.setdefault(r.query_id, []).append(r)
    assert set(out) == {i for i in ids if i % 20 == 0}
    hit = 0
    for i, found in out.items():
        found.sort(key=lambda r: r.rank)
        s = x @ x[ids == i][0]
        assert [r.rank for r in found] == list(range(1, 21)) and i not in {r.vec_id for r in found}
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in found)
        assert found == sorted(found, key=lambda r: (-r.score, r.vec_id))
        best = [v for v in ids[np.lexsort((ids, -s))] if v != i][:20]
        hit += len(set(best) & {r.vec_id for r in found})
    assert hit >= 0.9 * 20 * len(out)


def test_recall_with_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9000, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = permutation_index.search(df, df.where("vec_id % 300 = 0"), k=10).collect()
    hit = 0
    for i in range(0, 9000, 300):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(set(np.argsort(-s)[:10].tolist()) & {r.vec_id for r in found if r.query_id == i})
    assert hit >= 0.9 * 10 * 30


def test_unusable_vectors_ties_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [None, 1.0])]
    rows += [(10, [1.0, 1.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (8, [2.0, 5.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, block string, rank int")
    out = [(r.query_id, r["rank"], r.vec_id, r.score) for r in permutation_index.search(df, df.where("vec_id % 20 = 0"), k=3).collect()]
    assert sorted(out) == [(0, 1, 8, 2.0), (0, 2, 9, 1.0), (0, 3, 10, 1.0), (20, 1, 0, -1.0), (20, 2, 9, -1.0), (20, 3, 10, -1.0)]
    assert permutation_index.search(df.where("false"), df.where("false")).count() == 0
    assert permutation_index.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    mixed = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    got = permutation_index.search(mixed, mixed.where("vec_id < 2")).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(0, 1, 1.0), (0, 2, 2.0), (0, 3, 6.0), (1, 0, 1.0), (1, 2, 0.0), (1, 3, 1.0)]


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = label == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_toxicity_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = q.op5_toxicity(spark, sf_dir).toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    held = out[out.held_out].merge(common.read(spark, sf_dir, "labels").toPandas(), on="doc_id")
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.9
    clean = held[held.toxic == 0]
    assert clean.predicted.mean() < 0.05


def test_scores_against_a_plain_version(spark, docs, sf_dir, odd):
    """Each text's score word by word: terms and their counts, then the weights."""
    scorer = toxicity.train(common.texts(docs), common.read(spark, sf_dir, "labels"))
    rows = {r.doc_id: r.text for r in docs.limit(60).collect()} | {-1: odd.where("doc_id = 4").first().text, -2: "Idiot!! IDIOT idiot", -3: ""}
    weight = dict(zip(scorer.terms.terms, scorer.weights))
    scored = toxicity.score(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), scorer)
    for r in scored.collect():
        parts = [w for w in re.split(r"[\n\t\r| ]", rows[r.doc_id])]
        words = [w for w in parts if w]
        n, m = len(words), max(len(words), 1)
        counts = Counter(t for w in parts for t in toxicity.terms_of(w) if t in weight)
        z = scorer.bias + sum(weight[t] * np.log1p(c) / np.log(np.e + n / 400) for t, c in counts.items())
        style = (np.log1p(n) / 8, sum(w.isupper() and len(w) > 2 for w in words) / m,
                 sum(a == b != "" for a, b in zip(parts, parts[1:])) / m, min(rows[r.doc_id].count("!") / m, 2))
        z += float(np.dot(style, scorer.weights[len(weight) :]))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9, r.doc_id


def test_held_out_labels_are_not_read(spark, docs, sf_dir):
    labels = common.read(spark, sf_dir, "labels")
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    rows = common.texts(docs)
    a, b = (toxicity.train(rows, t) for t in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_label_model_separates_planted_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.15
    votes = np.zeros((4000, toxicity.VOTERS), dtype=np.int64)
    for v in range(toxicity.VOTERS):
        votes[:, v] = np.where(y, rng.random(4000) < 0.5, rng.random(4000) < 0.03) * rng.integers(1, 3, 4000)
    votes[:, 1] = votes[:, 0]  # a copy adds nothing
    model = toxicity.LabelModel().fit(votes, np.ones(4000), np.full(4000, -1))
    assert model.parent[1] == 0
    assert auc(model.posterior(votes), y.astype(int)) > 0.98 and abs(model.prior - y.mean()) < 0.05


def test_toxicity_of_odd_rows(spark, odd, docs, sf_dir):
    labels = common.read(spark, sf_dir, "labels")
    scorer = toxicity.train(common.texts(docs), labels)
    out = toxicity.score(odd, scorer).collect()
    assert len(out) == odd.count() and len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert not any(r.held_out for r in out if r.doc_id is None)
    assert toxicity.accept(odd, scorer).columns == odd.columns
    assert toxicity.score(odd.where("false"), scorer).count() == 0
    unlabelled = toxicity.train(common.texts(odd), labels.where("false"))
    assert toxicity.score(odd, unlabelled).count() == odd.count()
    assert toxicity.train(common.texts(odd.where("false")), labels.where("false")) is not None


def test_pipeline(spark, sf_dir, texts):
    """Each stage against a plain version of its decision on its own input."""
    from test_near_duplicates import brute

    docs = common.read(spark, sf_dir, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf_dir)
        rows = {r.doc_id: r.text for r in before.collect()}
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.collect()} == set(rows)
            break
        assert out.columns == docs.columns
        left = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            assert len(left) > 0.85 * len(rows)
        elif name == "near_dedup":
            assert set(left) == {i for i, (_, c) in brute(rows.items(), 5).items() if i == c}
        elif name == "benchmark_decontamination":
            items = [decontamination.normal(r.text) for r in common.read(spark, sf_dir, "benchmark").collect()]
            leaks = {i for i, t in rows.items() if any(b in decontamination.normal(t) for b in items)}
            assert leaks and not leaks & set(left) and len(left) >= len(rows) - len(leaks) - 2
        elif name == "secret_scan":
            changed = {i for i in rows if rows[i] != left[i]}
            assert set(left) == set(rows) and all("[SECRET]" in left[i] for i in changed)
            assert changed >= {i for i, t in rows.items() if 'token = "' in t}
        before = spark.createDataFrame(out.collect(), out.schema)


def test_registration():
    names = set(entry_module.queries())
    assert {*q.QUERIES, "pipeline"} <= names and {n.split("_")[0] for n in q.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(q.ORACLES) <= set(q.QUERIES)


def test_classifier_is_trained_on_posteriors(spark, docs, sf_dir, monkeypatch):
    """Every training row has the label model's posterior as its target, at full weight; unlabelled rows are further ones."""
    seen, fitted = [], []
    logistic, posterior = toxicity.logistic, toxicity.LabelModel.posterior
    monkeypatch.setattr(toxicity, "logistic", lambda *a: seen.append(a) or logistic(*a))
    monkeypatch.setattr(toxicity.LabelModel, "posterior", lambda self, v: fitted.append(posterior(self, v)) or fitted[-1])
    labels = common.read(spark, sf_dir, "labels")
    known = labels.where(~toxicity.held_out(labels["doc_id"]) & labels["toxic"].isin(0, 1)).join(docs, "doc_id").select("doc_id").distinct().count()
    toxicity.train(common.texts(docs), labels, unlabelled=30)
    *_, target, weight, _ = seen[0]
    assert len(target) == known + 30 and np.array_equal(target, fitted[-1]) and (weight == 1).all()
