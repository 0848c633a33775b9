"""SetSketch classes against brute force, and components against union-find."""

import random

import numpy as np

from pyspark.sql import functions as F

from subscope.llm import common, graph, setsketch
from subscope.llm import queries as q


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def shingles(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def brute(rows, size, percent=80):
    sets = [(i, shingles(t, size)) for i, t in rows]
    union = Union()
    for k, (i, x) in enumerate(sets):
        union.find(i)
        for j, y in sets[:k]:
            both = len(x & y)
            if both and 100 * both >= percent * len(x | y):
                union.link(i, j)
    return {i: (len(x), union.find(i)) for i, x in sets}


def mutated(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(50)}"
    return " ".join(out)


def test_whole_table(spark, texts, sf_dir):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in q.op10_setsketch_near_dedup(spark, sf_dir).collect()}
    assert got == brute(texts.items(), 2)


def test_large_group_at_the_threshold(spark):
    """Pairs on both sides of 0.8, and chains that only some links hold together."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(400)}" for _ in range(90)]
    rows = [(1000 + i, mutated(rng, words, rng.randrange(1, 14))) for i in range(160)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(3000 + i, mutated(rng, words[:8], 1)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (2, 5):
        out = setsketch.near_duplicates(df, size).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, size)
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_odd_rows(odd):
    out = setsketch.near_duplicates(odd, 2).collect()
    assert len(out) == odd.count()
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (None, 1, 5, False), (7, 1, 7, True), (8, 1, 7, False), (None, 0, None, True)} <= found
    kept = setsketch.distinct_documents(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 5, 7]
    assert setsketch.near_duplicates(odd.where("false"), 2).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.3, 0.6, 0.9):
        n = int(2000 * share)
        a, b = x[:2000], x[2000 - n : 4000 - n]
        ra, rb = setsketch.registers([np.sort(a), np.sort(b)], 1024)
        union = setsketch.registers([np.unique(np.concatenate([a, b]))], 1024)[0]
        assert (setsketch.merge(ra, rb) == union).all()
        true = n / len(np.union1d(a, b))
        found = setsketch.estimate(ra[None], rb[None], np.array([2000]), np.array([len(b)]))[0]
        assert abs(found - true) < 0.06


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(i, i + 1) for i in range(5000, 5100)] + [(7000, i) for i in range(7001, 7200)]
    union = Union()
    for a, b in edges:
        if a != b:
            union.link(a, b)
    df = spark.createDataFrame(edges + [(None, 3), (None, None)], "u long, v long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {x: union.find(x) for e in edges for x in e if e[0] != e[1]}
    assert graph.components(df.where("false")).count() == 0


def test_split_join(spark):
    """The rows of a plain join, with those of a hot key in many tasks."""
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k"))
    right = spark.createDataFrame([(k, f"v{k}") for k in range(-1, 40)] + [(5, "again"), (None, "none")], "k long, v string")
    counted = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left"):
        out = common.split_join(left, right, ["k"], 6000, counted, how)
        assert out.columns == ["k", "id", "v"]
        assert sorted(map(str, out.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as for large tables
    for name, value in settings.items():
        spark.conf.set(name, value)
    spread = common.split_join(left, right, ["k"], 6000, counted).where("k = -1").groupBy(F.spark_partition_id().alias("p")).count()
    sizes = [r["count"] for r in spread.collect()]
    for name in settings:
        spark.conf.unset(name)
    assert sum(sizes) == 2000 and max(sizes) < 1500
    assert common.split_join(left.where("false"), right, ["k"], 0, counted.where("false")).count() == 0
