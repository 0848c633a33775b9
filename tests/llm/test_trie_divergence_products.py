"""Prefix tries, source divergence and exact inner products against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from subscope.llm import ball_tree, checks, common, divergence, prefix_trie
from subscope.llm import queries as q


def plain_trie(paths):
    """Nodes of {conv_id: [(role, text), ...]} by walking every prefix."""
    members = defaultdict(list)
    for c, turns in sorted(paths.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, cs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(cs) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(paths[c]) == len(n))
        parent = members[n[:-1]][0] if n else None
        out.append((cs[0], len(n), parent, len(cs), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(int(c / 100) * 100, [])[:h] + ts[h:]
    return out


def found_trie(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("bits", [12, 1])
def test_trie_of_shared_beginnings(spark, monkeypatch, bits):
    """Few different turns, so that prefixes are shared at every depth, blocks diverge anywhere and whole conversations repeat."""
    monkeypatch.setattr(prefix_trie, "SPAN_BITS", bits)
    rng = random.Random(bits)
    paths = {}
    for c in range(60):
        base = paths[rng.randrange(c)] if c and rng.random() < 0.7 else []
        turns = base[: rng.randint(0, len(base))] + [("user", rng.choice(["a", "bb", "ñandú 語"])) for _ in range(rng.randint(0, 9))]
        paths[c] = base[:] if rng.random() < 0.2 else turns
    paths[60] = [("user", str(i)) for i in range(300)]  # one long conversation, and one that leaves it near its end
    paths[61] = paths[60][:290] + [("user", "x")]
    rows = [(c, i, *t) for c, ts in paths.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    ids = spark.createDataFrame([(c,) for c in [*paths, None, 5, 5]], "conv_id long")
    turns = prefix_trie.ordered(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found_trie(prefix_trie.trie(turns, ids)) == plain_trie(paths)


def test_trie_of_rebuilt_conversations(spark, sf_dir):
    rows = [tuple(r) for r in common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found_trie(q.op11_prefix_trie(spark, sf_dir)) == plain_trie(plain_rebuilt(rows))


def test_trie_of_odd_conversations(spark):
    """Null ids, turns, roles and texts, repeated rows, absent first conversations, conversations left without a turn, clashing names."""
    rows = [(c, t, "user" if t % 2 else None, None if t == 3 else f"t{t % 4}") for c in (0, 1, 2, 3, 17, 105, 106, 107, 250, -4, 300) for t in range(c % 7 + 1)]
    rows += [(None, 0, "user", "lost"), (2, None, "user", "first"), (2, None, "user", "first"), (9, 5, "", ""), (300, 9, "x" * 3, "long " * 40_000)]
    df = spark.createDataFrame([(*r, 1, 2, "n") for r in rows], f"{SCHEMA}, depth int, pos int, bucket string")
    turns, ids = prefix_trie.rebuilt(prefix_trie.ordered(df))
    expected = plain_rebuilt(rows)
    assert found_trie(prefix_trie.trie(turns, ids)) == plain_trie(expected) and any(not t for t in expected.values())
    none = df.where("false")
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered(none))).count() == 0
    only = spark.createDataFrame([(7,)], "conv_id long")
    assert [tuple(r)[:7] for r in prefix_trie.trie(prefix_trie.ordered(none), only).collect()] == [(7, 0, None, 1, 0, 1, 0)]


def test_blocks_that_all_share_are_not_taken_apart(spark):
    paths = {c: [("user", str(i)) for i in range(8)] + [("user", f"end {c}")] for c in range(5)}
    rows = [(c, i, *t) for c, ts in paths.items() for i, t in enumerate(ts)]
    turns = prefix_trie.ordered(spark.createDataFrame(rows, SCHEMA))
    deep = turns.selectExpr("conv_id", "pos + 1 AS depth", "xxhash64(a, b, pos) AS x", "xxhash64(b, a, pos) AS y", "tokens")
    classes = spark.createDataFrame([(c, 9, 1, 20) for c in paths], "conv_id long, depth long, w long, total long")
    placed = {(r.block, r.same, r.conv_id) for r in prefix_trie._placed(deep, classes, 5).collect()}
    assert placed == {(b, b < 2, c) for b in range(3) for c in paths}


def plain_audit(rows, least_docs, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        held, counts = Counter(), defaultdict(Counter)
        for _, s, ws in (w for w in words if w[0] == lang):
            held.update(set(ws))
            counts[s].update(ws)
        kept = sorted((t for t in held if held[t] >= least_docs), key=str.encode)
        total = Counter()
        for c in counts.values():
            total.update(c)
        size = lambda c: sum(c[t] for t in kept)
        share = {s: {t: 1 + 10**9 * (c[t] + 5) // (size(c) + 5 * len(kept)) for t in kept} for s, c in [*counts.items(), (None, total)]}
        for s, c in counts.items():
            pair = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            term = [(share[None][t] - share[s][t], t.encode(), t) for t in kept if c[t] and share[s][t] > share[None][t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def test_divergence_of_odd_rows(spark, odd):
    """Null text, language and source, empty and very long texts, repeated rows, ties, a group without terms, more sources than a block holds."""
    rng = random.Random(4)
    vocabulary = ["Äpfel", "STRASSE", "été", "日本", "zz", "a"] + [f"w{i}x" for i in range(30)]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "É", None])) for _ in range(300)]
    rows += [(None, "fr", "s1"), ("...", "fr", "s2"), ("only", "it", "s1"), ("one word " * 30_000, "en", "s2")] + [("ties b a", "es", "s1")] * 3 + [("ties c", "es", "s2")] * 3
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "text string, lang string, source string, n int, item string, value int")
    assert sorted(tuple(r) for r in divergence.audit(df, 3, 7).collect()) == plain_audit(rows, 3, 7)
    assert divergence.audit(df.where("false")).count() == 0
    assert divergence.audit(df, 10**6).where("part = 'term' OR value <> 0").count() == 0


def test_divergence_in_blocks(spark, monkeypatch):
    """Small blocks of terms and sources, and a task that passes its counts on often, change nothing."""
    rng = random.Random(5)
    rows = [(" ".join(f"t{'abcdefghij'[rng.randrange(10)]}{'klmnopq'[rng.randrange(7)]}" for _ in range(8)), "en", f"s{rng.randrange(9)}") for _ in range(200)]
    for name, value in (("TERMS", 4), ("SOURCES", 2), ("ENTRIES", 20)):
        monkeypatch.setattr(divergence, name, value)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert sorted(tuple(r) for r in divergence.audit(df, 2, 5).collect()) == plain_audit(rows, 2, 5)


def test_shares_are_exact(spark):
    n, size, terms = 9_000_000_000_000, 9_000_000_000_001, 3
    df = spark.createDataFrame([(n, size, terms)], "n long, size long, terms long").select(divergence._share("n", "size"))
    assert df.first()[0] == 1 + 10**9 * (n + 5) // (size + 5 * terms)


def plain_products(rows, queries, k):
    vectors = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for query in sorted({i for i, _ in vectors if queries(i)}):
        best = {}
        for v in [v for i, v in vectors if i == query]:
            for i, u in vectors:
                if i != query:
                    s = sum(a * b for a, b in zip(u, v))
                    best[i] = max(best.get(i, s), s)
        top = sorted(best, key=lambda i: (-best[i], i))[:k]
        out += [(query, r, i, best[i]) for r, i in enumerate(top, 1)]
    return out


@pytest.mark.parametrize("most", [1 << 21, 600])
def test_products_in_shards(spark, most):
    """One shard, and many in three rounds; a third of the vectors are one, others near it, so scores tie."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6)) + 3 * rng.normal(size=(7, 6))[np.arange(700) % 7]
    x[::3] = x[0]
    x[5] = 0
    rows = [(int(i) - 20, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = ball_tree.search(df, df.where("vec_id % 10 = 0"), 5, most=most, least=10**9)
    assert sorted(tuple(r) for r in found.collect()) == plain_products(rows, lambda i: i % 10 == 0, 5)


def test_products_of_odd_vectors(spark):
    """Unusable, zero, empty, short and huge vectors, repeated rows, several vectors under one id, clashing names."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [-inf, 1.0]), (5, []), (6, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(10, [1.0, 1.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (8, [2.0]), (50, [-1.0, 0.25, 7.0]), (50, [3.0, 0.0]), (11, [2.0, 5.0]), (11, [-2.0, 0.1])]
    for more in ([], [(12, [3e7, -4e7]), (100, [2e7, 5e7 + 0.3])]):
        df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows + more], "vec_id long, embedding array<double>, shard string, rank int, v int")
        found = ball_tree.search(df, df.where("vec_id % 50 = 0"), 4)
        assert sorted(tuple(r) for r in found.collect()) == plain_products(rows + more, lambda i: i % 50 == 0, 4)
    far = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ball_tree.search(far, far.where("vec_id = 0")).collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
    assert ball_tree.search(df.where("false"), df.where("false")).count() == 0
    assert ball_tree.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_bounds_leave_most_of_a_clustered_shard_out():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(40, 8)) * 4).repeat(100, axis=0) + 10 * rng.normal(size=(4000, 8)))
    tree, seen = ball_tree.Tree(np.arange(4000), x), []
    scores, tree.scores = tree.scores, lambda a, b, *r: seen.append(b - a) or scores(a, b, *r)
    for i, bound in zip(range(0, 4000, 100), tree.bounds(x[::100])):
        best = tree.best(x[i], bound, i, None, 5)
        assert best == sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:5]
    assert sum(seen) < 0.3 * 40 * 4000


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_source_divergence", "op13_ball_tree_topk"])
def test_against_sql(spark, duck, sf_dir, name):
    sql = {"op11_prefix_trie": checks.prefix_trie(), "op12_source_divergence": checks.source_divergence(), "op13_ball_tree_topk": checks.top_products(5)}
    out = q.QUERIES[name](spark, sf_dir)
    expected = duck.execute(f"SELECT {', '.join(out.columns)} FROM ({sql[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, expected))
