"""Toxicity by weak supervision.

Many voters (word lists, learned families of stems and words, and patterns of style) look at each text. A generative
model of their votes, a tree of pairwise dependences within each class, estimates how accurate and how correlated they
are by EM over the vote counts of all documents and the known labels. Its posterior labels train a linear classifier over words and word beginnings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common

LABELLED = 8_000  # labelled documents, chosen by a hash of the id, that words and voters' accuracies are learned from
UNLABELLED = 8_000  # further documents; the posterior labels of all of these train the classifier
TERMS = 2_000  # words and word beginnings that the classifier weighs
FAMILIES = 8  # groups of terms behind the learned voters, each of toxic texts that the earlier ones miss
STEMS = 60  # terms of a family at most
LIFT = 4  # a family's terms are at least so many times as frequent in toxic texts
EVIDENCE = 10.0  # and their occurrences are so uneven: log likelihood against chance
QUIET = (0.97, 0.995)  # a family votes for a density that this share of the clean texts it occurs in stays below
WORDS = 150_000  # words whose terms a worker keeps
HELD_OUT = 2  # remainder of crc32(id) mod 4 whose labels are never read
THRESHOLD = 0.3

# fixed values: common English insults
LEXICON = (
    ("idiot", "moron", "imbecile", "stupid", "dumb", "fool", "clown", "cretin", "dimwit", "halfwit"),
    ("scum", "trash", "garbage", "vermin", "filth", "pig", "rat", "parasite", "worm"),
    ("loser", "pathetic", "worthless", "useless", "failure", "pitiful", "coward", "weakling"),
    ("disgusting", "revolting", "vile", "repulsive", "hideous", "ugly", "nasty", "sickening"),
)
LEARNED = 4  # density of stems, density of whole words, how many, how many different ones
VOTERS = len(LEXICON) + LEARNED + 3  # and repeated words, shouting, exclamation marks
_LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """A lower-cased word and its beginnings of three to eight letters."""
    out = []
    for w in _LETTERS.findall(word.lower()):
        out.append(w)
        out += [w[:k] + "-" for k in range(3, min(len(w), 9))]
    return out


class Terms:
    """Counts of a fixed list of terms in columns of texts."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        self.ids = {t: i for i, t in enumerate(self.terms)}

    def __getstate__(self):
        return {"terms": self.terms, "ids": self.ids}

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the terms in each row, and (words, shouted words, exclamation marks) by row."""
        if not hasattr(self, "_known") or len(self._known) > WORDS:
            self._known = {}
        spaced = pc.replace_substring_regex(column, pattern=r"[\n\t\r|]", replacement=" ")
        parts = pc.split_pattern(spaced, pattern=" ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        starts = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        row = np.repeat(np.arange(len(column)), np.diff(starts))
        known, ids = self._known, self.ids
        hits = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = tuple(i for t in terms_of(w) if (i := ids.get(t)) is not None)
            hits.append(h)
        each = np.fromiter(map(len, hits), dtype=np.int64, count=len(hits))
        flat = np.fromiter((i for h in hits for i in h), dtype=np.int64, count=int(each.sum()))
        live = np.flatnonzero(each[codes])
        n = each[codes[live]]
        source = np.repeat((np.cumsum(each) - each)[codes[live]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, count = np.unique(np.repeat(row[live], n) * len(self.terms) + flat[source], return_counts=True)
        loud = np.fromiter((w.isupper() and len(w) > 2 for w in words), dtype=bool, count=len(words))[codes]
        full = np.fromiter((bool(w) for w in words), dtype=bool, count=len(words))[codes]
        repeat = np.zeros(len(codes), dtype=bool)
        repeat[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1]) & full[1:]
        tally = lambda x: np.bincount(row, weights=x, minlength=len(column))
        style = np.stack([tally(full), tally(loud), tally(repeat), pc.count_substring(column, pattern="!").to_numpy(zero_copy_only=False)], axis=1)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), count, style


class Voters:
    """What the voters look for: the word lists, and families of terms with the densities from which they vote."""

    def __init__(self, terms: Terms, families: Sequence[Sequence[int]] = (), words: Sequence[Sequence[int]] = ()):
        self.lexicon = [[terms.ids[w] for w in group] for group in LEXICON]
        self.learned = [[(np.array(f, dtype=np.int64), (0.0, 0.0)) for f in kind if len(f)] for kind in (families, words)]
        self.all = np.unique(np.concatenate([[], *(f for kind in self.learned for f, _ in kind)])).astype(np.int64)

    @staticmethod
    def density(family: np.ndarray, row, term, count, style) -> np.ndarray:
        """Occurrences per word; a few words more are added, lest one occurrence decides a very short text."""
        mine = np.isin(term, family)
        return np.bincount(row[mine], weights=count[mine], minlength=len(style)) / (np.maximum(style[:, 0], 1) + 10)

    def calibrate(self, clean: np.ndarray, row, term, count, style) -> "Voters":
        """Set each family's densities by the known clean texts that it occurs in, so that those of its own language count."""
        for kind in self.learned:
            for i, (family, _) in enumerate(kind):
                seen = self.density(family, row, term, count, style)
                seen = seen[clean & (seen > 0)]
                kind[i] = (family, tuple(np.quantile(seen, QUIET)) if len(seen) else (0.0, 0.0))
        return self

    def votes(self, row, term, count, style) -> np.ndarray:
        """(rows, VOTERS) of 0, 1, 2: nothing seen, something, much."""
        n = len(style)
        out = np.zeros((n, VOTERS), dtype=np.int64)
        for v, group in enumerate(self.lexicon):
            mine = np.isin(term, group)
            out[:, v] = np.digitize(np.bincount(row[mine], weights=count[mine], minlength=n), [1, 3])
        for v, kind in enumerate(self.learned, len(LEXICON)):
            for family, cuts in kind:  # a text is in one language: the family that it matches best votes
                seen = self.density(family, row, term, count, style)
                out[:, v] = np.maximum(out[:, v], np.digitize(seen, cuts, right=True) * (seen > 0))
        mine = np.isin(term, self.all)
        out[:, len(LEXICON) + 2] = np.digitize(np.bincount(row[mine], weights=count[mine], minlength=n), [3, 8])
        out[:, len(LEXICON) + 3] = np.digitize(np.bincount(row[mine], minlength=n), [2, 5])
        words = np.maximum(style[:, 0], 1)
        for v, (what, cuts) in enumerate(((style[:, 2], (0.05, 0.3)), (style[:, 1], (0.1, 0.5)), (style[:, 3], (0.02, 0.2)))):
            out[:, len(LEXICON) + LEARNED + v] = np.digitize(what / words, cuts)
        return out


def related(a: str, b: str) -> bool:
    """Whether one of two terms is the beginning of the other."""
    a, b = a.rstrip("-"), b.rstrip("-")
    return a.startswith(b) or b.startswith(a)


def learn_voters(terms: Terms, chosen: Sequence[str], label: np.ndarray, row, term, count, style) -> Voters:
    """Families of terms from the known rows of the sample (``label`` 1, 0, or -1 where it is not known).

    Terms come strongest first. One that mostly occurs in toxic texts that a family already covers joins it, others open a
    new family; what the word lists cover needs none. Languages come out as families, without being read. No term of a
    family begins with another one, so a word counts once; the words that begin with its first terms are its second kind.
    """
    width = len(terms.terms)
    toxic, clean = label == 1, label == 0
    sides = (toxic, clean)
    times = np.stack([np.bincount(term[s[row]], weights=count[s[row]], minlength=width) for s in sides])
    size = np.array([[max(style[s, 0].sum(), 1.0)] for s in sides])
    lift = times[0] / size[0] / ((times[1] + 1) / size[1])
    chance = times.sum(axis=0) * size / size.sum()
    evidence = (times * np.log(np.maximum(times, 1e-9) / np.maximum(chance, 1e-9))).sum(axis=0)
    mine = toxic[row]
    order = np.argsort(term[mine], kind="stable")
    texts, starts = row[mine][order], np.searchsorted(term[mine][order], np.arange(width + 1))
    lexicon = [w for group in LEXICON for w in group]
    covered = [set(row[mine & np.isin(term, [terms.ids[w] for w in lexicon])].tolist())]
    families: list[list[int]] = [[]]
    for t in chosen:
        i = terms.ids[t]
        if lift[i] < LIFT or evidence[i] < EVIDENCE or any(related(t, w) for w in lexicon):
            continue
        holds = set(texts[starts[i] : starts[i + 1]].tolist())
        best = max(range(len(covered)), key=lambda f: len(holds & covered[f]))
        if 2 * len(holds & covered[best]) < len(holds):
            if len(families) > FAMILIES:
                continue
            best = len(families)
            families.append([])
            covered.append(set())
        if best and len(families[best]) < STEMS and not any(related(t, terms.terms[j]) for j in families[best]):
            families[best].append(i)
            covered[best] |= holds
    families = families[1:]
    heads = [[terms.terms[i].rstrip("-") for i in f[:2]] for f in families]
    whole = [t for t in chosen if not t.endswith("-") and lift[terms.ids[t]] > 2 * LIFT]
    words = [[terms.ids[t] for t in whole if any(t.startswith(h) for h in head)] for head in heads]
    return Voters(terms, families, words).calibrate(clean, row, term, count, style)


def encode(votes_: np.ndarray) -> np.ndarray:
    return votes_ @ 3 ** np.arange(VOTERS)


def decode(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(VOTERS)) % 3


class LabelModel:
    """P(label) and, for each voter, P(vote | label, vote of the voter it depends on most)."""

    def fit(self, votes_: np.ndarray, counts: np.ndarray, label: np.ndarray, rounds: int = 40) -> "LabelModel":
        """``label``: 1, 0 or -1 (unknown) of each counted pattern. Known labels stay as they are."""
        known = label >= 0
        first = (votes_[:, : len(LEXICON) + LEARNED] > 0).any(1)
        post = np.where(known, label, np.where(first, 0.7, 0.02)).astype(np.float64)
        self.parent = np.full(VOTERS, -1)
        for i in range(rounds):
            if i % 10 == 5:
                self.parent = self._tree(votes_, counts, post)
            self._estimate(votes_, counts, post)
            post = np.where(known, label, self.posterior(votes_))
        return self

    def _joint(self, votes_, weight, a, b):
        table = np.full((3, 3), 0.3)
        np.add.at(table, (votes_[:, a], votes_[:, b]), weight)
        return table

    def _tree(self, votes_, counts, post) -> np.ndarray:
        """Greatest spanning tree over the voters' mutual information given the label."""
        info = np.zeros((VOTERS, VOTERS))
        for a in range(VOTERS):
            for b in range(a):
                for w in (counts * post, counts * (1 - post)):
                    t = self._joint(votes_, w, a, b)
                    p = t / t.sum()
                    info[a, b] += t.sum() * (p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0)))).sum()
                info[b, a] = info[a, b]
        parent, inside = np.full(VOTERS, -1), {0}
        while len(inside) < VOTERS:
            a, b = max(((a, b) for a in inside for b in range(VOTERS) if b not in inside), key=lambda e: info[e])
            parent[b] = a
            inside.add(b)
        return parent

    def _estimate(self, votes_, counts, post) -> None:
        self.prior = float(np.clip((counts * post).sum() / max(counts.sum(), 1), 1e-4, 0.9999))
        self.tables = []
        for v in range(VOTERS):
            sides = []
            for w in (counts * (1 - post), counts * post):
                t = self._joint(votes_, w, v, self.parent[v]) if self.parent[v] >= 0 else self._joint(votes_, w, v, v).diagonal()[:, None].repeat(3, 1)
                sides.append(np.log(t / t.sum(0)))
            self.tables.append(sides)

    def posterior(self, votes_: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes_), np.log(self.prior / (1 - self.prior)))
        for v, (clean, toxic) in enumerate(self.tables):
            up = votes_[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(votes_), dtype=np.int64)
            odds += toxic[votes_[:, v], up] - clean[votes_[:, v], up]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Scorer:
    """The fitted classifier: terms, their weights, and what the style of a text adds."""

    def __init__(self, terms: Terms, weights: np.ndarray, bias: float):
        self.terms, self.weights, self.bias = terms, weights, bias

    def score(self, column: pa.Array) -> np.ndarray:
        row, term, count, style = self.terms.count(column)
        z = np.full(len(column), self.bias)
        z += np.bincount(row, weights=self.weights[term] * value(count, style[row, 0]), minlength=len(column))
        z += style_features(style) @ self.weights[len(self.terms.terms) :]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def value(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The weight of a term seen ``count`` times: its logarithm, less in longer texts, where chance brings more."""
    return np.log1p(count) / np.log(np.e + words / 400)


def style_features(style: np.ndarray) -> np.ndarray:
    words = np.maximum(style[:, 0], 1)
    return np.stack([np.log1p(style[:, 0]) / 8, style[:, 1] / words, style[:, 2] / words, np.minimum(style[:, 3] / words, 2)], axis=1)


def logistic(row, term, x, extra, target, weight, terms: int, rounds: int = 300, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a penalised logistic regression on soft targets, by Adam over all rows."""
    w, b = np.zeros(terms + extra.shape[1]), float(np.log((target * weight).sum() + 1) - np.log(((1 - target) * weight).sum() + 1))
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    n = len(target)
    for it in range(1, rounds + 1):
        z = b + np.bincount(row, weights=w[term] * x, minlength=n) + extra @ w[terms:]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        g = np.concatenate([np.bincount(term, weights=d[row] * x, minlength=terms), extra.T @ d]) + penalty * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * d.sum(), 0.99 * sb + 0.01 * d.sum() ** 2
        step = 0.1 / (1 + it / 100)
        w -= step * (m / (1 - 0.9**it)) / (np.sqrt(s / (1 - 0.99**it)) + 1e-8)
        b -= step * (mb / (1 - 0.9**it)) / (np.sqrt(sb / (1 - 0.99**it)) + 1e-8)
    return w, b


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def _sample(rows: DataFrame, labels: DataFrame, labelled: int, unlabelled: int) -> DataFrame:
    """(doc_id, text, label) of a bounded number of documents; label null where it is not known or not to be read."""
    order = [F.xxhash64("doc_id", F.lit(3)), "doc_id"]
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("label"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(*order).limit(labelled)
    marks = materialize(rows.select("doc_id").distinct().join(F.broadcast(marks), "doc_id"), "toxic_marks")
    rest = rows.select("doc_id").where("doc_id is not null").distinct().join(F.broadcast(marks), "doc_id", "left_anti")
    rest = rest.orderBy(*order).limit(unlabelled).select("doc_id", F.lit(None).cast("int").alias("label"))
    ids = marks.union(rest).groupBy("doc_id").agg(F.max("label").alias("label"))
    return materialize(rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label"), "toxic_sample")


def _terms(sample: DataFrame, limit: int) -> list[tuple[str, int, int]]:
    """(term, toxic documents, clean documents) of the terms that tell the labels apart best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            found: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in {t for w in set(text.split()) for t in terms_of(w)}:
                    found.setdefault(t, [0, 0])[1 - label] += 1
            yield common.batch_of(term=list(found), toxic=[a for a, _ in found.values()], clean=[b for _, b in found.values()])

    counted = sample.where("label is not null").select("text", "label").mapInArrow(run, "term string, toxic long, clean long")
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3")
    total = sample.agg(F.sum(F.coalesce("label", F.lit(0))).alias("p"), F.count("label").alias("n")).first()
    p, n = max(int(total["p"] or 0), 1), max(int(total["n"]) - int(total["p"] or 0), 1)
    ratio = F.log(((F.col("toxic") + 0.5) / (p + 1)) / ((F.col("clean") + 0.5) / (n + 1)))
    strength = ratio / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))  # log odds in their standard deviations
    best = counted.withColumn("z", strength).orderBy(F.col("z").desc(), "term").limit(limit).collect()
    return [(r["term"], r["toxic"], r["clean"]) for r in best]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Scorer:
    """A scorer for documents (doc_id, text); labels (doc_id, toxic) of held-out ids are not read.

    Labels choose the terms and enter the label model; the classifier sees that model's posterior only, for every row.
    Without any toxic label only the fixed word lists and styles vote.
    """
    sample = _sample(docs, labels, labelled, unlabelled)
    chosen = [t for t, _, _ in _terms(sample, TERMS)]
    terms = Terms(list(dict.fromkeys([w for group in LEXICON for w in group] + chosen)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            row, term, n, style = terms.count(batch.column(0))
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield common.batch_of(
                label=batch.column(1), style=common.fixed_binary(style.astype(np.float64)),
                term=common.ragged_binary(term.astype(np.int32), starts), n=common.ragged_binary(n.astype(np.int32), starts),
            )

    rows = sample.orderBy("doc_id").select("text", "label").mapInArrow(count, "label int, style binary, term binary, n binary").collect()
    label = np.array([-1 if r["label"] is None else r["label"] for r in rows], dtype=np.int64)
    style = np.array([np.frombuffer(r["style"]) for r in rows]).reshape(-1, 4)
    each = [np.frombuffer(r["term"], dtype=np.int32) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(t) for t in each])
    term = np.concatenate(each).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)
    times = np.concatenate([np.frombuffer(r["n"], dtype=np.int32) for r in rows]) if rows else np.zeros(0)
    voters = learn_voters(terms, chosen, label, row, term, times, style)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            code, n = np.unique(encode(voters.votes(*terms.count(batch.column(0)))), return_counts=True)
            yield common.batch_of(code=code, n=n)

    # patterns of votes over all documents; there are 3 ** VOTERS of them at most
    seen = docs.select("text").mapInArrow(vote, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    own = encode(voters.votes(row, term, times, style))
    pairs, held = np.unique(np.stack([own, label], axis=1)[label >= 0], axis=0, return_counts=True)
    codes = np.array([r["code"] for r in seen], dtype=np.int64)
    n = np.array([r["n"] for r in seen], dtype=np.float64)
    n *= min(1.0, 2 * max(held.sum(), 1) / max(n.sum(), 1))  # unlabelled documents weigh twice the labelled ones at most
    model = LabelModel().fit(
        decode(np.concatenate([codes, pairs[:, 0]])), np.concatenate([n, held]), np.concatenate([np.full(len(codes), -1), pairs[:, 1]])
    )
    posterior = model.posterior(decode(own))
    w, b = logistic(row, term, value(times, style[row, 0]), style_features(style), posterior, np.ones(len(rows)), len(terms.terms))
    return Scorer(terms, w, b)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``. A null text is scored as the empty one, a null id is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            yield common.batch_of(doc_id=batch.column(0), score=scorer.score(batch.column(1)))

    out = common.texts(docs, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accept(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            keep = scorer.score(batch.column(at).fill_null("")) < threshold
            columns = batch.columns
            columns[at] = columns[at].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
