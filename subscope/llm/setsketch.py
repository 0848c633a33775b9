"""Near-duplicate classes with SetSketch registers.

A sketch holds, for each of m hash functions, the smallest hash of the set on an exponential
scale of base b, cut off at both ends. Registers of two sets merge by maximum, and equal ones
are likelier the more alike the sets are. Bands of registers propose pairs, a joint likelihood of
larger, smaller and equal registers estimates their similarity, and the full sets confirm it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common, graph

ROWS, BANDS = 4, 27  # a pair at similarity 0.8 shares no band with probability 7e-7
BASE, RATE, TOP = 1.001, 20.0, 65_534  # register scale: values 0..TOP+1
MARGIN = 4.5  # standard deviations below the threshold at which an estimate rules a pair out
WORDS = 150_000  # word hashes that a worker keeps
SLOT_BITS = 20  # size of the table of shingle counts that orders them
HELD = 1_000_000  # shingles of recent texts that a worker keeps while it confirms pairs


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASH = _WordHash()


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles: A-Z lowered, words between ASCII white space.

    Fewer words than ``size`` give one shingle of all of them; no word gives none.
    """
    words = text.encode().lower().split()
    h = np.fromiter(map(_HASH.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    size = min(size, len(h))
    with np.errstate(over="ignore"):
        total = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            total = common.mix(total, k) + h[k : len(h) - size + 1 + k]
    return np.unique(common.mix(total, size))


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(len(sets), count) registers; every set must have an element."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    x = np.concatenate(sets)
    least = np.empty((len(sets), count), dtype=np.uint64)
    for i in range(count):
        least[:, i] = np.minimum.reduceat(common.mix(x, 0x5DEECE66D * (2 * i + 1)), starts)
    # the least uniform hash gives the least exponential one
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    scaled = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    return np.clip(scaled, 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 60) -> np.ndarray:
    """Joint maximum likelihood of the Jaccard similarity, row by row.

    With u, v the shares of either set in their sum, a register of the first is larger with probability
    p(u - v j), smaller with p(v - u j) and equal otherwise, where p(x) = -log_b(1 - x (b - 1) / b). The
    log-likelihood is concave in j; its maximum in [0, min(u/v, v/u)] is found by golden sections.
    """
    m = a.shape[1]
    more, less = (a > b).sum(1), (a < b).sum(1)
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return more * np.log(up + tiny) + less * np.log(down + tiny) + (m - more - less) * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    ratio = (5**0.5 - 1) / 2
    for _ in range(steps):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def sketch(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, regs): set size, 128-bit digest of the set, registers (empty for no words)."""
    count = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, limit=400_000):  # some 60,000 shingles: they stay in the cache
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(n)
            regs = [b""] * len(sets)
            keys = np.zeros((len(sets), 2), dtype=np.uint64)
            if len(full):
                for i, row in zip(full.tolist(), registers([sets[i] for i in full], count)):
                    regs[i] = row.tobytes()
                    with np.errstate(over="ignore"):  # sums over a set do not depend on its order
                        keys[i] = common.mix(sets[i], 101).sum(), common.mix(sets[i], 202).sum()
            yield common.batch_of(
                doc_id=batch.column(0), n_shingles=n, k1=keys[:, 0].view(np.int64), k2=keys[:, 1].view(np.int64), regs=pa.array(regs, pa.binary())
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, regs binary")


def _band_keys(heads: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, doc_id): one key per band of registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (batch.num_rows, bands)).copy()
                for r in range(rows):
                    key = common.mix(key ^ (regs[:, :, r].astype(np.uint64) + np.uint64(1)), r + 11)
                yield common.batch_of(key=key.ravel().view(np.int64), doc_id=np.repeat(batch.column(0).to_numpy(), bands))

    return heads.select("doc_id", "regs").mapInArrow(run, "key long, doc_id long")


def _alike(pairs: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) pairs with 100 * intersection >= percent * union; ``held`` has n_shingles, regs and text of all their documents.

    ``pairs`` is a stored table. A document of very many pairs has them dealt over several tasks. The likelihood estimate of two sketches rules most other pairs out; the full sets confirm the rest.
    """
    threshold = percent / 100
    side = lambda c: held.select(*(F.col(x).alias(y) for x, y in (("doc_id", c), ("n_shingles", f"n{c}"), ("regs", f"r{c}"), ("text", f"t{c}"))))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")  # sizes alone bound the similarity
    total = pairs.count()
    times = lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    joined = common.split_join(pairs, side("a"), ["a"], total, times("a"))
    joined = common.split_join(joined, side("b"), ["b"], total, times("b")).where(fits).select("a", "b", "ta", "tb", "ra", "rb", "na", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[str, np.ndarray] = {}
        weight = 0

        def of(text: str) -> np.ndarray:
            nonlocal weight
            if text not in recent:
                if weight > HELD:
                    recent.clear()
                    weight = 0
                recent[text] = shingles(text, size)
                weight += len(recent[text]) + len(text)
            return recent[text]

        for batch in common.bounded(batches, "ta"):
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in (4, 5))
            j = estimate(ra, rb, batch.column(6).to_numpy(), batch.column(7).to_numpy())
            batch = batch.filter(pa.array(j >= threshold - MARGIN * (threshold * (1 - threshold) / ra.shape[1]) ** 0.5))
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = of(ta), of(tb)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _across(shared: DataFrame, parts: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) pairs of documents in different components that may still be alike enough.

    Only members of buckets that hold several components take part. A prefix filter compares them: in one order of all shingles,
    rare ones first, two sets alike enough share a shingle among the first n - ceil(share * n) + 1 of either, at places that
    leave room for the overlap. Any order is right; this one sorts by counts in a table of fixed size.
    """
    member = shared.select("key", "doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    member = member.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    key = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    key = key.where("lo < hi")
    member = common.split_join(member, key.select("key"), ["key"], shared.count(), key)
    member = materialize(member.select("doc_id", "component").distinct(), "members")
    held = held.join(member.select("doc_id"), "doc_id").select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, limit=1_000_000):
            slots = np.concatenate([shingles(t, size) for t in batch.column(0).to_pylist()]) >> np.uint64(64 - SLOT_BITS)
            slot, n = np.unique(slots, return_counts=True)
            yield common.batch_of(slot=slot.astype(np.int32), n=n)

    counted = held.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    table[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared_table = held.sparkSession.sparkContext.broadcast(table)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared_table.value
        for batch in common.bounded(batches, limit=1_000_000):
            rows, found, places, sizes = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                x = shingles(text, size)
                n = table[x >> np.uint64(64 - SLOT_BITS)]
                first = np.lexsort((x, n))[: len(x) - -(-percent * len(x) // 100) + 1]
                at = np.flatnonzero(n[first] > 1)  # a shingle alone in its slot has no partner
                rows.append(np.full(len(at), row))
                found.append(x[first[at]])
                places.append(at)
                sizes.append(np.full(len(at), len(x)))
            rows = np.concatenate(rows)
            yield common.batch_of(
                doc_id=batch.column(0).take(pa.array(rows)), shingle=np.concatenate(found).view(np.int64), place=np.concatenate(places), n=np.concatenate(sizes)
            )

    rows = held.mapInArrow(prefix, "doc_id long, shingle long, place long, n long").join(member, "doc_id")
    rows = materialize(rows, "prefixes")
    times = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    other = rows.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("doc_id", "component", "place", "n")))
    room = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    fits = (
        (F.col("component") < F.col("component2"))
        & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
        & ((100 + percent) * room >= percent * (F.col("n") + F.col("n2")))
    )
    pairs = common.split_join(rows, other, ["shingle"], rows.count(), times).where(fits)
    return pairs.select(F.least("doc_id", "doc_id2").alias("a"), F.greatest("doc_id", "doc_id2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int, percent: int = 80, text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Equal sets are one class, so copies cost nothing further. Of each band's bucket every member is
    paired with two members chosen by hash, one of them anew in each band, so a large group is
    joined by a few links a member; what still lies in different components of one bucket is
    then compared completely, so a link is lost only if no band proposes it. Joins on a set, bucket, document or shingle that very
    many rows share are dealt over several tasks. Null or word-less texts have
    no shingles and are their own component. A null doc_id takes part as a copy of others only; alone it has a null
    component and is kept. Rows that share a doc_id are one document. An empty table gives no rows.
    """
    base = common.texts(docs, text_col)
    drawn = materialize(sketch(base, size, bands, rows), "sketches")
    known = F.when(F.col("n_shingles") > 0, F.col("doc_id"))
    classes = drawn.groupBy("k1", "k2").agg(F.min(known).alias("head"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "classes")
    heads = drawn.join(classes.where("head is not null").select("k1", "k2", F.col("head").alias("doc_id")), ["k1", "k2", "doc_id"])
    heads = materialize(heads.dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "n_shingles", "regs"), "heads")

    keyed = _band_keys(heads, bands, rows)
    # two members by hash: one order for all bands, and one of its own for each
    bucket = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("doc_id", F.xxhash64("doc_id")).alias("c1"),
        F.min_by("doc_id", F.xxhash64("doc_id", "key")).alias("c2"),
    )
    shared = common.split_join(keyed, bucket.where("n > 1").drop("n"), ["key"], bands * heads.count(), bucket)
    shared = materialize(shared.select("key", "doc_id", "c1", "c2"), "buckets")
    ordered = [F.least("doc_id", "c").alias("a"), F.greatest("doc_id", "c").alias("b")]
    pairs = shared.select("doc_id", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("c")).where("doc_id <> c").select(*ordered).distinct()
    pairs = materialize(pairs, "pairs")
    # the only texts that are compared from here on; their ids grow with the data, so they are not broadcast
    held = base.join(shared.select("doc_id").distinct().hint("merge"), "doc_id").join(heads, "doc_id")
    held = materialize(held.select("doc_id", "n_shingles", "regs", "text"), "texts")
    links = materialize(_alike(pairs, held, size, percent), "links")
    parts = materialize(graph.components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")

    rest = _across(shared, parts, held, size, percent).join(pairs, ["a", "b"], "left_anti")
    more = materialize(_alike(materialize(rest, "pairs"), held, size, percent), "links")
    if not more.isEmpty():
        every = links.union(more)
        parts = materialize(graph.components(every.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")

    named = classes.join(parts.withColumnRenamed("node", "head"), "head", "left")
    named = named.select("k1", "k2", F.coalesce("component", "head").alias("class_component"))
    out = common.split_join(drawn.select("doc_id", "n_shingles", "k1", "k2"), named, ["k1", "k2"], drawn.count(), classes, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def distinct_documents(docs: DataFrame, size: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that are a near copy of a document with a smaller id.

    Rows with a null id stay, and rows that share an id stay or go together.
    """
    gone = near_duplicates(docs, size, percent, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
