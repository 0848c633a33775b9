"""Exact search for the largest inner products of whole-number vectors, by branch and bound in ball trees.

Vectors are dealt to shards of bounded size. The task of a shard builds its ball tree and answers the queries that visit it:
nodes are taken in the order of the largest inner product their ball allows, until it falls below the query's current
k-th score. Shards are visited in rounds, and the k-th score of the shards seen so far is where the next round starts.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, parallelism
from . import common

SCALE = 256  # components count as floor(SCALE * x)
LEAF = 64  # vectors below which a node is not split
MOST = 1 << 21  # components of a shard at most, on average
LEAST = 1 << 17  # components of a shard at least, on average, where there are fewer shards than tasks
SHARE = 8  # the second round goes to one shard in so many
_LONG = 2**63


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): distinct rows with an id and a vector whose components, and their multiples, are finite."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite).distinct()


def whole(lists: pa.ListArray, scale: int, width: int | None = None) -> np.ndarray:
    """Vectors as rows of whole numbers, filled up with zeros to ``width``, or to the longest."""
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * float(scale))
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    near = at < width
    out[np.repeat(np.arange(len(sizes)), sizes)[near], at[near]] = flat[near]
    return out


class Tree:
    """Balls around halves of halves of the vectors; inside a node vectors stay in the order of their ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.spans, self.left, centre, radius, first = [(0, len(ids))], [0], [], [], []
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = float(np.sqrt(np.einsum("ij,ij->i", x, x)).max(initial=0.0))
            for node, (a, b) in enumerate(self.spans):  # grows while it is read
                own = x[order[a:b]]
                centre.append(own.mean(axis=0))
                away = own - centre[-1]
                away = np.sqrt(np.einsum("ij,ij->i", away, away))
                radius.append(away.max())
                first.append(int(ids[order[a]]))
                if b - a <= leaf:
                    continue
                far = own - own[away.argmax()]
                side = np.argsort(own @ far[np.einsum("ij,ij->i", far, far).argmax()], kind="stable")
                middle = (b - a) // 2
                halves = np.sort(side[:middle]), np.sort(side[middle:])
                order[a:b] = order[a:b][np.concatenate(halves)]
                self.left[node] = len(self.spans)
                self.spans += [(a, a + middle), (a + middle, b)]
                self.left += [0, 0]
        self.ids, self.x = ids[order], x[order]
        self.centre, self.radius, self.first = np.array(centre), np.array(radius), first

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node the largest whole number that an inner product in the ball can be, rounding errors included."""
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
            top = np.floor(q @ self.centre.T + norm * self.radius + 1e-9 * norm * self.norm + 1e-6)
        return np.where(np.isnan(top), np.inf, top)

    def scores(self, a: int, b: int, q: np.ndarray, norm: float) -> np.ndarray:
        """Inner products of the vectors in [a, b). Doubles hold them exactly below 2**53; beyond a long they stop at its ends."""
        if norm * self.norm < 2**53:
            return self.x[a:b] @ q
        exact = (sum(int(u) * int(v) for u, v in zip(row, q)) for row in self.x[a:b])
        return np.array([min(max(s, -_LONG), _LONG - 1) for s in exact], dtype=object)

    def best(self, q: np.ndarray, bound: np.ndarray, own: int, least: int | None, k: int) -> list[tuple[int, int]]:
        """(minus score, id) of the k best ids but ``own``, best first; those below ``least`` may be left out."""
        found: list[tuple[int, int]] = []
        edge, norm = (math.inf if least is None else -least, math.inf), float(np.sqrt(q @ q))
        queue = [(-bound[0], self.first[0], 0)]
        while queue and queue[0][:2] <= edge:
            _, _, node = heapq.heappop(queue)
            if child := self.left[node]:
                for c in (child, child + 1):
                    if (-bound[c], self.first[c]) <= edge:
                        heapq.heappush(queue, (-bound[c], self.first[c], c))
                continue
            a, b = self.spans[node]
            scores = self.scores(a, b, q, norm)
            near = np.flatnonzero(scores >= -edge[0])
            for s, i in zip(map(int, scores[near]), self.ids[a:b][near].tolist()):
                if (-s, i) >= edge or i == own:
                    continue
                known = next((f for f in found if f[1] == i), None)  # an id may have several vectors
                if known:
                    if known[0] <= -s:
                        continue
                    found.remove(known)
                insort(found, (-s, i))
                if len(found) >= k:
                    del found[k:]
                    edge = min(edge, found[-1])
        return found


def _visits(shard: Column, count: int, lo: int, hi: int) -> Column:
    """The shards that a query at home in ``shard`` visits as its lo-th to (hi-1)-th."""
    return F.explode(F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda j: F.pmod(shard + j, F.lit(count)).cast("int")))


def _rank(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = SCALE, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(scale * x) of each query with all other ids.

    Exact; ties go to the smaller vec_id. Vectors that are null or hold a null or non-finite component take no part, nor do
    rows without an id; zero vectors do. Repeated rows count once, and of several vectors under one id the best counts, on
    either side. A shorter vector counts as filled up with zeros. Fewer candidates than k give fewer rows; no rows, none.
    Scores beyond a long are set to its ends. ``most`` and ``least`` set the size of a shard, which changes no result.
    """
    common.small_batches(vectors.sparkSession)
    base = materialize(usable(vectors, id_col, vector_col, scale), "vectors")
    asked = materialize(usable(queries, id_col, vector_col, scale), "queries")
    size = base.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    count = max(1, math.ceil(size / most), min(parallelism(base.sparkSession), size // least))
    home = lambda seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(count)).cast("int")
    index = base.select(home(1).alias("shard"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("long").alias("least"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            shards, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]) if batch.num_rows else ():
                part = batch.slice(a, b - a)
                ids, lists = part.column(2).to_numpy(), part.column(3)
                if shards[a] != shard:
                    shard, held, tree = shards[a], [], None
                if not asks[a]:
                    held.append((ids, lists))
                    continue
                if held:  # rows come sorted: the shard's vectors are complete
                    x = whole(pa.concat_arrays([v for _, v in held]), scale)
                    tree, held = Tree(np.concatenate([i for i, _ in held]), x), []
                if tree is None:
                    continue
                q = whole(lists, scale, tree.x.shape[1])
                found = [
                    tree.best(*row, k) for row in zip(q, tree.bounds(q), ids.tolist(), part.column(4).to_pylist())
                ]
                each = [len(f) for f in found]
                yield common.batch_of(
                    query_id=np.repeat(ids, each), vec_id=pa.array([i for f in found for _, i in f], pa.int64()),
                    score=pa.array([-s for f in found for s, _ in f], pa.int64()),
                )

    found, asking = None, asked.withColumn("least", F.lit(None).cast("long"))
    stops = sorted({1, math.ceil(count / SHARE), count})
    for lo, hi in zip([0, *stops], stops):
        visits = asking.select(_visits(home(2), count, lo, hi).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v", "least")
        dealt = index.union(visits).repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "asks", "vec_id")
        seen = dealt.mapInArrow(answer, "query_id long, vec_id long, score long")
        if hi < count:
            seen = materialize(seen, "found")
        found = found.union(seen) if found else seen
        kth = _rank(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        asking = asked.join(kth, "vec_id", "left")
    return _rank(found, k).select("query_id", "rank", "vec_id", "score")
