"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Each index block holds one inverted
file per pivot (vectors that rank it, with the place they give it); a query reads the files of
its own pivots, ranks vectors by footrule distance and reranks the nearest share by inner product.
The task of a block receives its vectors once, makes their permutations and files once, and then
answers the queries that are streamed to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import common

PIVOTS = 256  # sampled vectors; the only rows that reach the driver
PREFIX = 48  # nearest pivots kept of each vector
SHARE = 0.35  # part of each block, by footrule, that is reranked
LEAST = 256  # vectors of a block that are reranked at least
BLOCK = 4096  # vectors of an index block on average


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): distinct rows whose vector is not null, empty or zero and has finite components only."""
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good & F.exists("v", lambda x: x != 0))


def pivots(rows: DataFrame, count: int = PIVOTS, seed: int = 7) -> list[tuple[float, ...]]:
    """Distinct sample vectors, chosen by a hash of their ids."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(4 * count).select("v").collect()
    return list(dict.fromkeys(tuple(r["v"]) for r in sample))[:count]


def permutations(vectors: np.ndarray, pivot: np.ndarray, prefix: int) -> np.ndarray:
    """For each row the pivots in order of inner product, nearest first; equally near ones by number."""
    scores = vectors @ pivot.T
    return np.argsort(-scores, axis=1, kind="stable")[:, :prefix].astype(np.int32)


class Files:
    """The inverted files of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, prefix: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.pivot, self.length = ids[order], x[order], pivot, min(prefix, len(pivot))
        flat = permutations(self.x, pivot, self.length).ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[by_pivot], np.arange(len(pivot) + 1))
        self.member, self.place = (by_pivot // self.length).astype(np.int32), (by_pivot % self.length).astype(np.int16)

    def nearest(self, q: np.ndarray, own: np.ndarray, share: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(vector ids, scores) of the best k of the block for each query."""
        n, length = len(self.ids), self.length
        wanted = min(n, max(LEAST, k + 1, int(np.ceil(share * n))))
        for query, near, me in zip(q, permutations(q, self.pivot, length), own):
            # footrule against a pivot that is missing counts as `length`; this is what shared pivots save
            saved = np.zeros(n, dtype=np.int16)
            for i, p in enumerate(near.tolist()):
                at = slice(self.starts[p], self.starts[p + 1])
                saved[self.member[at]] += length - np.abs(self.place[at] - np.int16(i))
            found = np.argsort(-saved, kind="stable")[:wanted]  # ids ascend, so equal ones go by id
            found = np.sort(found[self.ids[found] != me])
            # the same order of additions for each pair: equal vectors get equal scores
            scores = np.einsum("ij,j->i", self.x[found], query)
            best = np.lexsort((self.ids[found], -scores))[:k]
            yield self.ids[found][best], scores[best]


def dense(lists: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` components, filled up with zeros or cut."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out, at = np.zeros((len(sizes), width)), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes)[at < width], at[at < width]] = flat[at < width]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           pivot_count: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among all other ids, by inner product.

    Ties go to the smaller vec_id. Unusable vectors (null, empty, zero, non-finite) take no part on either side,
    nor do rows with a null id; repeated rows count once. A shorter vector counts as filled up with zeros.
    Fewer candidates than k give fewer rows; an empty table gives none.
    """
    common.small_batches(vectors.sparkSession)
    base = materialize(usable(vectors, id_col, vector_col).distinct(), "vectors")
    asked = materialize(usable(queries, id_col, vector_col).distinct(), "queries")
    n, width = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    sample = pivots(base, pivot_count)
    pivot = np.array([[*p, *[0.0] * (width - len(p))] for p in sample], dtype=np.float64).reshape(len(sample), width)
    blocks = max(1, round(n / BLOCK))
    index = base.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    visits = asked.select(every.alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    # a block is one bounded piece of work; its own vectors come first, then the queries
    dealt = index.union(visits).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks", "vec_id")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, files = None, [], None
        for batch in batches:
            which, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = np.flatnonzero((which[1:] != which[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]) if batch.num_rows else ():
                ids, x = batch.column(2).slice(a, b - a).to_numpy(), dense(batch.column(3).slice(a, b - a), width)
                if which[a] != block:
                    block, held, files = which[a], [], None
                if not asks[a]:
                    held.append((ids, x))
                    continue
                if held:
                    files, held = Files(*(np.concatenate(part) for part in zip(*held)), pivot, prefix), []
                if files is None:
                    continue
                found = list(files.nearest(x, ids, share, k))
                vec, score = (np.concatenate(part) for part in zip(*found))
                yield common.batch_of(query_id=np.repeat(ids, [len(f) for f, _ in found]), vec_id=vec, score=score)

    near = dealt.mapInArrow(answer, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
