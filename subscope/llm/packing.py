"""Best-fit packing by exact-complement hashing of piece lengths.

Lengths are at most the capacity, so their histogram, and the plan made from it, is bounded
whatever the number of documents. The plan is made on the driver from counts per length; which
document fills which slot follows from its rank among the pieces of its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import common, encoding

CAPACITY = 2048
END_ID = 0


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text_col: str = "text", batch_bytes: int = 2 * common.BATCH_BYTES
) -> DataFrame:
    """Encoded documents with the end id, cut only where they exceed the capacity.

    (doc_id, piece, start, length, ids_crc32). A null text is empty and gives one piece of the
    end id alone; a null doc_id stays null; repeated rows give repeated pieces. Texts are encoded in batches of about
    ``batch_bytes``, which a worker holds several times over; the pieces do not depend on it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(tokenizer)
        for batch in common.gathered(batches, limit=batch_bytes):
            ids, starts = enc.encode(batch.column(1))
            rows, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                doc = np.append(ids[starts[i] : starts[i + 1]], np.uint32(END_ID)).astype("<u4")
                for k, at in enumerate(range(0, len(doc), capacity)):
                    part = doc[at : at + capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield common.batch_of(
                doc_id=batch.column(0).take(pa.array(rows, pa.int64())),
                piece=pa.array(piece, pa.int32()),
                start=pa.array(start, pa.int64()),
                length=pa.array(length, pa.int64()),
                ids_crc32=pa.array(crc, pa.int64()),
            )

    return common.texts(docs, text_col).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, number of such sequences)] that uses up ``counts``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    found: list[tuple[tuple[int, ...], int]] = []

    def take(combination: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for x in combination:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                left[x] -= k * times
            found.append((combination, times))

    take((capacity,))
    for a in range(capacity - 1, (capacity - 1) // 2, -1):  # pairs that fill a sequence exactly
        if left[a] and left[capacity - a]:
            take((a, capacity - a))
    for a in range(capacity - 2, (capacity - 1) // 3, -1):  # a piece and the sum of two smaller ones
        gap = capacity - a
        b = np.arange(min(a, gap - 1), (gap - 1) // 2, -1)
        for x in b[(left[b] > 0) & (left[gap - b] > 0)].tolist():
            if not left[a]:
                break
            take((a, x, gap - x))

    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # gap -> unfinished sequences
    has = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):  # best fit of what is left, longest first
        n = int(left[length])
        while n:
            fit = np.flatnonzero(has[length:])
            if len(fit):
                gap = int(fit[0]) + length
                made, count = open_[gap].pop()
                if count > n:
                    open_[gap].append((made, count - n))
                    count = n
                if not open_[gap]:
                    has[gap] = False
                n -= count
            else:
                per = capacity // length
                count, made = (n // per, (length,) * (per - 1)) if n >= per else (1, (length,) * (n - 1))
                n -= count * (len(made) + 1)
                gap = capacity - length * len(made)
            rest = gap - length
            open_.setdefault(rest, []).append(((*made, length), count))
            has[rest] = rest > 0
    for group in open_.values():
        found += group
    return found


def _slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For ranges of ranks within a length: the first sequence and the place in it."""
    used = np.zeros(capacity + 1, dtype=np.int64)
    key, sequence, offset, base = [], [], [], 0
    for combination, times in patterns:
        at = 0
        for length in combination:
            key.append((length << 48) + int(used[length]))
            sequence.append(base - int(used[length]))
            offset.append(at)
            used[length] += times
            at += length
        base += times
    order = np.argsort(np.array(key, dtype=np.int64), kind="stable")
    return {k: np.array(v, dtype=np.int64)[order] for k, v in (("key", key), ("sequence", sequence), ("offset", offset))}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a stored table of pieces) with sequence_id and offset.

    Pieces are ranked within their length from counts per (length, hash bucket) and an
    order inside the buckets; buckets grow with the root of the commonest length, so neither
    the buckets nor the list of them gathers a hot length in one task. No pieces, no rows.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan(counts, capacity), capacity)
    buckets = math.isqrt(max(counts.values(), default=1)) + 1
    bucketed = cut.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = bucketed.withColumn("__r", F.row_number().over(inside)).join(sizes, ["length", "__b"])
    ranked = ranked.select(*[c for c in cut.columns], (F.col("before") + F.col("__r") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            at = np.searchsorted(slots["key"], (length << 48) + rank, side="right") - 1
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "rank"}
            yield common.batch_of(**columns, sequence_id=slots["sequence"][at] + rank, offset=slots["offset"][at])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def best_fit(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, text_col: str = "text", batch_bytes: int = 2 * common.BATCH_BYTES
) -> DataFrame:
    """Pieces of all documents, each with its sequence and its place there."""
    cut = materialize(pieces(docs, tokenizer or encoding.vocabulary(), capacity, text_col, batch_bytes), "pieces")
    return pack(cut, capacity)
