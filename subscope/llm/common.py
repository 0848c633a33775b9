"""Helpers shared by the operators: Arrow batches, hashing, column contracts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parallelism

BATCH_BYTES = 2_500_000  # text handled by one vectorised step inside a task
BATCH_ROWS = 1_000  # rows that a Python worker gets at a time
PARTS = 4  # a key is hot from a PARTS-th of an even task on


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, text_col: str = "text", *, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) only, a null text as the empty one; other columns, whatever their names, go."""
    small_batches(docs.sparkSession)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def split_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, counted: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, with hot keys of ``left`` dealt over as many tasks as they need.

    ``counted`` has the keys and ``n``, how many of the ``rows`` rows of ``left`` hold them. The hot keys are broadcast: each holds
    more than a PARTS-th of an even task, so there are fewer than PARTS times the shuffle partitions. Their rows of ``right`` are
    copied once for each such part. ``how`` is inner or left.
    """
    limit = max(1, rows // (PARTS * parallelism(left.sparkSession)))
    hot = F.broadcast(counted.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).alias("__salts")))
    none = F.lit(0).cast("long")
    salt = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__salts")), none)
    dealt = left.join(hot, keys, "left").withColumn("__salt", salt).drop("__salts")
    copies = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(none, F.coalesce(F.col("__salts") - 1, none)))).drop("__salts")
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


def small_batches(spark: SparkSession) -> None:
    """Documents are long: lower the session's Arrow batch size where it is above BATCH_ROWS, so that workers stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes in ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        if batch.schema.types[at] != pa.large_string():  # 64-bit offsets: no limit on what a batch derives
            columns = batch.columns
            columns[at] = columns[at].cast(pa.large_string())
            batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        col = batch.column(at)
        ends = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 * BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches, each of about ``limit`` bytes in ``column``: for steps that work per distinct word."""
    held, size = [], 0
    for batch in bounded(batches, column, limit):
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= 0.8 * limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def raw(col: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of a large_string column without nulls, and the start of each row in them plus the end."""
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return b"", np.zeros(len(col) + 1, dtype=np.int64)
    return data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes(), ends - ends[0]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A 2-d array as one binary value a row."""
    n, width = len(rows), rows.shape[1] * rows.dtype.itemsize if rows.ndim == 2 else 0
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def ragged_binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Slices of a 1-d array as binary values."""
    offsets = (starts * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
