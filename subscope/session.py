"""Where intermediate tables go, and how a plan is cut."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from threading import RLock
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

ROWS_PER_PARTITION = 500_000  # of a shuffle
SMALL_TASKS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "8m"}
_setting = RLock()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, and only where nothing is configured, is a temporary folder made and set: on a
    cluster executors would not see one another's files, so there the setting is required.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="subscope-")
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder, grouped by application for later clean-up."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark).rstrip('/')}/subscope/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet and return a scan of it.

    Used where a per-customer result feeds several passes: the raw log is then read once,
    a lost executor re-reads the table instead of recomputing it, and later plans still
    get column pruning, filter pushdown and size statistics, which an RDD checkpoint has not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_tasks(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """Within, tasks read little enough to hold a hash table of all their rows, however large the whole is.

    Sums with nearly as many groups as rows take ten to twenty times the size their rows have in a file or a shuffle; at
    Spark's 64 and 128 MB a task they spill. ``rows`` is the number of rows that are shuffled, where the caller knows it.
    """
    wanted = dict(SMALL_TASKS)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted["spark.sql.shuffle.partitions"] = str(max(partitions, math.ceil(rows / ROWS_PER_PARTITION)))
    with _setting:
        before = {key: spark.conf.get(key) for key in wanted}
        try:
            for key, value in wanted.items():
                spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)


def bucketed(df: DataFrame, name: str, key: str, rows: int) -> DataFrame:
    """``materialize`` in one bucket of ``key`` for every ``ROWS_PER_PARTITION`` of the ``rows`` shuffled at most.

    Sums by ``key`` and any further columns then need no shuffle. The table is registered under a name of its own, as
    Spark knows buckets from its catalog only; its files lie with the others.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_PARTITION))
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def parallelism(spark: SparkSession) -> int:
    """How many ranges a global ordering is cut into: as many as a shuffle has partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def side_by_side(tasks: Sequence[Callable[[], T]], limit: int = 8) -> list[T]:
    """The results of independent driver functions, such as fits over one stored table, whose jobs then share the executors."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPool(max(1, min(limit, len(tasks)))) as pool:
        return pool.map(lambda task: task(), [inherit(task) for task in tasks], chunksize=1)
