"""Feature vectors and deterministic row splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.operators.ordering import bin_of, select_ranks
from subscope.session import materialize
from subscope.sources.contracts import require_columns

ROWS_PER_TASK = 20_000
ROWS_AT_ONCE = 3_000_000  # of all fits that run side by side


def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def feature_vector(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Add the dense numeric feature vector; a missing column or a null value is an error."""
    require_columns(df, features)
    return assembler(features, out).transform(df)


def training_rows(df: DataFrame, name: str, rows_per_task: int = ROWS_PER_TASK, even: bool = False) -> DataFrame:
    """``df`` as a table of equal parts, read in no more tasks than its rows need and than there are cores.

    Trees are fitted by a job for every level. Over a small table such a job takes as long as its tasks take to be
    scheduled. Over a large one each task sends the statistics of all nodes, so more tasks than cores add traffic only,
    and the job lasts as long as its largest part. ``df`` is counted first and should be cheap to read; where its parts are
    ``even`` already, they are written as they are.
    """
    tasks = _tasks(df, rows_per_task)
    return materialize(df if even else df.repartition(tasks), name).coalesce(tasks)


def _tasks(df: DataFrame, rows_per_task: int) -> int:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, math.ceil(df.count() / rows_per_task)))


def training_vectors(
    df: DataFrame, features: Sequence[str], columns: Sequence[Column | str], name: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``features`` as a vector beside ``columns``, assembled and stored once for all passes of a fit.

    A ``df`` that holds the vector comes from here: several fits share one table of it, which is read as it lies.
    """
    if "features" in df.columns:
        rows = df.select("features", *columns)
        return rows.coalesce(_tasks(rows, rows_per_task))
    return training_rows(assembler(features).transform(df).select("features", *columns), name, rows_per_task)


def fits_at_once(rows: DataFrame, most: int = 8) -> int:
    """How many fits over a stored table run side by side: each keeps a copy of its rows in memory between its passes.

    Few rows leave cores idle unless several fits share them; many keep all cores busy in one fit, and copies that do not
    fit are read back from disk at every pass.
    """
    return max(1, min(most, ROWS_AT_ONCE // max(1, rows.count())))


def mark_split(
    df: DataFrame, label: str, fraction: float = K.TEST_FRACTION, seed: int = K.SEED,
    id_col: str = "customer_id",
) -> DataFrame:
    """Add ``is_test``: a fixed share of every class, chosen by id hash.

    The share is exact per class, the same on every run and for every partitioning. Only the
    hash at the cut is looked up, the classes are never sorted in full.
    """
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    classes = [0, 1]
    cuts = select_ranks(
        df,
        {str(c): F.when(F.col(label) == c, digest) for c in classes},
        lambda _, n: [k for k in [int(n * fraction + 0.5)] if k > 0],
        id_col,
    )
    is_test: Column = F.lit(False)
    for c in classes:
        for cut in cuts[str(c)].keys:
            inside = bin_of([cut], digest, F.col(id_col)) == 1
            is_test = F.when(F.col(label) == c, inside).otherwise(is_test)
    return df.withColumn("is_test", is_test)


def stratified_split(
    df: DataFrame, label: str, fraction: float = K.TEST_FRACTION, seed: int = K.SEED,
    id_col: str = "customer_id",
) -> tuple[DataFrame, DataFrame]:
    marked = mark_split(df, label, fraction, seed, id_col)
    return marked.where("not is_test").drop("is_test"), marked.where("is_test").drop("is_test")


def contiguous_folds(df: DataFrame, folds: int = K.FOLDS, id_col: str = "customer_id") -> DataFrame:
    """Add ``fold``: equal contiguous blocks in id order, the first ones one row larger."""

    def ends(_: str, n: int) -> list[int]:
        size, extra = divmod(n, folds)
        return [r for f in range(1, folds) if (r := size * f + min(f, extra)) > 0]

    key = F.col(id_col)
    cuts = select_ranks(df, {"id": key}, ends, id_col)["id"].keys
    return df.withColumn("fold", bin_of(cuts, key, key) - 1)


def class_weights(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")
    ).first()
    return row.neg, row.pos


def fit_pipeline(df: DataFrame, *stages) -> PipelineModel:
    return Pipeline(stages=list(stages)).fit(df)
