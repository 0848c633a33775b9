"""Exact length histogram: token totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import common, encoding

BLOCK = 256  # lengths whose running sums one window holds


def lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(length, documents): how many documents have each encoded length; a null text is empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(tokenizer)
        for batch in common.gathered(batches):
            _, starts = enc.encode(batch.column(0))
            length, documents = np.unique(np.diff(starts), return_counts=True)
            yield common.batch_of(length=length.astype(np.int64), documents=documents.astype(np.int64))

    counted = common.texts(docs.withColumn("__id", F.lit(0)), text_col, id_col="__id").select("text").mapInArrow(count, "length long, documents long")
    # stored, as the suffix sums read it twice: texts are encoded once
    return materialize(counted.groupBy("length").agg(F.sum("documents").alias("documents")), "lengths")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row per occurring length, with what every longer document adds.

    ``documents_ge`` / ``tokens_ge``: documents of at least this length and their tokens;
    ``kept_tokens``: tokens left if every document is truncated to this length;
    ``share_le``: share of documents of at most this length. Sums run within blocks of
    lengths, on top of block totals, so no window holds the whole histogram. An empty
    table gives no rows.
    """
    h = histogram.select("length", "documents", (F.col("length") * F.col("documents")).alias("tokens"), F.expr(f"length div {BLOCK}").alias("block"))
    block = h.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    every = Window.orderBy(F.col("block").desc())
    above = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    block = block.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(whole).alias("d_all"),
        F.sum("t").over(whole).alias("t_all"),
    )
    down = Window.partitionBy("block").orderBy(F.col("length").desc())
    joined = h.join(block, "block").select(
        "length", "documents", "tokens", "d_all", "t_all",
        (F.sum("documents").over(down) + F.col("d_above")).alias("documents_ge"),
        (F.sum("tokens").over(down) + F.col("t_above")).alias("tokens_ge"),
    )
    return joined.select(
        "length", "documents", "tokens", "documents_ge", "tokens_ge",
        (F.col("t_all") - F.col("tokens_ge") + F.col("length") * F.col("documents_ge")).alias("kept_tokens"),
        ((F.col("d_all") - F.col("documents_ge") + F.col("documents")) / F.col("d_all")).alias("share_le"),
    )


def answers(sums: DataFrame, limits: Sequence[int] = (), quantiles: Sequence[float] = ()) -> DataFrame:
    """(kind, at, value) for any context limits and quantiles, from the suffix sums alone.

    ``kept``: tokens kept when truncating to the limit; ``quantile``: the smallest length
    with at least that share of the documents at or below it.
    """
    cols = [F.max("tokens_ge").alias("total"), F.max("length").alias("longest")]
    for i, limit in enumerate(limits):
        longer = F.when(F.col("length") > limit, F.struct("length", "documents_ge", "tokens_ge"))
        cols.append(F.min(longer).alias(f"l{i}"))
    for i, q in enumerate(quantiles):
        cols.append(F.min(F.when(F.col("share_le") >= q, F.col("length"))).alias(f"q{i}"))
    row = sums.agg(*cols)
    parts = [F.struct(F.lit("total").alias("kind"), F.lit(None).cast("double").alias("at"), F.col("total").alias("value"))]
    for i, limit in enumerate(limits):
        kept = F.col("total") - F.coalesce(F.col(f"l{i}.tokens_ge"), F.lit(0)) + limit * F.coalesce(F.col(f"l{i}.documents_ge"), F.lit(0))
        parts.append(F.struct(F.lit("kept").alias("kind"), F.lit(float(limit)).alias("at"), kept.alias("value")))
    for i, q in enumerate(quantiles):
        parts.append(F.struct(F.lit("quantile").alias("kind"), F.lit(float(q)).alias("at"), F.col(f"q{i}").alias("value")))
    return row.select(F.inline(F.array(*parts)))
