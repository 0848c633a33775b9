"""Connected components with DataFrame joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import split_join


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of the undirected ``edges``; component is its smallest node.

    Alternating large-star and small-star steps: each links a node's neighbours to the least
    node it knows, so a round halves long paths and ends in one star per component. Minima
    are combined before every shuffle, and the join back to a hot node is dealt over several tasks. Each
    round is a stored table, so a lost executor repeats one round at most. Nulls and loops
    link nothing; an empty table has no components.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    e = materialize(e.where(F.col("u") > F.col("v")).distinct(), "edges")
    state = _state(e)
    if not state[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        star = split_join(both, least.select("u", F.least("u", "m").alias("m")), ["u"], 2 * state[0], least).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = split_join(star, least.select("u", "m"), ["u"], state[0], least)
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen, state = state, _state(e)
        if seen == state:
            break
    heads = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)


def _state(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"] or 0
