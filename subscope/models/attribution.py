"""Exact per-row Shapley contributions of a boosted tree model.

Each leaf is a product game over the features on its path: a feature is worth 1 or 0 for a
row that does or does not meet its splits, and the share of training rows that does when
the feature is unknown. The Shapley values of such a game follow from one polynomial, in time
quadratic in the features of the path, and are computed once per pattern of met features that
occurs in an Arrow batch. Contributions add up to the model margin minus its expected value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subscope.session import scratch_path

TABLE_BITS = 6  # a leaf of so many features has 64 patterns at most, whose values a task keeps


class Leaf(NamedTuple):
    """Splits on the way to a leaf, the share of training rows that meets each feature's splits, and its value."""

    features: list[int]  # distinct split features
    splits: list[tuple[int, float, bool]]  # position in `features`, threshold, goes left
    shares: np.ndarray
    value: float


class Explainer(NamedTuple):
    base: float
    leaves: list[Leaf]


def _shapley(met: np.ndarray, shares: np.ndarray, value: float) -> np.ndarray:
    """Shapley values of the product game, one row per row of ``met``.

    The coefficients of prod_j (share_j + met_j t) sum the worth of coalitions by size; dividing one factor out
    leaves those of the other features.
    """
    rows, m = met.shape
    weight = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    by_size = np.zeros((rows, m + 1))
    by_size[:, 0] = 1.0
    for j in range(m):
        by_size[:, 1:] = shares[j] * by_size[:, 1:] + met[:, j : j + 1] * by_size[:, :-1]
        by_size[:, 0] *= shares[j]
    out = np.empty((rows, m))
    for i in range(m):
        without = by_size[:, :m] / shares[i]  # right where the feature is not met
        rest = np.zeros(rows)
        for k in range(m - 1, -1, -1):
            rest = by_size[:, k + 1] - shares[i] * rest
            without[:, k] = np.where(met[:, i], rest, without[:, k])
        out[:, i] = value * (met[:, i] - shares[i]) * (without @ weight)
    return out


def explainer(model: PipelineModel, spark: SparkSession) -> Explainer:
    """Read the trees of the last pipeline stage from its saved node table.

    The node table is the model, not data: its size is set by the number of trees and their depth.
    """
    trees = model.stages[-1]
    path = scratch_path(spark, "trees")
    trees.write().overwrite().save(path)
    nodes: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row.treeID, {})[row.nodeData.id] = row.nodeData
    base, leaves = 0.0, []
    for tree, weight in enumerate(trees.treeWeights):
        table = nodes[tree]
        stack: list[tuple[int, list, float]] = [(0, [], 1.0)]
        while stack:
            at, path_, reach = stack.pop()
            node = table[at]
            if node.leftChild < 0:
                base += weight * node.prediction * reach
                if path_:
                    leaves.append(_leaf(path_, weight * node.prediction))
                continue
            left, right = table[node.leftChild], table[node.rightChild]
            threshold = node.split.leftCategoriesOrThreshold[0]
            total = left.impurityStats[0] + right.impurityStats[0]
            for child, goes_left in ((left, True), (right, False)):
                share = child.impurityStats[0] / total
                step = (node.split.featureIndex, threshold, goes_left, share)
                stack.append((child.id, [*path_, step], reach * share))
    return Explainer(base, leaves)


def _leaf(path: list, value: float) -> Leaf:
    features = sorted({f for f, *_ in path})
    shares = np.array([np.prod([s for f, _, _, s in path if f == g]) for g in features])
    return Leaf(features, [(features.index(f), t, left) for f, t, left, _ in path], shares, value)


def contributions_of(x: np.ndarray, leaves: list[Leaf], tables: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Contribution matrix of a batch.

    ``tables`` keeps the values of all patterns of leaves with few, which are the same in every batch. Features are worked on
    as contiguous columns, and a split is looked at once for the leaves that follow one another below it.
    """
    tables = {} if tables is None else tables
    columns = np.ascontiguousarray(x.T)
    out = np.zeros_like(columns)
    seen: dict[tuple[int, float], np.ndarray] = {}
    for number, leaf in enumerate(leaves):
        m = len(leaf.features)
        keys = [(leaf.features[i], threshold) for i, threshold, _ in leaf.splits]
        seen = {key: seen[key] if key in seen else columns[key[0]] <= key[1] for key in keys}
        met: list[np.ndarray | None] = [None] * m
        for (i, _, left), key in zip(leaf.splits, keys):
            below = seen[key] if left else ~seen[key]
            met[i] = below if met[i] is None else met[i] & below
        pattern = np.zeros(len(x), dtype=np.int64)
        for i, fits in enumerate(met):
            pattern += fits.astype(np.int64) << i
        if m <= TABLE_BITS:
            if number not in tables:
                tables[number] = _shapley((np.arange(1 << m)[:, None] >> np.arange(m)) & 1, leaf.shares, leaf.value).T.copy()
            table, at = tables[number], pattern
        else:  # all patterns where they are few, else those that occur
            found, at = (np.arange(1 << m), pattern) if 1 << m <= len(x) else np.unique(pattern, return_inverse=True)
            table = _shapley((found[:, None] >> np.arange(m)) & 1, leaf.shares, leaf.value).T
        for j, feature in enumerate(leaf.features):
            out[feature] += table[j].take(at)
    return np.ascontiguousarray(out.T)


def attribute(model: PipelineModel, df: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """(id, base_value, contributions) with one array element per model feature, in feature order."""
    found = explainer(model, df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(found)
    rows = model.stages[0].transform(df).select(id_col, vector_to_array("features").alias("x"))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                c = contributions_of(np.array(batch["x"].tolist(), dtype=float), shared.value.leaves, tables)
                yield pd.DataFrame({id_col: batch[id_col], "contributions": list(c)})

    return rows.mapInPandas(run, f"{id_col} {id_type}, contributions array<double>").withColumn(
        "base_value", F.lit(found.base)
    )


def contribution_columns(features: Sequence[str]) -> dict[str, object]:
    """Named columns over the contribution array, as the ranking functions take them."""
    return {f: F.col("contributions")[i] for i, f in enumerate(features)}
