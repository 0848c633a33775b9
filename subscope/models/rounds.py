"""How many rounds of a boosted classifier to keep.

The ranking quality after every round is measured in one pass over held-out rows: a task adds up the trees of its rows and
counts both classes by (round, range of the probability). Boosting would have stopped when the best round was a number of
rounds ago, and the rounds up to that best one are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subscope.session import scratch_path

PATIENCE = 20  # rounds without a better AUC after which boosting ends
RANGES = 4096  # equal ranges of the probability; scores in one range count as tied


class Tree(NamedTuple):
    """Nodes as arrays; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        while True:
            below = x[rows, self.feature[at]] <= self.threshold[at]
            after = np.where(below, self.left[at], self.right[at])
            if np.array_equal(after, at):
                return self.value[at]
            at = after


def read_trees(model: GBTClassificationModel, spark: SparkSession) -> list[Tree]:
    """The trees, weights included, from the saved node table, whose size is set by the number of trees and their depth."""
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    nodes: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row.treeID, {})[row.nodeData.id] = row.nodeData
    trees = []
    for number, weight in enumerate(model.treeWeights):
        table = [nodes[number][i] for i in range(len(nodes[number]))]
        inner = [n.leftChild >= 0 for n in table]
        trees.append(
            Tree(
                np.array([n.split.featureIndex if i else 0 for n, i in zip(table, inner)]),
                np.array([n.split.leftCategoriesOrThreshold[0] if i else 0.0 for n, i in zip(table, inner)]),
                np.array([n.leftChild if i else n.id for n, i in zip(table, inner)]),
                np.array([n.rightChild if i else n.id for n, i in zip(table, inner)]),
                np.array([weight * n.prediction for n in table]),
            )
        )
    return trees


def round_aucs(model: GBTClassificationModel, rows: DataFrame, label: str = "label", ranges: int = RANGES) -> list[float | None]:
    """AUC of the first 1, 2, ... trees over rows (features, label); None where a class is missing.

    Counts are (rounds x ranges) at most, in a task as on the driver's side of the aggregate.
    """
    spark = rows.sparkSession
    trees = read_trees(model, spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(trees), ranges, 2), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            margin = np.zeros(len(x))
            for number, tree in enumerate(trees):
                margin += tree.predict(x)
                p = 1 / (1 + np.exp(-2 * np.clip(margin, -350, 350)))
                cell = np.minimum((p * ranges).astype(np.int64), ranges - 1) * 2 + y
                seen[number] += np.bincount(cell, minlength=2 * ranges).reshape(ranges, 2)
        number, at = np.nonzero(seen.any(axis=2))
        names = ["round", "at", "neg", "pos"]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (number, at, *seen[number, at].T)], names=names)

    x = rows.where(F.col(label).isin(0, 1)).select(vector_to_array("features").alias("x"), F.col(label).cast("int").alias("y"))
    counted = x.mapInArrow(count, "round long, at long, neg long, pos long")
    counted = counted.groupBy("round", "at").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    w = Window.partitionBy("round").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.sum("neg").over(w) - F.col("neg") / 2
    pairs = counted.select("round", "neg", "pos", (F.col("pos") * below).alias("won"))
    auc = F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg").cast("double"))
    found = {r["round"]: r["auc"] for r in pairs.groupBy("round").agg(auc.alias("auc")).collect()}
    return [found.get(i) for i in range(len(trees))]


def best_round(quality: Sequence[float | None], patience: int = PATIENCE) -> int:
    """Rounds to keep: up to the first best one before the first run of ``patience`` rounds without a better one.

    Without any known quality all rounds are kept.
    """
    best, at = None, len(quality)
    for i, q in enumerate(quality, 1):
        if q is not None and (best is None or q > best):
            best, at = q, i
        elif best is not None and i - at >= patience:
            break
    return at


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` trees, which is what a run of so many rounds gives."""
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    trees, weights = java.trees(), list(java.treeWeights())[:rounds]
    kept = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    steps = gateway.new_array(gateway.jvm.double, rounds)
    for i, weight in enumerate(weights):
        kept[i], steps[i] = trees[i], weight
    shorter = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"{model.uid}_{rounds}", kept, steps, model.numFeatures, model.numClasses
    )
    return model._copyValues(GBTClassificationModel(shorter))
