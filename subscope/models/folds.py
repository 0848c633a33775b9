"""Boosted regression of every fold of a cross-validation in the same passes over one table.

The models are those of Spark's boosted trees at squared error: 32 bins, the split of the largest fall in variance, a leaf's
mean, a first tree at full weight. Rows lie in blocks as bin numbers; a task sums up its rows by (model, node, feature, bin), the driver
adds the sums up and picks the splits, whose number is set by folds and depth. A level is one job for all folds; a table of one
part is boosted in that part's task.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope import constants as K

BINS = 32
SAMPLE = 10_000  # training rows of a fold that the bounds of bins are taken from
BLOCK_ROWS = 32_768
CELLS = 512  # of features that are counted together
CHECKPOINT = 50  # trees after which the rows are written out, which cuts their lineage


class Block(NamedTuple):
    """Rows side by side: bin numbers by feature and by group of features, label, fold, and each fold's prediction so far."""

    codes: np.ndarray
    joint: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    found: np.ndarray


class Tree:
    """Nodes as lists; a leaf leads to itself. ``cut`` is the last bin number that goes left."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.value, self.stats = [0], [0], [0], [0], [0.0], [None]

    def add(self, stats: np.ndarray) -> int:
        at = len(self.feature)
        for column, v in zip((self.feature, self.cut, self.left, self.right, self.value), (0, 0, at, at, _mean(stats))):
            column.append(v)
        self.stats.append(stats)
        return at

    def nodes(self, codes: np.ndarray, steps: int) -> np.ndarray:
        """The node of each row after so many steps."""
        feature, cut, left, right = (np.array(c, dtype=np.intp) for c in (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(codes.shape[1], dtype=np.intp), np.arange(codes.shape[1])
        for _ in range(steps):
            at = np.where(codes[feature[at], rows] <= cut[at], left[at], right[at])
        return at


def _mean(stats: np.ndarray) -> float:
    return float(stats[1] / stats[0]) if stats[0] else 0.0


def _variance(stats: np.ndarray) -> np.ndarray:
    """Of (count, sum, sum of squares) on the first axis; 0 without rows."""
    n = np.where(stats[0] == 0, 1.0, stats[0])
    return np.where(stats[0] == 0, 0.0, (stats[2] - stats[1] * stats[1] / n) / n)


def bounds(values: np.ndarray, bins: int) -> np.ndarray:
    """Bounds between the bins of a feature: halfway between all values, or between those nearest to equal shares."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2.0
    if len(between) < bins:
        return between
    stride = len(values) / bins
    below, target, out = np.cumsum(counts).astype(float), stride, []
    for i in range(1, len(distinct)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def _columns(rows: DataFrame, label: str, fold: str) -> DataFrame:
    return rows.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))


def _matrix(x: pa.Array, rows: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class Grid(NamedTuple):
    """Bounds of each feature, those of all folds together; for each fold and feature the own bin of each common one and
    the common number of each own bound; groups of features with few bins, which a large table is counted by.
    """

    common: list[np.ndarray]
    own: list[list[np.ndarray]]
    cuts: list[list[np.ndarray]]
    groups: list[list[int]]

    @classmethod
    def of(cls, rows: DataFrame, folds: int, label: str, fold: str) -> Grid:
        count = rows.count()
        wanted = SAMPLE * folds // max(1, folds - 1)
        sample = rows if count <= wanted else rows.sample(False, wanted / count, K.SEED)
        table = _columns(sample, label, fold).toArrow().combine_chunks()
        x, held = _matrix(table["x"].combine_chunks(), table.num_rows), table["fold"].to_numpy()
        if not np.isfinite(x).all():
            raise ValueError("features must be finite numbers")
        each = []
        for k in range(folds):
            train = x[held != k]
            each.append([bounds(train[:, f] + 0.0, max(1, min(BINS, len(train)))) for f in range(x.shape[1])])
        common = [np.unique(np.concatenate(found)) for found in zip(*each)]
        own = [[np.searchsorted(b, np.append(c, np.inf), "left").astype(np.intp) for b, c in zip(found, common)] for found in each]
        cuts = [[np.searchsorted(c, b) for b, c in zip(found, common)] for found in each]
        alike = [len(c) > 0 and all(len(of[f]) == len(c) for of in each) for f, c in enumerate(common)]
        groups: list[list[int]] = []
        for f in sorted((f for f, same in enumerate(alike) if same and count > wanted), key=lambda f: len(common[f])):
            if groups and math.prod(len(common[g]) + 1 for g in [*groups[-1], f]) <= CELLS:
                groups[-1].append(f)
            else:
                groups.append([f])
        return cls(common, own, cuts, [group for group in groups if len(group) > 1])

    def shape(self, group: list[int]) -> list[int]:
        return [len(self.common[f]) + 1 for f in group]

    def blocks(self, batches: Iterable[pa.RecordBatch], folds: int) -> Iterator[Block]:
        """Rows as bin numbers, in blocks of at most ``BLOCK_ROWS`` and a batch."""
        kind = np.uint8 if max(map(len, self.common), default=0) < 256 else np.uint16

        def block(parts: list[pa.RecordBatch]) -> Block:
            x = np.vstack([_matrix(b.column(0), b.num_rows) for b in parts])
            y, fold = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in (1, 2))
            if not (np.isfinite(x).all() and np.isfinite(y).all()):
                raise ValueError("features and labels must be finite numbers")
            codes = np.array([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.common)], dtype=kind)
            joint = [np.ravel_multi_index(codes[group].astype(np.intp), self.shape(group)) for group in self.groups]
            return Block(codes, np.array(joint, dtype=np.uint16), y, fold, np.zeros((folds, len(y))))

        parts: list[pa.RecordBatch] = []
        for batch in batches:
            parts += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in parts) >= BLOCK_ROWS:
                yield block(parts)
                parts = []
        if parts:
            yield block(parts)


Level = list[tuple[Tree, list[int]]]  # the tree of each fold so far, and its nodes that are being split


def _sums(blocks: Iterable[Block], level: Level, depth: int, first: bool, grid: Grid) -> list[list[np.ndarray]]:
    """For each fold and feature (count, sum, sum of squares) by node and bin of the fold's training rows."""
    total: list[list[np.ndarray]] = []
    grouped = {f for group in grid.groups for f in group}
    for block in blocks:
        here = []
        for k, (tree, open_) in enumerate(level):
            slot = np.full(len(tree.feature), len(open_), dtype=np.intp)
            slot[open_] = np.arange(len(open_))
            at = np.where(block.fold == k, len(open_), slot[tree.nodes(block.codes, depth)])
            r = block.y if first else 2.0 * (block.y - block.found[k])
            square, base = r * r, {}

            def counted(cell: np.ndarray, width: int) -> np.ndarray:
                if width not in base:
                    base[width] = at * width
                cell += base[width]
                sums = [np.bincount(cell, weights, width * (len(open_) + 1)) for weights in (None, r, square)]
                return np.array(sums, dtype=float)[:, : width * len(open_)].reshape(3, len(open_), width)

            none = np.zeros((3, len(open_), 1))
            cells = [
                none if f in grouped or bins[-1] == 0 or not open_ else counted(bins[codes], int(bins[-1]) + 1)
                for f, (codes, bins) in enumerate(zip(block.codes, grid.own[k]))
            ]
            cells += [counted(j.astype(np.intp), math.prod(grid.shape(group))) for j, group in zip(block.joint, grid.groups)]
            here.append(cells)
        total = [[a + b for a, b in zip(x, y)] for x, y in zip(total, here)] if total else here
    for cells in total:
        for sums, group in zip(cells[len(grid.own[0]) :], grid.groups):
            apart = sums.reshape(*sums.shape[:2], *grid.shape(group))
            for axis, f in enumerate(group, 2):
                cells[f] = apart.sum(axis=tuple(i for i in range(2, apart.ndim) if i != axis))
        del cells[len(grid.own[0]) :]
    return total


def _split(tree: Tree, open_: list[int], sums: list[np.ndarray], cuts: list[np.ndarray], last: bool) -> list[int]:
    """Split the open nodes where that lowers the variance; the new nodes to look at, none after the ``last`` level."""
    below = [np.cumsum(s, axis=2) for s in sums]
    wide = [f for f, b in enumerate(below) if b.shape[2] > 1]
    if not wide:
        return []
    opened = []
    left = np.concatenate([below[f][:, :, :-1] for f in wide], axis=2)
    right = np.concatenate([below[f][:, :, -1:] - below[f][:, :, :-1] for f in wide], axis=2)
    places = [(f, i) for f in wide for i in range(below[f].shape[2] - 1)]
    for n, node in enumerate(open_):
        a, b = left[:, n], right[:, n]
        if tree.stats[node] is None:
            tree.stats[node] = a[:, 0] + b[:, 0]
            tree.value[node] = _mean(tree.stats[node])
        gain = _variance(tree.stats[node]) - a[0] / (a[0] + b[0]) * _variance(a) - b[0] / (a[0] + b[0]) * _variance(b)
        gain = np.where((a[0] < 1) | (b[0] < 1) | (gain < 0), -np.inf, gain)
        best = int(np.argmax(gain))
        if not gain[best] > 0:
            continue
        f, i = places[best]
        children = [tree.add(side[:, best].copy()) for side in (a, b)]
        tree.feature[node], tree.cut[node] = f, int(cuts[f][i])
        tree.left[node], tree.right[node] = children
        opened += [c for c in children if not last and abs(_variance(tree.stats[c])) >= np.finfo(float).eps]
    return opened


def _grow(
    summed: Callable[[Level, int], list[list[np.ndarray]]], folds: int, depth: int, cuts: list[list[np.ndarray]]
) -> list[Tree]:
    """The next tree of each fold, level by level from the sums of all rows."""
    level: Level = [(Tree(), [0]) for _ in range(folds)]
    for at in range(depth):
        if at and not any(open_ for _, open_ in level):
            break
        added = summed(level, at)
        level = [(tree, _split(tree, open_, added[k], cuts[k], at + 1 == depth) if open_ else []) for k, (tree, open_) in enumerate(level)]
    return [tree for tree, _ in level]


def _add(block: Block, trees: list[Tree], weight: float, depth: int) -> Block:
    """The block with the trees, one of each fold, in its predictions."""
    found = [old + weight * np.array(t.value)[t.nodes(block.codes, depth)] for old, t in zip(block.found, trees)]
    return block._replace(found=np.array(found))


def _errors(blocks: Iterable[Block], folds: int) -> np.ndarray:
    """(rows, sum, sum of squares, squared error) of each fold's rows by the model of the others."""
    out = np.zeros((folds, 4))
    for block in blocks:
        for k in range(folds):
            y, p = block.y[block.fold == k], block.found[k][block.fold == k]
            out[k] += len(y), y.sum(), (y * y).sum(), ((y - p) ** 2).sum()
    return out


def held_out_r2(rows: DataFrame, folds: int, trees: int, depth: int, step: float, label: str, fold: str = "fold") -> list[float]:
    """R2 of the rows of each fold by boosted trees on the rows of the others; ``rows`` is a stored table with ``features``."""
    sc = rows.sparkSession.sparkContext
    grid = Grid.of(rows, folds, label, fold)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grid.blocks(batches, folds):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(block), 5)], pa.binary())], names=["block"])

    packed = _columns(rows, label, fold).mapInArrow(pack, "block binary").rdd
    before, state = None, packed.map(lambda r: Block(*pickle.loads(r["block"])))

    def alone(blocks: Iterator[Block]) -> list[np.ndarray]:
        held = list(blocks)
        for number in range(trees):
            grown = _grow(lambda level, at, first=number == 0: _sums(held, level, at, first, grid), folds, depth, grid.cuts)
            held = [_add(block, grown, step if number else 1.0, depth) for block in held]
        return [_errors(held, folds)]

    if state.getNumPartitions() == 1:  # few rows, whose sums need no others
        found = state.mapPartitions(alone).collect()
    else:
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        for number in range(trees):

            def summed(level: Level, at: int, first: bool = number == 0) -> list[list[np.ndarray]]:
                nonlocal before
                parts = [p for p in state.mapPartitions(lambda blocks: [_sums(blocks, level, at, first, grid)]).collect() if p]
                if before is not None:  # its successor is stored now
                    before = before.unpersist() and None
                return [[sum(ps[1:], start=ps[0]) for ps in zip(*of)] for of in zip(*parts)]

            grown = _grow(summed, folds, depth, grid.cuts)
            weight = step if number else 1.0
            before, state = state, state.map(partial(_add, trees=grown, weight=weight, depth=depth)).persist(StorageLevel.MEMORY_AND_DISK)
            if number % CHECKPOINT == CHECKPOINT - 1:
                state.checkpoint()
        found = state.mapPartitions(lambda blocks: [_errors(blocks, folds)]).collect()
        for stored in (state, before):
            stored.unpersist()
    n, total, squares, errors = np.sum(found, axis=0).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return [float(r) for r in 1 - errors / (squares - total * total / n)]
