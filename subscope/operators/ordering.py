"""Global order without a single-task window.

A window with no partition key runs in one task. The functions here cut the ordering
into ranges instead, as a range partitioner does: bounds come from a hash sample of fixed
expected size, each row finds its range by binary search, rows are ordered inside their
range, and the range totals supply the offsets. Bounds are fixed values in the plan, so a
retried task sees the same ranges; and because keys are unique, a value shared by a third
of the rows is spread over many ranges by the id that follows it.

What reaches the driver is bounded by parameters, never by the data: ``parts - 1`` bounds,
one total per (group, range), one key per requested rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subscope.session import materialize, parallelism

SAMPLE_PER_RANGE = 32


def with_range(
    df: DataFrame, keys: Sequence[str], parts: int | None = None, rows: int | None = None
) -> DataFrame:
    """Add ``_range``: 0-based index of the key range of each row, in key order.

    The rows must be unique on ``keys``. ``rows`` is their number, where the caller knows it.
    """
    spark = df.sparkSession
    parts = parts or parallelism(spark)
    key = F.struct(*keys)
    step = max(1, (df.count() if rows is None else rows) // (parts * SAMPLE_PER_RANGE))
    bounds = (
        df.where(F.pmod(F.xxhash64(*keys), F.lit(step)) == 0)
        .agg(F.sort_array(F.collect_list(key)).alias("s"))
        .select(
            F.filter(
                F.transform(
                    F.sequence(F.lit(1), F.lit(parts - 1)),
                    lambda i: F.get("s", F.floor(i * F.size("s") / parts).cast("int")),
                ),
                lambda b: b.isNotNull(),
            ).alias("b")
        )
    )
    fixed = spark.createDataFrame(bounds.toArrow(), bounds.schema)
    # binary search, one projection per halving so that every step stays in generated code
    at = F.lit(0)
    out = df.withColumn("_bounds", fixed.scalar())
    for stride in (1 << p for p in reversed(range((parts - 1).bit_length()))):
        ahead = at + stride
        past = (ahead <= parts - 1) & (F.get("_bounds", ahead - 1) < key)
        out = out.withColumn("_range", F.when(past, ahead).otherwise(at))
        at = F.col("_range")
    return out.drop("_bounds")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Inclusive running sums in ``keys`` order, restarted for every value of ``by``.

    ``df`` must be unique on ``by + keys``. A group of any size is spread over ranges; the
    offsets are one row per (group, range) and stay distributed. The input is read by
    several passes, so it is written once first.
    """
    by = list(by)
    ranged = with_range(materialize(df, "ordered"), [*by, *keys], parts)
    inside = (
        Window.partitionBy(*by, "_range")
        .orderBy(*keys)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"_in_{o}") for o, c in sums.items()])
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(o) for o, c in sums.items()])
    offsets = totals.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(o).over(before), F.lit(0)).alias(f"_off_{o}") for o in sums],
    )
    if not by:
        offsets = F.broadcast(offsets)  # at most `parts` rows
    return local.join(offsets, [*by, "_range"]).select(
        *df.columns, *[(F.col(f"_off_{o}") + F.col(f"_in_{o}")).alias(o) for o in sums]
    )


def global_rank(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """1-based position in ascending ``keys`` order; ``df`` must be unique on ``keys``."""
    return running_sums(df, keys, {out: F.lit(1).cast("bigint")})


class Picked(NamedTuple):
    """Row count of a group and its (value, id) keys at the wanted ranks."""

    rows: int
    keys: list[tuple]


def select_ranks(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Callable[[str, int], Sequence[int]],
    id_col: str = "customer_id",
    parts: int | None = None,
) -> dict[str, Picked]:
    """The keys at given ranks of each value's ascending (value, id) order, nulls left out.

    ``ranks(name, n)`` lists the wanted 1-based ranks of a value with ``n`` rows. All values
    share each pass. Nothing is ranked in full: ranges are counted, and only the rows of the
    few ranges that hold a wanted rank are ordered.
    """
    cells = [F.struct(F.lit(g).alias("_g"), v.alias("_v")) for g, v in values.items()]
    long = (
        df.select(F.col(id_col).alias("_id"), F.inline(F.array(*cells)))
        .where(F.col("_v").isNotNull())
        .select("_g", "_v", "_id")
    )
    # the row count of a stored table comes from its file footers
    return select_long(long, list(values), ranks, parts, df.count() * len(values))


def select_long(
    long: DataFrame,
    groups: Sequence[str],
    ranks: Callable[[str, int], Sequence[int]],
    parts: int | None = None,
    rows: int | None = None,
) -> dict[str, Picked]:
    """``select_ranks`` over rows (_g, _v, _id) of the listed groups, whatever made them; ``long`` is read several times."""
    spark = long.sparkSession
    ranged = with_range(long, ["_g", "_v", "_id"], parts, rows)
    counts: dict[str, list[tuple[int, int]]] = {g: [] for g in groups}
    for g, r, c in ranged.groupBy("_g", "_range").count().collect():
        counts[g].append((r, c))
    totals = {g: sum(c for _, c in rs) for g, rs in counts.items()}
    asked = {g: list(ranks(g, n)) if n else [] for g, n in totals.items()}
    wanted = []
    for g, rs in counts.items():
        offset = 0
        for r, c in sorted(rs):
            wanted += [(g, r, t - offset, t) for t in set(asked[g]) if offset < t <= offset + c]
            offset += c
    found: dict[tuple[str, int], tuple] = {}
    if wanted:
        columns = dict(zip(("_g", "_range", "_place", "_rank"), zip(*wanted)))
        place = spark.createDataFrame(pa.table(columns))
        held = F.broadcast(place.select("_g", F.col("_range").cast("int")).distinct())  # one row per wanted rank
        in_range = Window.partitionBy("_g", "_range").orderBy("_v", "_id")
        placed = ranged.join(held, ["_g", "_range"]).select(
            "*", F.row_number().over(in_range).alias("_place")
        )
        rows = placed.join(F.broadcast(place), ["_g", "_range", "_place"])
        found = {(x._g, x._rank): (x._v, x._id) for x in rows.collect()}
    return {g: Picked(totals[g], [found[g, t] for t in asked[g]]) for g in groups}


def cut_ranks(n: int, q: int) -> list[int]:
    """Ranks of the last members of the first q-1 of q quantile bins of n rows.

    Bins are cut at the linearly interpolated quantiles of the ranks 1..n: row r belongs to
    bin max(1, ceil((r-1)*q/(n-1))), which is not what ``ntile`` computes.
    """
    return [1 + (b * (n - 1)) // q for b in range(1, q)]


def bin_of(cuts: Sequence[tuple], value: Column, id_col: Column) -> Column:
    """1-based bin of a row: one more than the number of cut keys below its own key."""
    out = F.lit(1)
    for v, i in cuts:
        above = (value > F.lit(v)) | ((value == F.lit(v)) & (id_col > F.lit(i)))
        out = out + F.when(above, 1).otherwise(0)
    return out


def quantile_bins(
    df: DataFrame, values: Mapping[str, Column], q: int, id_col: str = "customer_id"
) -> dict[str, Column]:
    """For each named value the column of its q-quantile bin, ties in id order."""
    as_double = {name: v.cast("double") for name, v in values.items()}
    picked = select_ranks(df, as_double, lambda _, n: cut_ranks(n, q), id_col)
    return {name: bin_of(picked[name].keys, v, F.col(id_col)) for name, v in as_double.items()}


def pair_ranks(n: int, ps: Sequence[float]) -> list[int]:
    """The two ranks on either side of each quantile of n rows."""
    return [1 + r for p in ps for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]


def interpolate(picked: Picked, ps: Sequence[float]) -> dict[float, float | None]:
    """Quantiles from the keys at ``pair_ranks``."""
    if not picked.rows:
        return dict.fromkeys(ps)
    out = {}
    for i, p in enumerate(ps):
        (lo, _), (hi, _) = picked.keys[2 * i : 2 * i + 2]
        at = p * (picked.rows - 1)
        out[p] = lo + (hi - lo) * (at - math.floor(at))
    return out


def quantiles(
    df: DataFrame,
    spec: Mapping[str, Sequence[float]],
    id_col: str = "customer_id",
    exact: bool = True,
) -> dict[str, dict[float, float | None]]:
    """Quantiles of each column, linearly interpolated, nulls left out.

    Exact by rank selection, so no value map is held in memory; ``exact=False`` uses the
    mergeable sketch of ``percentile_approx``.
    """
    if not exact:
        row = df.agg(
            *[F.percentile_approx(c, [float(p) for p in ps], 10000) for c, ps in spec.items()]
        ).first()
        return {
            c: {p: None if row[i] is None else float(row[i][j]) for j, p in enumerate(ps)}
            for i, (c, ps) in enumerate(spec.items())
        }
    picked = select_ranks(
        df,
        {c: F.col(c).cast("double") for c in spec},
        lambda c, n: pair_ranks(n, spec[c]),
        id_col,
    )
    return {c: interpolate(picked[c], ps) for c, ps in spec.items()}
