"""How far the wording of the sources of a language lies apart.

Terms are counted once per (language, source, term). A source's share of a term depends on its count there alone, and the
difference to the language's share on the pair (count there, count in the language). Terms are therefore grouped by that
cell; the difference is worked out per cell, cells are ranked by how many terms stand before them, and only the cells
that reach the wanted ranks are expanded to terms. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import common

LEAST_DOCS = 30  # documents of a language that a term must occur in
TOP = 50  # ranks of terms that are reported for each source
UNIT = 1_000_000_000  # shares are given in parts of this
ADDED = 5  # added to each count
ENTRIES = 500_000  # counts that a task holds before it passes them on
TERMS = 4096  # terms of a block of the comparison between sources, on average
SOURCES = 256  # sources of one side of such a block, on average
# ASCII letters in lower case and all bytes of longer characters stay, every other byte separates terms
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _flush(seen: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a group, and one without a term for the group itself."""
    for (lang, source), (n, docs) in seen.items():
        rows = len(n) + 1
        yield common.batch_of(
            lang=pa.array([lang] * rows), source=pa.array([source] * rows), term=pa.array([*n, None], pa.binary()).cast(pa.string()),
            n=pa.array([*n.values(), 0], pa.int64()), docs=pa.array([*(docs[t] for t in n), 0], pa.int64()),
        )
    seen.clear()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, to be added up over the rows of a key; term null for the group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in common.bounded(batches):
            langs, sources = (batch.column(c).to_pylist() for c in (0, 1))
            for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.large_binary()).to_pylist()):
                terms = text.translate(_LETTERS).split()
                n, d = seen.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                d.update(set(terms))
            if sum(len(n) for n, _ in seen.values()) > ENTRIES:
                yield from _flush(seen)
        yield from _flush(seen)

    common.small_batches(docs.sparkSession)
    names = {"lang": lang_col, "source": source_col, "text": text_col}
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for n, c in names.items()])
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, total, leads): counts of the terms that enough documents of a language hold, its total there,
    and whether this is the term's first source; and a row without a term for every group.

    One shuffle: rows are dealt by (lang, term), and the sums for a source are taken where the sums for the language are.
    """
    here = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    wide = here.select("*", F.sum("n").over(w).alias("total"), F.sum("docs").over(w).alias("held"), F.min("source").over(w).alias("lead"))
    kept = wide.where(F.col("term").isNull() | (F.col("held") >= least_docs))
    return kept.select("lang", "source", "term", "n", "total", (F.col("source") == F.col("lead")).alias("leads"))


def _share(n: str, size: str) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (size + ADDED * terms)), with decimals wide enough for any count."""
    return F.expr(f"1 + cast({UNIT} AS decimal(20, 0)) * ({n} + {ADDED}) div ({size} + {ADDED} * terms)")


def _groups(kept: DataFrame) -> DataFrame:
    """(lang, source, size, whole, terms, sources): the sums that shares need, for every group."""
    terms = kept.where("term is not null")
    sizes = terms.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("whole"), F.count_if("leads").alias("terms"))
    groups = kept.where("term is null").select("lang", "source")
    number = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    wide = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").join(number, "lang")
    return wide.na.fill(0, ["size", "whole", "terms"])


def top_terms(terms: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """The terms that a source uses more than its language does, to rank ``top``, by the difference of the shares."""
    key = ["lang", "source"]
    cells = terms.groupBy(*key, "n", "total").agg(F.count(F.lit(1)).alias("m")).join(groups, key)
    cells = cells.withColumn("value", _share("n", "size") - _share("total", "whole")).where("value > 0")
    values = cells.groupBy(*key, "value").agg(F.sum("m").alias("m"))
    down = Window.partitionBy(*key).orderBy(F.col("value").desc())
    upto = F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = values.select("*", upto.alias("upto"), F.row_number().over(down).alias("at")).where(F.col("at") <= top)
    reached = reached.where(F.col("upto") - F.col("m") < top).select(*key, "value")
    chosen = cells.join(reached, [*key, "value"]).select(*key, "n", "total", "value")
    ranked = Window.partitionBy(*key).orderBy(F.col("value").desc(), "term")
    items = terms.join(chosen, [*key, "n", "total"]).select(*key, "term", "value", F.row_number().over(ranked).alias("rank"))
    return items.where(F.col("rank") <= top).select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def source_gaps(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """The distance of each source to each other one of its language: differences of shares, summed over all kept terms.

    Blocks of terms, and of sources where there are many, are compared as matrices; a block's size is bounded whatever the
    size of a source. Their partial sums are added up.
    """
    key = ["lang", "source"]
    parts = lambda column, size: F.greatest(F.lit(1), F.ceil(F.col(column) / size)).cast("long")
    tile = F.pmod(F.xxhash64("source"), parts("sources", SOURCES)).alias("tile")
    other = F.explode(F.sequence(F.lit(0).cast("long"), parts("sources", SOURCES) - 1)).alias("other")
    tiles = groups.select("*", tile).select("*", other).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})
    blocks = parts("terms", TERMS)
    base = F.when(F.col("terms") > 0, _share("0L", "size")).otherwise(F.lit(0)).alias("base")
    sides = tiles.select(*[F.col(c).alias(c) for c in ("lang", "i", "j")], F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "source", "tile", "terms", base)
    rows = terms.join(tiles, key).select("lang", "i", "j", F.pmod(F.xxhash64("term"), blocks).alias("block"), "source", "term", _share("n", "size").alias("p"))

    def compare(at: tuple, cells: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        side = side.sort_values("source", kind="stable").reset_index(drop=True)
        term, names = pd.factorize(cells["term"])
        share = np.repeat(side["base"].to_numpy(np.int64)[:, None], len(names), axis=1)
        share[pd.Index(side["source"]).get_indexer(cells["source"]), term] = cells["p"].to_numpy(np.int64)
        a, b = (np.flatnonzero(side["tile"] == t) for t in (at[1], at[2]))
        pairs = [(x, b[b > x] if at[1] == at[2] else b) for x in a]
        value = np.concatenate([np.zeros(0, np.int64), *(np.abs(share[y] - share[x]).sum(axis=1) for x, y in pairs)])
        name = side["source"].to_numpy(object)
        source = np.repeat(name[a], [len(y) for _, y in pairs])
        item = np.concatenate([name[:0], *(name[y] for _, y in pairs)])
        apart = side["base"].to_numpy(np.int64)
        apart = np.concatenate([np.zeros(0, np.int64), *(np.abs(apart[y] - apart[x]) for x, y in pairs)])
        return pd.DataFrame({"lang": np.full(len(value), at[0], object), "source": source, "item": item, "value": value,
                             "seen": len(names), "apart": apart, "terms": side["terms"].max()})

    at = ["lang", "i", "j", "block"]
    partial = rows.groupBy(*at).cogroup(sides.groupBy(*at)).applyInPandas(
        compare, "lang string, source string, item string, value long, seen long, apart long, terms long"
    )
    # kept terms that neither side holds, and no block has seen, differ by the shares of the count 0
    value = F.sum("value") + (F.max("terms") - F.sum("seen")) * F.max("apart")
    once = partial.groupBy(*key, "item").agg(value.alias("value"))
    both = once.select(F.inline(F.array(F.struct("lang", "source", "item", "value"), F.struct("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))))
    w = Window.partitionBy(*key).orderBy(F.col("value").desc(), "item")
    return both.select(*key, F.lit("pair").alias("part"), "item", "value", F.row_number().over(w).alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source its distance to the others ('pair') and its own terms ('term').

    Null text, lang and source count as empty. Every row is a document, repeated ones too. A source without terms has pairs;
    a language without kept terms has pairs of value 0 and no terms; a language's only source has no pairs. No rows, no result.
    Equal values go by the item's UTF-8 bytes.
    """
    kept = materialize(kept_terms(term_counts(docs, text_col, lang_col, source_col), least_docs), "terms")
    terms, groups = kept.where("term is not null"), materialize(_groups(kept), "groups")
    return source_gaps(terms, groups).unionByName(top_terms(terms, groups, top))
