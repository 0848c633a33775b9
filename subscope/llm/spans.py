"""What the two span scanners share: base patterns, labelled examples, training rows, digests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common, crf

SAMPLE = 240  # documents with base spans, and as many without, that a model is fitted on
DRAWN = 40  # times that many documents are looked at first
LEFT, RIGHT = "\"'<>[]{},;:|`", "\"'<>[]{},;:|`.!?"


@dataclass(frozen=True)
class Kind:
    """A base pattern. ``maybe`` is a superset that a column can be searched for quickly."""

    name: str
    pattern: str
    maybe: str
    valid: Callable[[re.Match], bool]
    flags: int = 0
    value: int = 0  # the group that is the value itself
    find: Callable[[str], Iterator[re.Match]] | None = None  # the same matches in time linear in the text, where a plain search is not

    def matches(self, text: str) -> Iterator[re.Match]:
        return self.find(text) if self.find else re.finditer(self.pattern, text, self.flags)


def base(kinds: Sequence[Kind], text: str, which: Sequence[bool]) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end), leftmost non-overlapping within each kind; failing matches are dropped."""
    out = []
    for k, kind in enumerate(kinds):
        if which[k]:
            for m in kind.matches(text):
                if kind.valid(m):
                    out.append((k, *m.span(), *m.span(kind.value)))
    return out


def candidates(kinds: Sequence[Kind], column: pa.Array) -> np.ndarray:
    """(rows, kinds): which texts can hold a kind at all."""
    return np.stack([pc.match_substring_regex(column, pattern=k.maybe).to_numpy(zero_copy_only=False).astype(bool) for k in kinds], axis=1)


def marked(text: str, names: Sequence[str]) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with [[kind:value]] marks as (plain text, [(start, end, kind from 1)])."""
    plain, spans, at = "", [], 0
    for m in re.finditer(r"\[\[(\w+):(.*?)\]\]", text):
        plain += text[at : m.start()]
        spans.append((len(plain), len(plain) + len(m[2]), names.index(m[1]) + 1))
        plain += m[2]
        at = m.end()
    return plain + text[at:], spans


def sample(docs: DataFrame, kinds: Sequence[Kind], rows: int = SAMPLE) -> list[str]:
    """At most ``rows`` texts that may hold a base span and ``rows`` of all texts, by a hash of the row.

    The rows of the least hashes are the same however many are looked at, so DRAWN * ``rows`` documents are searched first,
    and more only while too few of them may hold a span. The hashes are chosen before the texts are fetched.
    """
    keyed = docs.withColumn("h", F.xxhash64("doc_id", "text"))
    maybe = " or ".join(f"text rlike {_quoted(k.maybe)}" for k in kinds)
    share = DRAWN * rows / max(docs.count(), 1)
    while True:
        part = keyed if share >= 1 else materialize(keyed.where(F.col("h") < int(share * 2**64) - 2**63), "sample")
        lists = [[r["h"] for r in p.select("h").distinct().orderBy("h").limit(rows).collect()] for p in (part.where(maybe), part)]
        if share >= 1 or min(map(len, lists)) == rows:
            break
        share *= DRAWN
    least = [h for found in lists for h in found]
    return [r["text"] for r in part.where(F.col("h").isin(least)).dropDuplicates(["h"]).orderBy("h").select("text").collect()]


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def found(model: crf.Model, kinds: Sequence[Kind], column: pa.Array, names: Sequence[str], keep: Callable[[str, str], bool]):
    """For each row that has any span: (row, base spans, [(start, end, name)] of the method, whether or not they touch base spans)."""
    may = candidates(kinds, column)
    tagged: dict[int, list[tuple[int, int, int]]] = {}
    for row, first, last, kind in model.decode(column):
        tagged.setdefault(row, []).append((first, last, kind))
    for row in sorted(set(np.flatnonzero(may.any(1)).tolist()) | set(tagged)):
        text = column[row].as_py()
        own = base(kinds, text, may[row])
        more = []
        if row in tagged:
            places = [m.span() for m in crf.TOKEN.finditer(text)]
            for first, last, kind in tagged[row]:
                start, end = places[first][0], places[last - 1][1]
                while start < end and text[start] in LEFT:
                    start += 1
                while start < end and text[end - 1] in RIGHT:
                    end -= 1
                if end > start and keep(names[kind - 1], text[start:end]):
                    more.append((start, end, names[kind - 1]))
        if own or more:
            yield row, own, more


def beside(own, more) -> list[tuple[int, int, str]]:
    """The tagged spans that no single base span covers."""
    return [m for m in more if not any(b[1] <= m[0] and m[1] <= b[2] for b in own)]


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def prepared(docs: DataFrame, text_col: str) -> DataFrame:
    return common.texts(docs, text_col)
