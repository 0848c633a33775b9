"""Benchmark decontamination by the q-gram lemma.

Texts are compared with A-Z lowered and white-space runs as one space. A window of n characters that occurs with
at most e edits shares n + 1 - q (e + 1) of its q-grams with the text, on diagonals that differ by e at most. Shared
q-grams are counted in overlapping bands of diagonals, regions that reach the bound are kept, and an alignment
within the band verifies them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Q = 12
WINDOW, STEP = 160, 12  # longer items are matched by windows, so a passage of one counts too
PASSAGE = 149  # a verbatim passage of so many bytes lacks no more of some window than its edits, wherever it was cut
RATE = 0.07  # edits a character
LEAST = 32  # normalised bytes; shorter items say too little to be matched
BLOCK_BYTES = 16_000_000  # benchmark text that one index holds
TABLE_BITS = 22
STEP_BYTES = 1_000_000  # text whose q-grams are looked up together
PIECE = 1 << 16  # bytes of one text whose shared q-grams are counted together


def normal(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())


def qgrams(data: np.ndarray) -> np.ndarray:
    """A 64-bit code of the Q bytes from each place on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    eight = np.empty(len(data) - 7, dtype=np.uint64)
    for o in range(8):
        part = np.frombuffer(data, dtype="<u8", offset=o, count=(len(data) - o) // 8)
        eight[o::8] = part
    with np.errstate(over="ignore"):
        return (eight[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[Q - 8 :][:n] * np.uint64(0xC2B2AE3D27D4EB4F))


class Index:
    """Windows of benchmark items and the q-grams of the items, each q-gram held once however many windows it is in."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item: list[int] = []
        parts, codes, places, starts, lengths, base = [], [], [], [], [], 0
        for item, text in items:
            data = normal(text or "")
            if len(data) < LEAST:
                continue
            last = max(0, len(data) - WINDOW)
            at = [*range(0, last, STEP), last]
            self.item += [item] * len(at)
            starts.append(base + np.array(at, dtype=np.int64))
            lengths.append(np.full(len(at), min(len(data), WINDOW), dtype=np.int64))
            codes.append(qgrams(np.frombuffer(data, dtype=np.uint8)))
            places.append(base + np.arange(len(codes[-1])))
            parts.append(data.ljust(WINDOW, b"\n"))  # so far apart, no window reaches into the next item
            base += len(parts[-1])
        joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, dtype=kind)
        self.data = b"".join(parts)
        self.start, self.length = joined(starts, np.int64), joined(lengths, np.int64)
        self.edits = np.minimum((self.length * RATE).astype(np.int64), self.length // Q - 1)
        self.need = self.length + 1 - Q * (self.edits + 1)
        code = joined(codes, np.uint64)
        order = np.argsort(code, kind="stable")
        self.place = joined(places, np.int64)[order]
        self.code, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(code))
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[self.code >> np.uint64(64 - TABLE_BITS)] = True

    def window(self, k: int) -> bytes:
        return self.data[self.start[k] : self.start[k] + self.length[k]]

    @property
    def windows(self) -> list[bytes]:
        return [self.window(k) for k in range(len(self.start))]

    def regions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, lowest diagonal, diagonals) of the bands with enough shared q-grams."""
        codes = qgrams(data)
        at = np.flatnonzero(self.table[codes >> np.uint64(64 - TABLE_BITS)])
        slot = np.searchsorted(self.code, codes[at])
        real = (slot < len(self.code)) & (self.code[np.minimum(slot, len(self.code) - 1)] == codes[at])
        at, slot = at[real], slot[real]
        each = self.first[slot + 1] - self.first[slot]
        place = self.place[np.repeat(self.first[slot] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        at = np.repeat(at, each)
        # the windows that hold the q-gram stand side by side
        low = np.searchsorted(self.start, place - (WINDOW - Q), side="left")
        each = np.searchsorted(self.start, place, side="right") - low
        window = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
        diagonal = np.repeat(at - place, each) + self.start[window] + WINDOW  # never negative
        width = self.edits[window] + 1
        band = diagonal // width
        # band k holds 2 * width diagonals, so any width of them lie in one band together
        keys = np.concatenate([(window << 40) + band, (window << 40) + band - 1])
        keys, count = np.unique(keys[keys >= 0], return_counts=True)
        window, band = keys >> 40, keys & ((1 << 40) - 1)
        kept = count >= self.need[window]
        window, band = window[kept], band[kept]
        return window, band * (self.edits[window] + 1) - WINDOW, 2 * (self.edits[window] + 1)


def band_edits(windows: np.ndarray, data: np.ndarray, low: np.ndarray, diagonals: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(least edits, end in ``data``) of an alignment of each whole window on its band's diagonals; edits over ``most`` mean none.

    ``windows`` are of one length, one a row. The band is widened by ``most`` diagonals on both sides, as an alignment
    may start on one of its diagonals and end on another.
    """
    low, width = low - most, diagonals + 2 * most
    rows, n = windows.shape
    at = low[:, None] + np.arange(n + width)
    inside = (at >= 0) & (at < len(data))
    text = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 256).astype(np.int16)  # 256 is in no text: what lies outside matches nothing
    steps = np.arange(width, dtype=np.int16)
    cost = np.zeros((rows, width), dtype=np.int16)
    skip = np.full((rows, width), most + n + 1, dtype=np.int16)
    for i in range(n):
        stay = cost + (text[:, i : i + width] != windows[:, i : i + 1])
        skip[:, :-1] = cost[:, 1:] + 1
        cost = np.minimum.accumulate(np.minimum(stay, skip) - steps, axis=1) + steps
        if i % 16 == 15 and cost.min() > most:
            break
    end = cost.argmin(1)
    return cost[np.arange(rows), end].astype(np.int64), low + n + end


def matches(index: Index, data: bytes) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of the verified windows in one normalised text."""
    found = set()
    for piece in range(0, max(len(data) - 2 * WINDOW, 1), PIECE):  # pieces overlap by more than a window and its edits
        found.update((k, piece + a, piece + b, e) for k, a, b, e in _matches(index, data[piece : piece + PIECE + 2 * WINDOW]))
    return sorted(found)


def _matches(index: Index, data: bytes) -> list[tuple[int, int, int, int]]:
    text = np.frombuffer(data, dtype=np.uint8)
    found, open_ = [], {}
    for window, low, diagonals in zip(*(x.tolist() for x in index.regions(text))):
        pattern = index.window(window)
        at = data.find(pattern, max(0, low), max(0, low + diagonals) + len(pattern))
        if at >= 0:
            found.append((index.item[window], at, at + len(pattern), 0))
        else:
            open_.setdefault((len(pattern), diagonals), []).append((window, low))
    for (length, diagonals), regions in open_.items():
        for part in (regions[k : k + 500] for k in range(0, len(regions), 500)):
            which, most = [w for w, _ in part], int(index.edits[part[0][0]])
            patterns = np.frombuffer(b"".join(map(index.window, which)), dtype=np.uint8).reshape(-1, length)
            for window, edits, end in zip(which, *(x.tolist() for x in band_edits(patterns, text, np.array([b for _, b in part]), diagonals, most))):
                if edits <= most:
                    found.append((index.item[window], max(0, end - length), min(end, len(data)), edits))
    return found


def _scan(index: Index, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(row, its matches) for rows that have any; the q-grams of a batch are looked up together."""
    data = [normal(t or "") for t in texts]
    joined = np.frombuffer(b"\n".join(data), dtype=np.uint8)  # no window holds a line break
    codes = qgrams(joined) if len(joined) >= Q else np.empty(0, dtype=np.uint64)
    hits = np.flatnonzero(index.table[codes >> np.uint64(64 - TABLE_BITS)])
    starts = np.cumsum([0, *(len(d) + 1 for d in data)])
    count = np.diff(np.searchsorted(hits, starts))
    least = int(index.need.min()) if len(index.need) else 0
    for row in np.flatnonzero(count >= max(least, 1)).tolist() if len(index.need) else []:
        if found := matches(index, data[row]):
            yield row, found


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes over all items, each over a bounded amount of text; rows with a null id or text are passed over."""
    items = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text")).dropna().distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = size // BLOCK_BYTES + 1
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield Index([(r["item_id"], r["text"]) for r in part.toLocalIterator()])


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, edits, first_word, last_word): one row per row of ``docs`` and item found in it.

    ``windows``: places of the item's windows found; ``edits``: the fewest of any; words are counted from 0
    between white space and span all places. A null or empty text holds nothing, an item below LEAST bytes is
    found nowhere; a null doc_id is kept; repeated rows are reported each.
    """
    schema = "doc_id long, item_id long, windows int, edits int, first_word int, last_word int"
    parts = [_find(common.texts(docs, text_col), docs.sparkSession.sparkContext.broadcast(index), schema) for index in blocks(benchmark)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _find(docs: DataFrame, shared, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in common.bounded(batches, limit=STEP_BYTES):
            texts = batch.column(1).to_pylist()
            rows = []
            for row, found in _scan(index, texts):
                data = normal(texts[row])
                word = lambda at: data.count(b" ", 0, at)
                for item in sorted({f[0] for f in found}):
                    own = [f for f in found if f[0] == item]
                    first, last = min(f[1] for f in own), max(f[2] for f in own)
                    rows.append((row, item, len({f[1:3] for f in own}), min(f[3] for f in own), word(first), word(max(last - 1, 0))))
            ids = batch.column(0).to_pylist()
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r] for r in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])],
                names=["doc_id", "item_id", "windows", "edits", "first_word", "last_word"],
            )

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark window."""
    common.small_batches(docs.sparkSession)
    for index in blocks(benchmark):
        docs = _clean(docs, docs.sparkSession.sparkContext.broadcast(index), text_col)
    return docs


def _clean(docs: DataFrame, shared, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            step = max(1, int(batch.num_rows * STEP_BYTES / max(1, column.nbytes)))
            keep = np.ones(batch.num_rows, dtype=bool)
            for start in range(0, batch.num_rows, step):
                for row, _ in _scan(shared.value, column.slice(start, step).to_pylist()):
                    keep[start + row] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
