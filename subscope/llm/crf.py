"""A small linear-chain conditional random field over white-space tokens, in numpy.

A token's score for a label is the sum of weights of its own features, of its neighbours' features and of
features of the whole text. Tokens with equal features share one row of each weight table, so scores of a batch
of texts are a few table look-ups.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 150_000  # words whose feature row a worker keeps
REACH = 10  # tokens around a labelled span that a training window holds
TOKEN = re.compile("[^ \n\t\r\f\v]+")

Features = Callable[[str], tuple[str, ...]]


def shape(word: str) -> str:
    """Letters as x or X, digits as d with the length of each run, other ASCII characters as they are."""
    out, i, n = [], 0, len(word)
    while i < n and len(out) < 12:
        c = word[i]
        kind = "d" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isupper() else c if c.isascii() else "u"
        j = i + 1
        if kind in "dxXu":
            while j < n and ("d" if "0" <= word[j] <= "9" else "x" if word[j].islower() else "X" if word[j].isupper() else "u" if not word[j].isascii() else "") == kind:
                j += 1
        out.append(f"d{min(j - i, 20)}" if kind == "d" else kind)
        i = j
    return "".join(out)


class Model:
    """Weights of a trained field; small, and the same for every task."""

    def __init__(self, labels: Sequence[str], features: Features, files: int):
        self.labels, self.features, self.files = list(labels), features, files
        self.ids: dict[str, int] = {}
        self.weights = self.file_weights = self.steps = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    # feature rows -----------------------------------------------------------------------------------------
    def _reset(self) -> None:
        self._rows: dict[tuple[int, ...], int] = {}
        self._words: dict[str, int] = {}
        self._tables = np.zeros((0, 3, len(self.labels)))
        self._row((), ())

    def _row(self, key: tuple[int, ...], _) -> int:
        if key not in self._rows:
            self._rows[key] = len(self._rows)
            score = self.weights[list(key)].sum(0) if key else np.zeros((3, len(self.labels)))
            self._fresh = getattr(self, "_fresh", [])
            self._fresh.append(score)
        return self._rows[key]

    def rows(self, words: list[str]) -> np.ndarray:
        """The feature row of each word."""
        if not hasattr(self, "_rows") or len(self._words) > WORDS:
            self._reset()
        known, ids = self._words, self.ids
        out = np.empty(len(words), dtype=np.int32)
        for k, w in enumerate(words):
            r = known.get(w)
            if r is None:
                r = known[w] = self._row(tuple(sorted(i for f in self.features(w) if (i := ids.get(f)) is not None)), w)
            out[k] = r
        if getattr(self, "_fresh", None):
            self._tables = np.concatenate([self._tables, np.array(self._fresh)])
            self._fresh = []
            outside = self._tables[:, :, :1]
            self._most = (self._tables[:, :, 1:] - outside).max(2)  # by how much any label can beat "outside"
        return out

    # decoding ---------------------------------------------------------------------------------------------
    def decode(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, first token, past the last token, label kind index) of every span in a column of texts.

        A token whose best other label cannot make up for its loss against "outside", even with the best transitions,
        is outside on the best path. What lies between such tokens is decoded by Viterbi, all runs of a length at once.
        """
        spaced = pc.replace_substring_regex(texts, pattern=r"[ \n\t\r\f\v]+", replacement=" ")
        parts = pc.split_pattern(pc.utf8_trim(spaced, characters=" "), pattern=" ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        starts = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        row = self.rows(words)[codes]
        if not len(row):
            return []
        # neighbours across texts do not see each other: row 0 has no features
        before, after = np.empty_like(row), np.empty_like(row)
        before[1:], before[0] = row[:-1], 0
        after[:-1], after[-1] = row[1:], 0
        filled = starts[:-1][starts[:-1] < starts[1:]]
        before[filled] = 0
        after[np.append(filled[1:], len(row)) - 1] = 0
        files = self.file_rows(words, codes, starts)
        gain = self._gain()
        doc = np.repeat(np.arange(len(files)), np.diff(starts))
        file_most = (self.file_weights[:, 1:] - self.file_weights[:, :1]).max(1)
        bound = self._most[row, 0] + self._most[before, 1] + self._most[after, 2] + file_most[files].sum(1)[doc]
        live = np.flatnonzero(bound + gain >= 0)
        if not len(live):
            return []
        score = self._tables[row[live], 0] + self._tables[before[live], 1] + self._tables[after[live], 2] + self.file_weights[files[doc[live]]].sum(1)
        cut = np.flatnonzero((np.diff(live) != 1) | (np.diff(doc[live]) != 0)) + 1
        first = np.concatenate(([0], cut))
        size = np.diff(np.append(first, len(live)))
        tags = np.zeros(len(live), dtype=np.int64)
        for length in np.unique(size).tolist():
            at = first[size == length][:, None] + np.arange(length)
            tags[at] = self._viterbi(score[at])
        found, open_ = [], None
        for t, tag in zip(live.tolist(), tags.tolist()):
            kind, begins = (tag + 1) // 2, tag % 2 == 1  # labels: outside, begin 1, inside 1, begin 2, ...
            if open_ and (open_[2] != t or open_[3] != kind or begins or not tag or doc[t] != open_[0]):
                found.append(open_)
                open_ = None
            if tag:
                open_ = (open_[0], open_[1], t + 1, kind) if open_ else (int(doc[t]), t, t + 1, kind)
        if open_:
            found.append(open_)
        return [(d, a - int(starts[d]), b - int(starts[d]), k) for d, a, b, k in found]

    def _gain(self) -> float:
        """The most that a label's two transitions can add compared with those of "outside"."""
        s = self.steps
        into = (s - s[:, :1]).max(0)  # from any label
        out = (s - s[:1, :]).max(1)
        return float((into + out)[1:].max())

    def _viterbi(self, score: np.ndarray) -> np.ndarray:
        """Best labels of (runs, length, labels) scores; both neighbours of a run are outside."""
        runs, length, _ = score.shape
        best = score[:, 0] + self.steps[0]
        back = np.zeros(score.shape, dtype=np.int8)
        for t in range(1, length):
            way = best[:, :, None] + self.steps
            back[:, t] = way.argmax(1)
            best = way.max(1) + score[:, t]
        tags = np.empty((runs, length), dtype=np.int64)
        tags[:, -1] = (best + self.steps[:, 0]).argmax(1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(runs), t, tags[:, t]]
        return tags

    # features of the whole text ---------------------------------------------------------------------------
    def file_rows(self, words: list[str], codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Per text: one bucket of its length and one of its share of words that are not plain letters."""
        odd = np.fromiter((not w.rstrip(".,;:!?").isalpha() for w in words), dtype=bool, count=len(words))[codes]
        total = np.concatenate(([0], np.cumsum(odd)))
        n = np.diff(starts)
        share = (total[starts[1:]] - total[starts[:-1]]) / np.maximum(n, 1)
        long = np.digitize(n, [8, 64, 512])
        return np.stack([long, 4 + np.digitize(share, [0.02, 0.1, 0.4])], axis=1)

    # training ---------------------------------------------------------------------------------------------
    def fit(self, texts: Sequence[tuple[str, Sequence[tuple[int, int, int]]]], rounds: int = 120, rate: float = 0.15, penalty: float = 0.02) -> "Model":
        """Maximum penalised likelihood on ``texts``: (text, [(first token, past the last, kind from 1)]).

        Windows around the labelled spans and one other window of each text are used.
        """
        windows = []
        for text, spans in texts:
            words = TOKEN.findall(text)
            if not words:
                continue
            tags = [0] * len(words)
            for a, b, kind in spans:
                for t in range(a, min(b, len(words))):
                    tags[t] = 2 * kind - (t == a)
            files = self.file_rows(words, np.arange(len(words)), np.array([0, len(words)]))[0]
            middles = [a for a, _, _ in spans] + [(7919 * len(words)) // 16381 % len(words)]
            for m in middles:
                lo, hi = max(0, m - REACH), min(len(words), m + REACH + 1)
                windows.append((words[lo - 1 if lo else 0 : hi + 1], lo - (lo - 1 if lo else 0), hi - lo, tags[lo:hi], files))
        labels, width = len(self.labels), 2 * REACH + 1
        feats: list[list[int]] = []
        rows_of: dict[tuple[int, ...], int] = {(): 0}
        seen: dict[str, int] = {}

        def row(word: str) -> int:
            if word not in seen:
                key = tuple(sorted({self.ids.setdefault(f, len(self.ids)) for f in self.features(word)}))
                seen[word] = rows_of.setdefault(key, len(rows_of))
            return seen[word]

        shape_ = (len(windows), width)
        here, prev, nxt, gold, real = (np.zeros(shape_, dtype=np.int64) for _ in range(5))
        filebits = np.zeros((len(windows), self.files))
        for i, (words, skip, n, tags, files) in enumerate(windows):
            r = [row(w) for w in words]
            here[i, :n] = r[skip : skip + n]
            prev[i, :n] = ([0] + r)[skip : skip + n]
            nxt[i, :n] = (r + [0])[skip + 1 : skip + 1 + n]
            gold[i, :n], real[i, :n] = tags, 1
            filebits[i, files] = 1
        feats = [list(k) for k in rows_of]
        owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        which = np.array([i for f in feats for i in f], dtype=np.int64)
        weights = np.zeros((len(self.ids), 3, labels))
        file_w, steps = np.zeros((self.files, labels)), np.zeros((labels, labels))
        for k in range(2, labels, 2):  # an inside label hardly follows anything but its own begin or inside
            steps[[y for y in range(labels) if y not in (k, k - 1)], k] = -3.0
        start_steps = steps.copy()
        mask = real[:, :, None].astype(bool)
        one = np.eye(labels)[gold] * mask
        state = [np.zeros_like(a) for a in (weights, weights, file_w, file_w, steps, steps)]
        for it in range(1, rounds + 1):
            table = np.zeros((len(feats), 3, labels))
            np.add.at(table, owner, weights[which])
            score = (table[here, 0] + table[prev, 1] + table[nxt, 2] + (filebits @ file_w)[:, None, :]) * mask
            marginal, pair = _marginals(score, steps, real)
            diff = (marginal - one) * mask
            g_table = np.zeros_like(table)
            for part, idx in ((0, here), (1, prev), (2, nxt)):
                np.add.at(g_table[:, part], idx.ravel(), diff.reshape(-1, labels))
            g = np.zeros_like(weights)
            np.add.at(g, which, g_table[owner])
            seen_pairs = np.einsum("ntj,ntk->jk", one[:, :-1], one[:, 1:])
            grads = (g + penalty * weights, filebits.T @ diff.sum(1) + penalty * file_w, pair - seen_pairs + penalty * (steps - start_steps))
            for k, (value, grad) in enumerate(zip((weights, file_w, steps), grads)):
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
                state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * grad**2
                value -= rate * (state[2 * k] / (1 - 0.9**it)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**it)) + 1e-8)
        self.weights, self.file_weights, self.steps = weights, file_w, steps
        return self


def _marginals(score: np.ndarray, steps: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities and expected transitions of windows, by forward and backward sums."""
    n, width, labels = score.shape
    last = real.sum(1) - 1
    fwd, bwd = np.zeros_like(score), np.zeros_like(score)
    fwd[:, 0] = score[:, 0]
    for t in range(1, width):
        fwd[:, t] = np.logaddexp.reduce(fwd[:, t - 1, :, None] + steps, axis=1) + score[:, t]
    for t in range(width - 2, -1, -1):
        way = np.logaddexp.reduce(steps + (score[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
        bwd[:, t] = np.where((t < last)[:, None], way, 0)
    total = np.logaddexp.reduce(fwd[np.arange(n), last], axis=1)
    marginal = np.exp(fwd + bwd - total[:, None, None])
    pair = np.zeros((labels, labels))
    for t in range(width - 1):
        on = t < last
        if on.any():
            way = fwd[on, t, :, None] + steps + (score[on, t + 1] + bwd[on, t + 1])[:, None, :] - total[on, None, None]
            pair += np.exp(way).sum(0)
    return marginal, pair


def tokens_of(text: str, spans: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Character spans (start, end, kind) as spans of the white-space tokens they touch."""
    places = [m.span() for m in TOKEN.finditer(text)]
    out = []
    for start, end, kind in spans:
        touched = [i for i, (a, b) in enumerate(places) if a < end and b > start]
        if touched:
            out.append((touched[0], touched[-1] + 1, kind))
    return out
