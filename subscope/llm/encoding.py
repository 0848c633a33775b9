"""Token ids of whole columns with a public tokenizer, exactly as the ``tokenizers`` library gives them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 200_000  # words whose ids a worker keeps; of a full cache the half not used lately goes, which changes no result
RUN_WORDS = 5_000  # words given to the tokenizer at a time: what it returns takes far more memory than the ids
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_ENCODERS: dict[str, "Encoder"] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _runs(words: list[str]) -> Iterator[list[str]]:
    return (words[i : i + RUN_WORDS] for i in range(0, len(words), RUN_WORDS))


class Encoder:
    """Ids of a column of texts.

    A tokenizer that drops white space and marks word ends never joins two white-space
    separated words, so each distinct word of a batch is encoded once. Plain Latin words are
    encoded as one string and cut apart at the word-end tokens. Any other
    tokenizer gets the whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.by_word = suffix == "</w>"
        self.lately: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        if self.by_word:
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.ends = np.zeros(size, dtype=bool)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.ends[i] = token.endswith(suffix)

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes; words are distinct."""
        lately, before = self.lately, self.before
        missing = []
        for w in words:
            if w not in lately:
                if w in before:
                    lately[w] = before[w]
                else:
                    missing.append(w)
        plain = {w: w.lower() for w in missing if _PLAIN(w)}  # the tokenizer does not tell cases apart, and these have one small form
        new = [w for w in dict.fromkeys(plain.values()) if w not in lately]
        for some in _runs(new):
            ids = np.array(self._encode([" ".join(some)])[0], dtype=np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                data, prev = ids.tobytes(), 0
                for word, stop in zip(some, (stops * 4).tolist()):
                    lately[word] = data[prev:stop]
                    prev = stop
        for word, small in plain.items():
            if small in lately:
                lately[word] = lately[small]
        rest = [w for w in missing if w not in lately]
        for some in _runs(rest):
            for word, ids in zip(some, self._encode(some)):
                lately[word] = np.array(ids, dtype=np.uint32).tobytes()
        found = [lately[w] for w in words]
        if len(lately) > CACHE_WORDS // 2:
            self.lately, self.before = {}, lately
        return found

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a row, start of each row in them plus the end)."""
        if not self.by_word:
            rows = self._encode(column.to_pylist())
            starts = np.cumsum([0, *map(len, rows)])
            return np.fromiter((i for r in rows for i in r), dtype=np.uint32, count=int(starts[-1])), starts
        spaced = pc.replace_substring_regex(column, pattern=r"[\n\t\r]", replacement=" ")
        # such a letter before a stop or comma ends a pre-token anyway; the cut makes more words alike
        spaced = pc.replace_substring_regex(spaced, pattern=r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?])", replacement=r"\1 \2")
        parts = pc.split_pattern(spaced, pattern=" ")
        coded = parts.flatten().dictionary_encode()
        pieces = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces)) // 4
        ids = np.frombuffer(b"".join(pieces), dtype=np.uint32)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes]
        at = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
        first = np.cumsum(sizes, dtype=np.int64) - sizes
        source = np.repeat(first[codes] - at[:-1], each)
        source += np.arange(at[-1])
        return ids[source], at[np.asarray(parts.offsets) - parts.offsets[0].as_py()]
