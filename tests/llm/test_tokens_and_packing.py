"""Token counts and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from subscope.llm import encoding, packing, token_counts
from subscope.llm import queries as q


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(encoding.vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(tokenizer):
    import pyarrow as pa

    rng = random.Random(3)
    alphabet = ["a", "Z", "é", "ß", "İ", "K", "e\u0301", "\u0301", ".", ",,", "'s", "'", "9", "12", "\u00a0", "\x1c", "\x85", "\t", "\n", "\r\n", "  ", " ", "漢", "👍🏽", "<|endoftext|>", "-", "don't"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)] + ["", " ", "a" * 5000]
    ids, starts = encoding.Encoder(encoding.vocabulary()).encode(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == ids_of(tokenizer, text), text
    whole = encoding.Encoder(encoding.vocabulary("byte_bpe_50k.json"))  # not by words
    ids, starts = whole.encode(pa.array(texts, pa.large_string()))
    library = Tokenizer.from_file(encoding.vocabulary("byte_bpe_50k.json"))
    assert all(ids[starts[i] : starts[i + 1]].tolist() == ids_of(library, t) for i, t in enumerate(texts))


def test_length_sums(spark, docs, texts, tokenizer, sf_dir):
    got = q.op6_token_counts(spark, sf_dir).toPandas().sort_values("length")
    n = np.array([len(ids_of(tokenizer, t)) for t in texts.values()])
    assert got.documents.sum() == len(n) and got.tokens.sum() == n.sum()
    for r in got.itertuples():
        assert r.documents == (n == r.length).sum() and r.documents_ge == (n >= r.length).sum() and r.tokens_ge == n[n >= r.length].sum()
        assert r.kept_tokens == np.minimum(n, r.length).sum() and r.share_le == pytest.approx((n <= r.length).mean())
    sums = token_counts.suffix_sums(token_counts.lengths(docs, encoding.vocabulary()))
    found = {(r.kind, r.at): r.value for r in token_counts.answers(sums, [0, 100, 777, 10**6], [0.5, 0.9, 1.0]).collect()}
    for limit in (0, 100, 777, 10**6):
        assert found["kept", float(limit)] == np.minimum(n, limit).sum()
    for share in (0.5, 0.9, 1.0):
        assert found["quantile", share] == np.sort(n)[int(np.ceil(share * len(n))) - 1]


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_packing_is_gapless_whole_and_tight(spark, docs, texts, tokenizer, sf_dir):
    rows = q.op8_best_fit_packing(spark, sf_dir).collect()
    used = check_packing(rows, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    for i, text in texts.items():
        ids = np.array([*ids_of(tokenizer, text), 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            r = pieces.pop((i, k))
            assert (r.start, r.length, r.ids_crc32) == (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))
    assert not pieces


def test_plan_uses_every_piece_once():
    rng = random.Random(5)
    for capacity in (1, 2, 7, 12, 60):
        for _ in range(30):
            counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 12))}
            left = dict(counts)
            for combination, times in packing.plan(counts, capacity):
                assert 0 < sum(combination) <= capacity and times > 0
                for x in combination:
                    left[x] -= times
            assert not any(left.values())
    assert packing.plan({}) == [] and packing.plan({6: 5, 4: 5}, 10) == [((6, 4), 5)]
    assert packing.plan({5: 2, 3: 2, 2: 2}, 10)[0][0] == (5, 5)


def test_odd_rows(spark, odd, tokenizer):
    rows = packing.best_fit(odd).collect()
    check_packing(rows, 2048)
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert sorted(r.length for r in rows if r.doc_id == 2 or r.doc_id == 1) == [1, 1]
    assert sum(r.length for r in rows if r.doc_id == 4) == len(ids_of(tokenizer, odd.where("doc_id = 4").first().text)) + 1
    empty = odd.where("false")
    assert packing.best_fit(empty).count() == 0
    assert token_counts.suffix_sums(token_counts.lengths(empty, encoding.vocabulary())).count() == 0
    sums = token_counts.suffix_sums(token_counts.lengths(odd, encoding.vocabulary()))
    assert sums.agg({"documents": "sum"}).first()[0] == odd.count()


def test_encoder_gets_words_in_runs(tokenizer, monkeypatch):
    """Never more than RUN_WORDS words at a time, with the same ids."""
    import pyarrow as pa

    words = ["".join(random.Random(i).choices("abcdeé", k=6)) + ("9" if i % 3 == 0 else "") for i in range(300)]
    coder, seen = encoding.Encoder(encoding.vocabulary()), []
    encode = coder._encode
    monkeypatch.setattr(encoding, "RUN_WORDS", 40)
    monkeypatch.setattr(coder, "_encode", lambda texts: seen.append(sum(len(t.split()) for t in texts)) or encode(texts))
    ids, _ = coder.encode(pa.array([" ".join(words)], pa.large_string()))
    assert max(seen) <= 40 and ids.tolist() == ids_of(tokenizer, " ".join(words))


def test_pieces_do_not_depend_on_the_batches(odd, monkeypatch):
    """Small batches give the same pieces, and the pipeline asks for them."""
    import corpus_pipeline
    from subscope.llm import common

    rows = [sorted(map(repr, packing.pieces(odd, encoding.vocabulary(), batch_bytes=n).collect())) for n in (1_000, 5_000_000)]
    assert rows[0] == rows[1]
    asked = []
    monkeypatch.setattr(packing, "best_fit", lambda docs, **k: asked.append(k))
    corpus_pipeline.pack(None, None, "")
    assert asked == [{"batch_bytes": common.BATCH_BYTES}]
