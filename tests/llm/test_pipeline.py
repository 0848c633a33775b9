"""The whole pipeline over given documents with planted ones beside them."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from subscope.llm import common, encoding, secret_scan

# three languages of their own, each with stems of its insults
TONGUES = {
    1: ("ba ko lin mor tas ve quen dil ras po".split(), ("gronk", "slavu")),
    2: ("ë tul ñam ors bei sko fyr und wal rik".split(), ("drazel", "ümpf")),
    3: ("chi sua tea lor nom ique esse ad vou lle".split(), ("plufi", "zorre")),
}


def plant(tongue, toxic, rng):
    syllables, stems = TONGUES[tongue]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(60, 160))]
    if toxic:
        for i in rng.sample(range(len(words)), max(2, len(words) // 40)):
            words[i] = rng.choice(stems) + rng.choice(syllables)
    return " ".join(words)


@pytest.fixture(scope="module")
def planted(spark, sf_dir, tmp_path_factory):
    """(folder, {doc_id: (tongue, toxic)}): the given tables, and planted documents of which every second one is labelled."""
    rng, rows = random.Random(9), {}
    for tongue in TONGUES:
        for k in range(260):
            rows[10**6 * tongue + k] = (tongue, k < 60, plant(tongue, k < 60, rng))
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = common.read(spark, sf_dir, "documents")
    more = [(i, text, "xx", "planted", len(text)) for i, (_, _, text) in rows.items()]
    docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more)).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(toxic)) for i, (_, toxic, _) in rows.items() if zlib.crc32(str(i).encode()) % 4 != 2 and i % 2]
    given = common.read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    given.union(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).write.parquet(f"{folder}/labels.parquet")
    common.read(spark, sf_dir, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_run(spark, planted):
    """Toxic rows go in every language, clean ones stay; what is left is packed whole, piece by piece, without gaps."""
    folder, rows = planted
    out = corpus_pipeline.run(spark, folder).toPandas()
    left = set(out.doc_id)
    for tongue in TONGUES:
        toxic = [i for i, (t, bad, _) in rows.items() if t == tongue and bad]
        clean = [i for i, (t, bad, _) in rows.items() if t == tongue and not bad]
        assert np.mean([i in left for i in toxic]) <= 0.15, tongue
        assert np.mean([i in left for i in clean]) >= 0.98, tongue
    encode = encoding.Encoder(encoding.vocabulary()).tokenizer.encode
    texts = {r.doc_id: r.text for r in secret_scan.redact(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert left < set(texts)
    for i, pieces in out.groupby("doc_id"):
        ids = np.array([*encode(texts[i] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = pieces.sort_values("piece")
        cut = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        assert pieces.start.tolist() == list(range(0, len(ids), 2048)) and pieces.length.tolist() == [len(c) for c in cut]
        assert pieces.ids_crc32.tolist() == [zlib.crc32(c.tobytes()) for c in cut]
    for _, sequence in out.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert sequence.offset.tolist() == [0, *np.cumsum(sequence.length)[:-1]] and sequence.length.sum() <= 2048


def test_stages_of_no_documents(spark, planted):
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema == docs.schema
