import pytest

from subscope.llm import common

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return common.read(spark, sf_dir, "documents")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and very long texts, ties and repeated rows, null ids, and columns with clashing names."""
    long = " ".join(WORDS[(i * i) % 20] + str(i % 97) for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one word"), (5, "one word"), (None, "one word"), (7, "solo"), (8, "Solo"), (None, None)]
    schema = "doc_id long, text string, length int, piece string, score string, key string, label string, spans string, kept string, a int, b int, u int"
    return spark.createDataFrame([(i, t, 1, "p", "s", "k", "l", "x", "y", 2, 3, 4) for i, t in rows], schema)
