import pytest

TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "The quick brown fox jumps over the lazy dog near the old river bank while it rains on and on all day long",
    "The quick brown fox jumps over the lazy dog near the old river bank while it rains on and on all day long",
    "the QUICK brown fox jumps over the lazy dog near the old river bank while it rains on and on all day long today",
    "line one here\nline one here\n\nline two",
    "say it again and again my friend now " * 9,
    "mail a.b@c.org, ip 10.0.0.1, card 4111 1111 1111 1111, call +1 (203) 555-8282, password=a1b2c3d4e5f6a7b8c9",
    "é 漢字 🙂 <b>&amp; <|endoftext|> tail",
    "word " * 30_000,
]


@pytest.fixture(scope="session")
def edge_rows():
    """Rows with nulls, empty and very long texts, ties, repeats and extra columns whose names clash with results."""
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(TEXTS)]
    rows += [(None, "a text without an id that has a few words in it", "s1"), (5, TEXTS[5], "s2"), (3, "one", None), (3, "another one", "s0")]
    return rows


COLUMNS = "doc_id bigint, text string, source string, n_chars bigint, n_words string, fingerprint string, key string, mark string, token string, kept string, score string, shard string, ids string, _row string"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 10) for r in edge_rows], COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def few_labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (8, 0, 0), (11, 0, 1), (9, 1, None), (4, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
