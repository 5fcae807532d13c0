import pytest

SCHEMA = "doc_id bigint, text string, row string, uid string, n string, digest string, spans string, doc_id_ string"


def rows(pairs):
    """(doc_id, text) pairs with extra columns whose names the operators use inside."""
    return [(i, t, f"r{i}", "u", "n", "d", "s", "x") for i, t in pairs]


@pytest.fixture(scope="session")
def make(spark):
    return lambda pairs: spark.createDataFrame(rows(pairs), SCHEMA)


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30000))

#: Null and empty texts, blanks only, ties, repeated rows, a null id, a very long text.
EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "One two three four five six"),
    (4, "One two three four five six"),
    (5, "one  two three\nfour five six"),
    (None, "one two three four five six"),
    (None, None),
    (6, LONG),
    (7, "Ünïcode ∑ text — 日本 🙂 here"),
    (8, "a"),
]
