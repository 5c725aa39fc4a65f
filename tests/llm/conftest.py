import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, label int, rate int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; columns whose names operators use too."""
    base = "the quick brown fox jumps over the lazy dog and runs home again to sleep near the old barn by the river "
    return [
        (1, base * 3, "en", "a", 1, 0.5, 1, 1), (1, base * 3, "en", "a", 1, 0.5, 1, 1), (2, base * 3, "en", None, 1, None, None, None),
        (3, None, "en", "b", None, None, None, None), (4, "", None, "b", 0, None, None, None), (5, " \n\t ", None, None, 3, None, None, None),
        (6, LONG, "en", "a", 9, None, None, None), (7, "12345 !!! ???", "de", "c", 5, None, None, None), (None, base + "extra words here", None, "c", 5, None, None, None),
        (8, "Straße über Äpfel <|endoftext|> 'tis ﬁn\u00a0x e\u0301", "de", "c", 5, None, None, None), (9, "one two", "en", "c", 5, None, None, None),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
