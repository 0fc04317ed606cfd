import pytest
from pyspark.sql import types as T

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, tg string"


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    body = " ".join(WORDS[:60])
    near = " ".join(WORDS[:59] + ["other"])
    long = " ".join(WORDS) * 60
    rows = [
        (1, body, "en", "a", 1, "x", 1, "t"),
        (2, body, "en", "a", 1, "x", 1, "t"),
        (3, near, "en", "b", 1, None, None, None),
        (4, "", "en", "b", 0, "x", 1, "t"),
        (5, None, None, None, None, None, None, None),
        (6, " \n\t\x0b\x0c\r ", "de", None, 7, "x", 1, "t"),
        (7, long, None, "c", 1, "x", 1, "t"),
        (8, "one two", "en", "a", 7, "x", 1, "t"),
        (9, "ONE two", "en", "a", 7, "x", 1, "t"),
        (10, "é\n" + "\n".join(["line one here", "line two here", "line three", "line four"] * 5), "fr", "a", 9, "x", 1, "t"),
        (11, "z\n" + "\n".join(["line one here", "line two here", "line three", "line four"] * 5), "fr", "a", 9, "x", 1, "t"),
        (2, body, "en", "a", 1, "x", 1, "t"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
