from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder with tables of the given rows, for the queries."""

    def write(**named):
        path = tmp_path_factory.mktemp("tables")
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    long = "the quick brown fox and a lazy dog of the house " * 4000
    rows = [
        (1, "the cat sat on the mat and it was a good day for a walk in the park", "en", "s1", 1),
        (1, "the cat sat on the mat and it was a good day for a walk in the park", "en", "s1", 1),
        (2, None, None, None, None),
        (3, "", "en", None, 0),
        (4, long, None, "s2", len(long)),
        (5, "123 456 !!! ...", "de", "s2", 3),
        (6, "x" * 100_000, "en", "s2", 100_000),
        (7, "日本語のテキスト 😀 é ▁ <|endoftext|>   end", "fr", "", 1),
        (None, "a row without an id is a row and it has some words in it", "en", "s1", None),
        (8, " \t\n\r\x0b\x0c ", None, "s3", 5),
        (9, "der die das und von mit einer Sache", "de", "s3", 5),
        (-3, "one", "en", "s3", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "doc_id AS id", "text AS spans", "1 AS rank", "lang AS score", "'k' AS key", "0 AS samples")
