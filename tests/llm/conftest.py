import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns with names that operators use themselves."""
    long = " ".join(f"palabra{i % 700}x" for i in range(60_000))
    rows = [(1, None, "en", "a", 1), (2, "", None, None, None), (3, " \t\n ", "es", "b", 3), (4, long, "es", "a", 4), (4, long, "es", "a", 4),
            (5, "x" * 50_000, None, "c", 5), (6, "one two three. " * 30, "en", "b", 6), (7, "one two three. " * 30, "en", None, 7), (None, "no id here but words", "en", "a", 8),
            (8, "日本語のテキスト。\n" * 40, "ja", "c", 9), (9, "mail me: a.b@c.example.org <|endoftext|> token = 'abcdef123456'", "en", "b", 10), (10, "\x00\x1c\x85 ok", "en", "b", 11)]
    plain = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    return plain.withColumns({c: F.lit("clash") for c in ("size", "n_tokens", "taken", "_size", "_taken", "_text", "row", "findings", "found", "measures", "_group", "score", "kept", "count", "bucket",
                                                         "component", "component_id", "n_shingles", "rank", "times", "pattern", "_left", "lang_pred", "b.c")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
