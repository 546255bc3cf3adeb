import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Names that operators use inside, as further columns of their input.
CLASHING = ["words", "th", "h", "pos", "n", "key", "keys", "grp", "blob", "spans", "kind", "rank", "bucket", "sid", "rep", "leader", "taken", "target", "size", "count", "n_lines", "host", "score", "_c", "hit", "canon", "w", "items", "level"]

#: Nulls in every column, empty and blank texts, repeated rows, ties, a long text.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away into the woods", "en", "a", 10),
    (1, "The quick brown fox jumps over the lazy dog and runs far away into the woods", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, "  \n\t ", "en", None, 5),
    (None, "a doc without number", "de", "b", 20),
    (5, "the quick brown fox jumps over the lazy dog and runs far away into the woods", "en", "b", 10),
    (6, "ÜBER alles 日本語 \U0001f600 token = \"abcdefghijklmnop\" deadbeefdeadbeef00", "de", "b", 7),
    (7, "word " * 60000, "en", "c", 300000),
    (8, "x", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING if c not in df.columns])


@pytest.fixture(scope="session")
def odd(spark):
    return with_clashes(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="session")
def none(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no tables here")
    return path
