import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from corpus_tables import table  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with the names that operators
    use themselves."""
    long = " ".join(f"word{i % 997} line{i}" for i in range(20_000))
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "x y z", "s"), (4, long, "t"), (5, " \n\t ", "t"), (6, "a b c", "t"), (7, "é日本 ▁   x\x00y", None), (7, "other", "t")]
    df = table(spark, rows)
    for name in ("_h1", "_row", "host", "gone", "kept", "size", "hash", "copies", "_n", "_id", "fp", "ids", "_pii", "_pii_made", "key", "shard", "slot", "range", "unit", "blob", "run", "halo", "n_words", "target", "threshold", "_extra0"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
