"""Fixtures shared by the tests of the operators; modules import the ones they use."""

import pytest
from pyspark.sql import functions as F

# Texts that every operator must take: null, empty, blank, very long, repeated, without a letter, odd characters.
TEXTS = [
    (1, "The cat sat on the mat, and the dog sat by the door of the house."), (2, None), (3, ""), (4, " \t\n "),
    (5, "x" * 70_000), (6, "word " * 30_000), (7, "The cat sat on the mat, and the dog sat by the door of the house."),
    (7, "The cat sat on the mat, and the dog sat by the door of the house."), (8, "12 34 !!"), (9, "é中😀 \x00 <|endoftext|> don't"),
    (None, "no id"), (10, "a  b\n\nc"), (11, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of doc_id and text with extra columns whose names the operators use themselves."""
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for name in ("row", "file", "position", "digest", "part", "bin", "score", "fingerprint", "keeper", "n", "label", "quality",
                 "start", "ids", "_file", "_position", "missing"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows.withColumn("lang", F.when(F.col("doc_id") < 8, "en").otherwise("xx")).withColumn("source", F.lit("s"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
