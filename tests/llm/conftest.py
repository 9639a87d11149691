import pytest
from pyspark.sql import functions as F

#: Rows that every operator has to stand: null and repeated ids, null, empty and blank texts, one very long text.
ODD = [
    (None, "A text without an id. " * 8),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "123 456 !!"),
    (6, "The quick brown fox jumps over the lazy dog near the river bank. " * 4),
    (6, "The quick brown fox jumps over the lazy dog near the river bank. " * 4),
    (7, "The quick brown fox jumps over the lazy dog near the river bank. " * 4),
    (8, " ".join(f"word{i} and{i % 7}" for i in range(60_000))),
    (9, "naïve café 日本語 😀 ünïcode " * 5),
    (10, "\x00�￿ odd marks"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names the operators also use."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    clash = "bucket key doc fp rep lang n at label entry piece guest shard page source n_chars component_id node hi lo".split()
    return rows.select("*", *[F.lit("x").alias(c) for c in clash]).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
