import pytest

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: Nulls in every column, empty, blank and very long texts, repeated rows, ties.
ROWS = [
    (1, "Alpha beta gamma.\nShared line here now.\nanother one", "en", "a", 1.0),
    (2, "Alpha beta gamma.\nShared line here now.\nanother one", "en", "b", 1.0),
    (2, "Alpha beta gamma.\nShared line here now.\nanother one", "en", "b", 1.0),
    (3, None, "en", "a", None),
    (4, "", None, None, 2.0),
    (5, " \t\n ", "fr", "b", 2.0),
    (6, LONG, "en", "a", 3.0),
    (None, "x y z. Mail me@host.example.org or +1 (743) 555-3824", None, "c", 4.0),
    (8, "x y z. Mail me@host.example.org or +1 (743) 555-3824", "en", None, 4.0),
    (9, "é ü 日本 \U0001f600 4111 1111 1111 1111 at 10.0.0.255 and 300.1.1.1", "de", "c", 5.0),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with odd values, and extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, extra double")
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    for name in ("size", "part", "base", "h", "key", "node", "n", "slot", "bucket", "words", "line", "ids", "copies", "a", "b"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
