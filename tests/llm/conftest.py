import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use for their own columns.
    T.StructField("row", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("copies", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("kept", T.StringType()),
])
BASE = " ".join(f"wort{i}" for i in range(120))
NEAR = BASE.replace("wort60 ", "other ")
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, a repeated row, short texts, one very long."""
    return [
        (1, BASE), (2, BASE), (3, NEAR), (4, None), (5, ""), (6, " \n\t "), (7, "One two"), (8, "one TWO"), (9, LONG), (10, LONG + " end"),
        (11, "Ärger im Café, 100 % sicher. mail a.b@c.de"), (11, "Ärger im Café, 100 % sicher. mail a.b@c.de"), (None, BASE), (None, "no id here"),
        (14, "one two three four five six seven eight nine ten"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(i, t, None if i == 3 else "en", None if i == 5 else f"src{(i or 0) % 3}", None, "r", "d", "c", "s", "k") for i, t in odd_rows]
    df = spark.createDataFrame(rows, DOCS)
    folder = spark.conf.get("spark.sql.warehouse.dir") + "/odd_docs"
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(DOCS).parquet(folder)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
