import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside or return.
    T.StructField("spans", T.StringType()), T.StructField("node", T.StringType()), T.StructField("dropped", T.LongType()), T.StructField("row_", T.LongType()),
])


@pytest.fixture(scope="session")
def make_documents(spark):
    def make(rows):
        """Documents of (doc_id, text) pairs with extra, clashing columns."""
        full = [(i, t, "en" if (i or 0) % 3 else None, None if (i or 0) % 5 == 0 else f"src{(i or 0) % 4}", None, "s", None, 7, 1) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and unusual texts."""
    return [
        (1, None), (2, ""), (3, "   "), (4, "\n\n"), (5, "word"), (5, "word"), (None, "a null id"), (None, None), (6, "x" * 200_000),
        (7, "one two three " * 20_000), (8, "É ﬁ ① 日本語 🙂 ▁ \x00 \t\r\n z"), (9, "<|endoftext|> <s> </s> <0x0A>"), (10, "word"), (11, "a\n" * 5000),
    ]


@pytest.fixture(scope="session")
def some_texts():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    return list(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
