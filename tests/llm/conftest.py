import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs, with more columns if named."""

    def build(rows, **more):
        frame = spark.createDataFrame(
            [(i, t, "en", "s0", None if t is None else len(t)) for i, t in rows], DOCS
        )
        for name, value in more.items():
            frame = frame.withColumn(name, value)
        return frame

    return build
