import pytest
from pyspark.sql import functions as F, types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark):
    """docs([(id, text), ...]) -> documents with extra columns whose names clash with those the operators use."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, lang, source, len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.withColumns({"ID": F.lit(1), "copy": F.lit(2), "shard": F.lit("x"), "n": F.lit(3), "digest": F.lit(4), "bucket": F.lit(5), "rank": F.lit(6)})

    return make


LONG = "word " * 40_000
EDGES = [(1, "a b c d"), (2, None), (None, "no id here"), (3, ""), (4, "a b c d"), (4, "a b c d"), (5, LONG), (6, LONG), (7, "!!! ???"), (None, None), (8, "x" * 50_000)]
