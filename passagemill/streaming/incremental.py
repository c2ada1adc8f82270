"""The stateless operators over streams of documents, and exact copies dropped within a watermark.

Chunkers, parsers and token tables of one document need no other, so that the batch functions take a streaming
DataFrame as they are; this module adds the reader, the state and the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunk as ch

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read_documents(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come, with seen: when each batch read them."""
    raw = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return raw.withColumn("seen", F.current_timestamp())


def drop_copies(docs: DataFrame, within: str = "1 day") -> DataFrame:
    """Documents whose text did not come before within the watermark; a digest is held for each, no text. Null texts go."""
    keyed = docs.where("text is not null").withColumn("digest__", F.sha2("text", 256)).withWatermark("seen", within)
    return keyed.dropDuplicatesWithinWatermark(["digest__"]).drop("digest__")


def chunks(docs: DataFrame, chunker: str = "fixed", **how) -> DataFrame:
    """chunk() over a stream: no state."""
    return ch.chunk(docs, chunker, **how)


def write(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to a Parquet folder, exactly once with its checkpoint. checkpoint: a folder that all executors share."""
    sink = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (sink.trigger(availableNow=True) if once else sink).start()
