"""Contexts as a stream: postings are appended file by file, and weights are made anew from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridprint.operators import vocabulary as vo


def contexts(spark: SparkSession, path: str, schema: str, context_id: str, text: str) -> DataFrame:
    """A file source of Parquet contexts."""
    return spark.readStream.schema(schema).parquet(path).select(F.col(context_id).alias("context_id"), F.col(text).alias("text"))


def ingest(stream: DataFrame, postings: str, checkpoint: str, sizes: tuple[int, ...] = (1,)) -> StreamingQuery:
    """Append the distinct postings of new contexts; the checkpoint says which files are done."""
    return vo.postings(stream, sizes).writeStream.format("parquet").option("path", postings).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def weights(spark: SparkSession, postings: str, min_freq: int = 2) -> DataFrame:
    """The vocabulary and IDF of all that has come so far; they change with every context, so they aren't stored as a stream."""
    rows = spark.read.parquet(postings).distinct()
    n = rows.select("context_id").distinct().count()
    return vo.idf(vo.vocabulary(rows, min_freq), n)
