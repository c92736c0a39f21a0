"""Exact deduplication as a stateful stream, in DataFrame functions only.

A narrow feed (digest, identifier, content locator; no text) is appended to the
state folder and streamed into an aggregation whose state lives in RocksDB on
disk, keyed by digest, without watermark and so without expiry. For each digest
the state retains how many rows it has seen and the largest row with its locator,
the file that the row was read from. A later call with the same folder goes on
where the last one ended: its rows meet all that came before. Groups of two or
more are hits, and their full texts are compared with the retained one: texts of
this call come from its rows, retained texts of earlier calls from the files that
their locators name, and no others. Large groups are compared in salted parts,
each with a copy of the retained text. Should a digest ever join different texts,
the rows of this call are grouped by their whole text.

Defined cases: texts are equal when identical after lower-casing A-Z; null
counts as empty; of equal texts the largest doc_id stays, and of rows that
repeat it the last one read; null doc_id is smaller than any; an empty table
gives an empty result; further columns are ignored. A retained row of an earlier
call whose text is not in a Parquet file any more is compared by its SHA-256 only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridprint.llm.common import lower_ascii, materialise, rows_as_one, scratch_path, with_row_id

#: Feed bytes that one micro-batch takes at most, and rows that one retained text is compared with in one place.
BATCH_BYTES = 16 << 30
HOT = 2_000
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # a state of many small stores would reserve megabytes in each
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: str = "text") -> Column:
    return lower_ascii(F.coalesce(F.col(text), F.lit("")))


def sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def retained(feed: str, schema: StructType, state: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Stream what is new in the feed's folder through the keyed state: digest, n, keep {doc_id, call, rid, locator} of every digest so far."""
    spark = SparkSession.active()
    out = f"{state}/updates"
    stream = (
        spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(feed)
        .groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "call", "rid", "locator")).alias("keep"))
    )

    def save(batch: DataFrame, number: int) -> None:  # a batch that is run again replaces its own updates
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _conf(spark, STATE_CONF):
        query = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    if query.exception():
        raise query.exception()
    updates = spark.read.schema(stream.schema).parquet(f"{out}/*")
    return updates.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("s")).select("digest", "s.n", "s.keep")


def earlier_texts(spark: SparkSession, hits: DataFrame, call: int, digest: Callable[[Column], Column]) -> DataFrame | None:
    """(digest, n, norm) of the retained rows of earlier calls among hits, from the files that hold them."""
    old = hits.where(F.col("keep.call") < call).select("digest", "n", F.col("keep.doc_id").alias("doc_id"), F.col("keep.locator").alias("locator")).distinct()
    files = [r["locator"] for r in old.where("locator <> ''").select("locator").distinct().collect()]  # names of input files
    if not files:
        return None
    rows = spark.read.parquet(*files).select("doc_id", normalised().alias("norm")).withColumn("digest", digest(sha(F.col("norm"))))
    return rows.alias("w").join(old.alias("h"), F.col("w.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("w.digest") == F.col("h.digest"))).select("h.digest", "h.n", "w.norm").dropDuplicates(["digest"])


def groups(docs: DataFrame, digest: Callable[[Column], Column] = lambda s: s, batch_bytes: int = BATCH_BYTES, hot: int = HOT, state: str | None = None) -> DataFrame:
    """doc_id, rid, sha, keep_id, group_size, kept per row. `digest` shortens the SHA-256 (tests make it collide); `state` is a folder that keeps what earlier calls have seen."""
    spark = docs.sparkSession
    state = state or scratch_path(spark, "dedup-state")
    whole = docs.select("doc_id", normalised().alias("norm")).withColumn("sha", sha(F.col("norm")))
    own = materialise(with_row_id(whole.select("doc_id", "sha", digest(F.col("sha")).alias("digest"), F.input_file_name().alias("locator"))), "dedup-feed")
    if own.isEmpty():
        return own.select("doc_id", "rid", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    feed = f"{state}/feed"
    try:
        call = 1 + (spark.read.parquet(feed).agg(F.max("call")).first()[0] or 0)
    except AnalysisException:  # no feed yet
        call = 1
    narrow = own.select("digest", "doc_id", F.lit(call).cast("long").alias("call"), "rid", "locator")
    narrow.write.mode("append").parquet(feed)
    so_far = materialise(retained(feed, narrow.schema, state, batch_bytes), "dedup-retained")
    seen = own.join(so_far, "digest").select("doc_id", "rid", "sha", "digest", "n", "keep", ((F.col("keep.call") == call) & (F.col("keep.rid") == F.col("rid"))).alias("kept"))
    hits = seen.where("n > 1")
    wanted = hits.groupBy("doc_id", "sha").agg(F.max("rid").alias("rid"), F.max("digest").alias("digest"), F.max("n").alias("n"), F.max("kept").alias("is_keep"))
    texts = whole.alias("w").join(wanted.alias("h"), F.col("w.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("w.sha") == F.col("h.sha")))
    texts = materialise(texts.select("h.digest", "h.n", "h.rid", "h.is_keep", "w.norm"), "dedup-hits")
    parts = (F.col("n") / hot).cast("int")
    known = texts.where("is_keep").select("digest", "n", "norm")
    if call > 1 and (older := earlier_texts(spark, hits, call, digest)) is not None:
        known = known.unionByName(older)
    keepers = known.select("digest", F.explode(F.sequence(F.lit(0), parts)).alias("part"), F.col("norm").alias("keep_norm"))
    members = texts.withColumn("part", F.pmod(F.xxhash64("rid"), parts + 1).cast("int"))
    differs = members.join(keepers, ["digest", "part"]).where(F.col("norm") != F.col("keep_norm")).select("digest").distinct()
    same = seen.select("doc_id", "rid", "sha", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), "kept")
    differs = materialise(differs, "dedup-differs")
    if differs.isEmpty():
        return same.drop("digest")
    # a digest of different texts: its rows by whole text
    clash = own.join(differs, "digest", "left_semi").select("rid", "doc_id", "sha")
    full = whole.select("doc_id", "sha", "norm").alias("w").join(clash.alias("c"), F.col("w.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("w.sha") == F.col("c.sha"))).select("c.rid", "c.doc_id", "c.sha", "w.norm").dropDuplicates(["rid", "norm"])
    by_text = full.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("k"))
    apart = full.join(by_text, "norm").select("doc_id", "rid", "sha", F.col("k.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("k.rid")).alias("kept"))
    return same.join(differs, "digest", "left_anti").drop("digest").unionByName(apart)


def report(docs: DataFrame, state: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; with a state folder, among all documents of the calls so far."""
    return groups(docs, state=state).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def distinct_texts(docs: DataFrame, state: str | None = None) -> DataFrame:
    """The rows of docs, all columns, of which groups() keeps one a text."""
    kept = groups(docs, state=state).where("kept").select(F.col("doc_id").alias("id"), "sha")
    rows = rows_as_one(docs).withColumn("own_sha", sha(normalised("row.text")))
    out = rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha")))
    return out.dropDuplicates(["id", "sha"]).select("row.*")


def oracle_sql() -> str:
    return """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
    g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)"""
