"""What the operators of this subpackage share: scratch tables, shipped code, column checks."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 16 << 20
#: What a Python worker keeps from task to task, for one operator at a time.
KEPT: dict = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/gridprint"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, arrow_bytes: int = ARROW_BYTES) -> None:
    """Send this package's code to the Python workers, once per Spark context, and let Arrow batches end by size, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", arrow_bytes)
    sc = spark.sparkContext
    if getattr(sc, "_gridprint_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), "gridprint_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(target)
    sc._gridprint_shipped = True


def drop_kept() -> None:
    if KEPT:
        KEPT.clear()
        gc.collect()


def give_back() -> None:
    """Hand freed memory of this worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sparing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False):
    """A function for mapInArrow that leaves its worker small, since workers wait for the tasks of later stages: what others keep goes before it, what it frees after it."""

    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            drop_kept()
        try:
            yield from run(batches)
        finally:
            give_back()

    return spared


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """A number per row that is fixed once the frame is materialised; row identity where doc_id repeats or is null."""
    return df.withColumn(name, F.monotonically_increasing_id())


def rows_as_one(df: DataFrame) -> DataFrame:
    """All columns as one struct `row`, so that no name of theirs meets one of ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of the highest n, at most `limit`: whole frequency classes (sixteen per doubling of n), so no task or driver sorts them."""
    counts = materialise(counts, "counts")
    classes = counts.groupBy(F.floor(16 * F.log2("n")).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()
    total, least = 0, None
    for r in sorted(classes, key=lambda r: -r["c"]):
        total += r["k"]
        if total > limit:
            break
        least = r["c"]
    return counts.where(F.floor(16 * F.log2("n")) >= least) if least is not None else counts.limit(0)


def by_size(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `size` bytes together; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, until - at)
        at = until
