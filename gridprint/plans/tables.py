"""Intermediate tables in the folder that all executors share, and code for their Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 16 << 20


def store(df: DataFrame, name: str) -> DataFrame:
    """Write and read back, so that later plans start from the table and lost executors cost no lineage."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/gridprint/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per Spark context, and let Arrow batches end by size, since rows may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # a union that is re-planned on the way may not have the partitions that it promised
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
