"""Small questions to stored tables: point look-ups, counts, unions, readiness of steps, means of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def context_stats(tcm: DataFrame) -> DataFrame:
    """(context_id, nnz, total, mean) of the weights of each context."""
    return tcm.groupBy("context_id").agg(F.count(F.lit(1)).alias("nnz"), F.sum("weight").alias("total"), F.avg("weight").alias("mean"))


def phrase_union(*sides: DataFrame) -> DataFrame:
    """Distinct phrases of several sets, each row (phrase)."""
    out = sides[0].select("phrase")
    for s in sides[1:]:
        out = out.unionByName(s.select("phrase"))
    return out.distinct()


def lookup(table: DataFrame, column: str, value) -> DataFrame:
    """The rows with this value; the comparison reaches the scan."""
    return table.where(F.col(column) == F.lit(value))


def row_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of stored tables."""
    out = None
    for name, table in sorted(tables.items()):
        n = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def vector_size(table: DataFrame, column: str) -> DataFrame:
    """The length of the vectors, and whether all have it."""
    n = F.size(column)
    return table.agg(F.max(n).alias("size"), (F.max(n) == F.min(n)).alias("uniform"))


def ready_steps(steps: DataFrame, completed: DataFrame) -> DataFrame:
    """(step, ready): whether all that a step (step, depends_on) depends on is among the completed (step)."""
    missing = steps.select("step", F.explode("depends_on").alias("on")).join(completed.select(F.col("step").alias("on")), "on", "left_anti").select("step").distinct().withColumn("blocked", F.lit(True))
    return steps.select("step").join(missing, "step", "left").select("step", F.col("blocked").isNull().alias("ready"))


def orphans(folders: DataFrame, registered: DataFrame) -> DataFrame:
    """Folders (name) that no registered run (name) has."""
    return folders.select("name").distinct().join(registered.select("name"), "name", "left_anti")


def mean_vectors(words: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """(context_id, vector): mean of the vectors (word, vector) of a context's words (context_id, word), zeros if none is known."""
    known = words.join(vectors, "word").select("context_id", F.posexplode("vector").alias("i", "v"))
    mean = known.groupBy("context_id", "i").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("context_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector"))
    zeros = F.array_repeat(F.lit(0.0), size)
    return words.select("context_id").distinct().join(mean, "context_id", "left").select("context_id", F.coalesce("vector", zeros).alias("vector"))


def nudge(coords: DataFrame, targets: DataFrame, share: float = 0.1) -> DataFrame:
    """Contexts of wrong answers move by a share of the way to their target (context_id, tx, ty); others stay."""
    moved = coords.join(targets, "context_id", "left")
    to = lambda c, t: F.coalesce(F.col(c) + share * (F.col(t) - F.col(c)), F.col(c))
    return moved.select("context_id", to("x", "tx").alias("x"), to("y", "ty").alias("y"))


def random_contexts(ids: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """K contexts in a random order that a seed fixes."""
    order: Column = F.md5(F.concat_ws(":", F.lit(seed), F.col("context_id").cast("string")).cast("binary"))
    return ids.select("context_id", order.alias("h")).orderBy("h").limit(k).select("context_id")
