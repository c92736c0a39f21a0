"""Similarity measures on dense arrays and on long-form vectors, k-NN, and pair reports."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a block of queries that is broadcast to all rows.
BLOCK_BYTES = 64 << 20


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def _least(x: Column, y: Column) -> Column:
    return F.least(x, y)


def _greatest(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def _double(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _fold(_double(a), _double(b), lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """V1: 0 if either norm is 0."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """V8: the distance."""
    return F.sqrt(_fold(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """V8: 1 / distance, infinite for equal vectors."""
    d = euclidean(a, b)
    return F.when(d == 0, F.lit(float("inf"))).otherwise(1 / F.nullif(d, F.lit(0.0)))


def jaccard_weighted(a: Column, b: Column) -> Column:
    """V4: sum of minima by sum of maxima."""
    x, y = _double(a), _double(b)
    return F.coalesce(_fold(x, y, _least) / F.nullif(_fold(x, y, _greatest), F.lit(0.0)), F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    """V6: twice the sum of minima by the sum of both."""
    x, y = _double(a), _double(b)
    return F.coalesce(2 * _fold(x, y, _least) / F.nullif(_fold(x, y, lambda p, q: p + q), F.lit(0.0)), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """V7: share of equal cells, zeros included."""
    return _fold(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)) / F.size(a)


def jaccard_set(a: Column, b: Column) -> Column:
    """U4, V5: of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def active_cells(a: Column) -> Column:
    """Positions of the positive cells."""
    return F.filter(F.transform(a, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """V9: 1 - edits / cells, on the cells written as digits 0 and 1."""
    text = lambda v: F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return 1 - F.levenshtein(text(a), text(b)) / F.size(a)


MEASURES = {"cosine": cosine, "l2": euclidean, "ip": dot}


def against(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row meets the queries, which go to all rows in blocks of about BLOCK_BYTES."""
    size = queries.agg(F.sum(F.size("q_vector") * 8)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    if blocks <= 1:
        return rows.join(F.broadcast(queries))
    parts = [rows.join(F.broadcast(queries.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == i))) for i in range(blocks)]
    return functools.reduce(DataFrame.unionByName, parts)


def knn(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Exact nearest rows, without the query itself: (q_id, id, _distance, rank); lower distances are nearer."""
    value = MEASURES[metric](F.col("q_vector"), F.col("vector"))
    distance = {"cosine": 1 - value, "l2": value, "ip": -value}[metric]
    met = against(queries, rows).where("q_id <> id").select("q_id", "id", F.round(distance, 6).alias("_distance"))
    return top_k(met, "q_id", [F.asc("_distance"), F.asc("id")], k)


def top_k(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """rows with their rank in the group, the first k."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def long_cosine(queries: DataFrame, rows: DataFrame, entity: str, key: str, value: str) -> DataFrame:
    """Cosine of every query entity with every other that shares a key: (q, entity, similarity). Frequent keys meet few queries, never each other."""
    norm = rows.groupBy(entity).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    q = rows.join(queries.select(entity).distinct(), entity, "left_semi").select(F.col(entity).alias("q"), key, F.col(value).alias("qv"))
    shared = q.join(rows, key).where(F.col("q") != F.col(entity)).groupBy("q", entity).agg(F.sum(F.col("qv") * F.col(value)).alias("dot"))
    both = shared.join(norm, entity).join(norm.select(F.col(entity).alias("q"), F.col("norm").alias("q_norm")), "q")
    return both.select("q", entity, F.round(F.coalesce(F.col("dot") / F.nullif(F.col("norm") * F.col("q_norm"), F.lit(0.0)), F.lit(0.0)), 6).alias("similarity"))


def shared_terms(queries: DataFrame, rows: DataFrame, entity: str, k: int) -> DataFrame:
    """For query entities, the other entities' shared phrases by the smaller weight, the first k a pair."""
    q = rows.join(queries.select(entity).distinct(), entity, "left_semi").select(F.col(entity).alias("q"), "phrase", F.col("weight").alias("qw"))
    both = q.join(rows, "phrase").where(F.col("q") != F.col(entity)).select("q", entity, "phrase", F.round(F.least("qw", "weight"), 6).alias("shared"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("q", entity).orderBy(F.desc("shared"), "phrase"))).where(F.col("rank") <= k)


def pair_stats(a: Column, b: Column, threshold: float = 0.5) -> list[Column]:
    """What a dashboard of two dense fingerprints shows."""
    x, y = _double(a), _double(b)
    count = lambda v, f: F.size(F.filter(v, f)).cast("long")
    low = F.zip_with(x, y, _least)
    diff = F.zip_with(x, y, lambda p, q: p - q)
    return [
        count(x, lambda v: v > 0).alias("active_a"), count(y, lambda v: v > 0).alias("active_b"), count(x, lambda v: v > threshold).alias("strong_a"), count(y, lambda v: v > threshold).alias("strong_b"),
        F.round(F.array_max(x), 6).alias("max_a"), F.round(F.array_max(y), 6).alias("max_b"), count(low, lambda v: v > 0).alias("overlap"), F.round(F.array_max(low), 6).alias("max_overlap"),
        F.round(F.array_min(diff), 6).alias("min_diff"), F.round(F.array_max(diff), 6).alias("max_diff"), F.round(euclidean(a, b), 6).alias("euclidean"), F.round(cosine(a, b), 6).alias("cosine"),
    ]


def separation(pairs: DataFrame) -> DataFrame:
    """Means over pairs (same, similarity), and whether they are apart by more than 0.1."""
    out = pairs.agg(F.avg(F.when(F.col("same"), F.col("similarity"))).alias("mean_same"), F.avg(F.when(~F.col("same"), F.col("similarity"))).alias("mean_different"))
    return out.withColumn("separation", F.col("mean_same") - F.col("mean_different")).withColumn("good", F.col("separation") > 0.1)


def context_graph(queries: DataFrame, tcm: DataFrame, scale: float = 20.0, least: float = 0.1) -> DataFrame:
    """Edges (src, dst, weight) of query contexts whose dot product by `scale` exceeds `least`."""
    q = tcm.join(queries.select("context_id").distinct(), "context_id", "left_semi").select(F.col("context_id").alias("src"), "phrase", F.col("weight").alias("qw"))
    met = q.join(tcm, "phrase").where(F.col("src") != F.col("context_id")).groupBy("src", F.col("context_id").alias("dst")).agg(F.sum(F.col("qw") * F.col("weight")).alias("dot"))
    return met.select("src", "dst", F.round(F.col("dot") / scale, 6).alias("weight")).where(F.col("weight") > least)
