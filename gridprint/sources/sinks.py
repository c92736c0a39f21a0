"""Writers of artifacts. Tables are Parquet; texts for people are small and come from sorted, aggregated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocabulary(vocab: DataFrame, postings: DataFrame, path: str) -> None:
    """K1: the vocabulary as CSV, most frequent first, and the contexts of each phrase as JSON."""
    vocab.orderBy(F.desc("df"), "phrase").select("phrase", "df").write.mode("overwrite").csv(f"{path}/vocabulary", quoteAll=False, escape='"')
    own = postings.join(vocab.select("phrase"), "phrase", "left_semi").groupBy("phrase").agg(F.array_sort(F.collect_list("context_id")).alias("contexts"))
    own.write.mode("overwrite").json(f"{path}/contexts")


def matrix(tcm: DataFrame, path: str, idf: DataFrame | None = None) -> None:
    """K2: the term-context rows, its size and density as one JSON row, and the IDF weights if there are any."""
    tcm.write.mode("overwrite").parquet(f"{path}/matrix")
    tcm.agg(F.count(F.lit(1)).alias("nnz"), F.count_distinct("phrase").alias("n_phrases"), F.count_distinct("context_id").alias("n_contexts")).withColumn("density", F.col("nnz") / F.nullif(F.col("n_phrases") * F.col("n_contexts"), F.lit(0).cast("long"))).write.mode("overwrite").json(f"{path}/metadata")
    if idf is not None:
        idf.write.mode("overwrite").parquet(f"{path}/idf")


def coordinates(coords: DataFrame, path: str, continuous: bool = False) -> None:
    """K3: CSV (six decimals if continuous), JSON and statistics."""
    rows = coords.select("context_id", *[F.format_string("%.6f", F.col(c).cast("double")).alias(c) if continuous else F.col(c) for c in ("x", "y")])
    rows.write.mode("overwrite").csv(f"{path}/coordinates_csv", header=True)
    coords.select("context_id", "x", "y").write.mode("overwrite").json(f"{path}/coordinates_json")
    coords.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]).write.mode("overwrite").json(f"{path}/coordinate_stats")


def fingerprints(prints: DataFrame, entity: str, path: str, grid: int, encoding: str = "morton") -> None:
    """K4, K5: the cells, and a row that says how they are addressed."""
    prints.write.mode("overwrite").parquet(f"{path}/cells")
    prints.agg(F.count_distinct(entity).alias("n"), F.count(F.lit(1)).alias("nnz")).withColumns({"grid_size": F.lit(grid), "encoding": F.lit(encoding)}).write.mode("overwrite").json(f"{path}/metadata")


def results(ranked: DataFrame, path: str) -> None:
    """Ranked rows as JSON."""
    ranked.write.mode("overwrite").json(path)


def cache(prints: DataFrame, entity: str, path: str, grid: int) -> None:
    """K7: one JSON row per entity with the coordinates and values of its cells (cell = x * grid + y)."""
    cell = F.struct(F.array(F.floor(F.col("cell") / grid).cast("int"), (F.col("cell") % grid).cast("int")).alias("c"), F.col("value").alias("v"))
    rows = prints.groupBy(entity).agg(F.array_sort(F.collect_list(cell)).alias("z"))
    rows.select(entity, F.col("z.c").alias("coordinates"), F.col("z.v").alias("values")).write.mode("overwrite").json(path)


def dense(prints: DataFrame, entity: str, grid: int) -> DataFrame:
    """K8: (entity, vector): grid * grid numbers each."""
    m = prints.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(F.col("cell").cast("long"), "value"))).alias("m"))
    return m.select(entity, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(grid * grid - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def append_documents(contexts: DataFrame, vectors: DataFrame, path: str) -> None:
    """Documents with `title: text` split, and their vectors, appended to a table."""
    parts = F.split("text", ": ", 2)
    titled = F.contains("text", F.lit(": "))
    rows = contexts.select("context_id", F.when(titled, parts[0]).otherwise("").alias("title"), F.when(titled, F.get(parts, F.lit(1))).otherwise(F.col("text")).alias("text"))
    rows.join(vectors, "context_id").write.mode("append").parquet(path)


def append_triples(triples: DataFrame, path: str) -> None:
    """Appended as CSV."""
    triples.select("subject", "predicate", "object", F.col("chunk_id").alias("source_chunk_id")).write.mode("append").csv(path, header=True)


def batches(rows: DataFrame, path: str, size: int = 100) -> None:
    """Files of at most `size` records."""
    rows.write.mode("append").option("maxRecordsPerFile", size).json(path)


def graph(triples: DataFrame, path: str) -> None:
    """Nodes and edges as tables to load."""
    from gridprint.operators.graph import edges, nodes

    nodes(triples).write.mode("overwrite").parquet(f"{path}/nodes")
    edges(triples).write.mode("overwrite").parquet(f"{path}/edges")


def report(summary: DataFrame) -> str:
    """A Markdown table of a few aggregated rows."""
    rows = summary.collect()
    head = summary.columns
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)])
