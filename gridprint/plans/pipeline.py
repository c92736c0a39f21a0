"""Index a corpus and answer queries, with every intermediate a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprint.operators import blocks as bl
from gridprint.operators import fingerprints as fp
from gridprint.operators import layout
from gridprint.operators import query as qu
from gridprint.operators import vocabulary as vo
from gridprint.plans.tables import store


@dataclass
class Index:
    vocabulary: DataFrame
    tcm: DataFrame
    idf: DataFrame
    coordinates: DataFrame
    phrases: DataFrame
    documents: DataFrame


@dataclass
class Pipeline:
    """Parameters of all steps, one value each."""

    grid: int = 64
    sizes: tuple[int, ...] = (1, 2)
    min_freq: int = 2
    reducer: str = "pca"
    sigma: float = 1.5
    top_percent: float = 0.10
    normalise: str = "none"
    weighting: str = "idf"
    spreading: int = 1
    decay: float = 0.5
    top_k: int = 10

    def index(self, contexts: DataFrame) -> Index:
        """contexts: (context_id, text), ids unique."""
        posts = vo.postings(contexts, self.sizes)
        posts = store(posts, "postings")
        idf = store(vo.idf(vo.vocabulary(posts, self.min_freq), contexts.count()), "idf")
        vocab = idf.select("phrase", "df")
        tcm = store(vo.term_context(posts, idf), "matrix")
        if self.reducer == "pca":
            coords = layout.spread_collisions(layout.scale_to_grid(layout.pca(layout.transpose_normalise(tcm)), self.grid), self.grid)
        elif self.reducer == "hash":
            coords = layout.hash_layout(contexts, self.grid)
        else:
            raise ValueError(f"unknown reducer {self.reducer!r}")
        coords = store(coords, "coordinates")
        prints = store(fp.phrase_fingerprints(fp.phrase_counts(tcm, fp.cells(coords))), "phrases")
        placed = bl.hashed(tcm.select("phrase", "context_id")).join(fp.cells(coords), "context_id")
        change = bl.on_grids(self.grid, self._sparse()) if self.top_percent < 1 else None
        kind = contexts.schema["context_id"].dataType.simpleString()
        documents = bl.documents(placed, contexts.select("context_id"), self.grid, bl.as_rows(change), f"context_id {kind}, cell long, value double", F.col("cell"), 1, True)
        if self.normalise != "none":
            documents = fp.normalise(documents, "context_id", self.normalise)
        return Index(vocab, tcm, idf, coords, prints, store(documents.where("value <> 0"), "documents"))

    def _sparse(self):
        share, sigma = self.top_percent, self.sigma
        return lambda g: fp.topological_all(fp.smooth(g, sigma), share)  # smoothing is linear: once per document instead of once per phrase

    def query(self, index: Index, queries: DataFrame) -> DataFrame:
        """queries (query_id, text) to (query_id, context_id, score, rank); unknown phrases stand for their nearest known ones."""
        own = queries.select(F.col("query_id").alias("context_id"), "text")
        found = None
        for n in self.sizes:
            part = vo.occurrences(own, n)
            found = part if found is None else found.unionByName(part)
        phrases = found.groupBy(F.col("context_id").alias("query_id"), "phrase").agg(F.count(F.lit(1)).alias("n"))
        phrases = store(phrases, "query-phrases")
        direct = vo.matched(phrases, index.vocabulary)
        weights = qu.weights(direct, index.idf, self.weighting)
        unknown = vo.missing(phrases, index.vocabulary)
        near = store(qu.expand_unknown(unknown.select(F.col("phrase").alias("term")), index.vocabulary, index.phrases, self.grid), "expansions")
        extra = unknown.join(near.withColumnRenamed("phrase", "to").withColumnRenamed("term", "phrase"), "phrase").select("query_id", F.col("to").alias("phrase"), "similarity").join(index.idf.select("phrase", "idf"), "phrase", "left")
        weights = weights.unionByName(extra.select("query_id", "phrase", (F.coalesce("idf", F.lit(1.0)) * F.col("similarity") ** 2 * qu.OOV_WEIGHT).alias("weight"))).groupBy("query_id", "phrase").agg(F.max("weight").alias("weight"))
        prints = store(fp.spread(qu.fingerprint(weights, index.phrases), "query_id", self.grid, self.spreading, self.decay), "queries")
        return qu.rank(prints, index.documents, self.top_k)
