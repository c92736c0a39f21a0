"""Passage chunks, triples, their progress log, and the graph they make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from gridprint.functions import text as T

#: Words that link a sentence's first word with what follows them.
RULE_VERBS = ["is", "has", "was", "with", "of"]
TRIPLES = "chunk_id string, subject string, predicate string, object string, confidence double"


def chunk(passages: DataFrame, target: int = 1000, overlap: float = 0.15, smallest: int = 200, largest: int = 2000) -> DataFrame:
    """Passages (passage_idx, text) to chunks of whole sentences.

    A chunk is closed before the sentence that would make it longer than the target; the next one begins with the
    last sentences that fit into the overlap. A chunk under `smallest` tokens joins the one before if both stay under `largest`.
    """
    share = int(target * overlap)
    kind = Y.ArrayType(Y.StructType([Y.StructField("content", Y.StringType()), Y.StructField("overlap", Y.LongType())]))

    @F.pandas_udf(kind)
    def cut(column: pd.Series) -> pd.Series:
        return column.map(lambda parts: [{"content": c, "overlap": o} for c, o in chunks(list(parts), target, share, smallest, largest)])

    rows = passages.select("passage_idx", F.posexplode(cut(T.sentences(F.col("text")))).alias("chunk_index", "c"))
    return rows.select(F.concat(F.lit("doc_"), "passage_idx", F.lit("_chunk_"), "chunk_index").alias("chunk_id"), "passage_idx", "chunk_index", F.col("c.content").alias("content"), T.estimate_tokens(F.col("c.content")).alias("token_count"), F.col("c.overlap").alias("overlap_with_next"))


def chunks(sentences: list[str], target: int, share: int, smallest: int, largest: int) -> list[tuple[str, int]]:
    """(content, characters that the next chunk repeats)."""
    cost = [len(s) // 4 for s in sentences]
    groups: list[tuple[int, int, int]] = []  # first sentence, end, first sentence that the next one repeats
    start = 0
    for i, c in enumerate(cost):
        if i > start and sum(cost[start:i]) + c > target:
            back, used = i, 0
            while back > start and used + cost[back - 1] <= share:
                back -= 1
                used += cost[back]
            groups.append((start, i, back))
            start = back
    if start < len(sentences):
        groups.append((start, len(sentences), len(sentences)))
    out: list[tuple[str, int]] = []
    for a, b, back in groups:
        content, repeated = " ".join(sentences[a:b]), len(" ".join(sentences[back:b]))
        if out and len(content) // 4 < smallest and len(joined := f"{out[-1][0]} {content}") // 4 <= largest:
            out[-1] = joined, repeated
        else:
            out.append((content, repeated))
    return out


def parse_triples(replies: DataFrame) -> DataFrame:
    """(chunk_id, reply) of a model to triples: the JSON object in the reply, its rows of three parts or more, none blank."""
    parsed = replies.select("chunk_id", F.from_json(T.json_object(F.col("reply")), "triples array<array<string>>", {"mode": "PERMISSIVE"}).alias("j"))
    rows = parsed.select("chunk_id", F.explode("j.triples").alias("t")).where(F.size("t") >= 3)
    return clean_triples(rows.select("chunk_id", F.get("t", F.lit(0)).alias("subject"), F.get("t", F.lit(1)).alias("predicate"), F.get("t", F.lit(2)).alias("object"), F.lit(1.0).alias("confidence")))


def clean_triples(triples: DataFrame) -> DataFrame:
    """Parts trimmed, rows with a blank part dropped."""
    out = triples
    for c in ("subject", "predicate", "object"):
        out = out.withColumn(c, F.trim(c))
    return out.where("subject <> '' and predicate <> '' and object <> ''")


def rule_triples(chunks_: DataFrame) -> DataFrame:
    """G5 without a model: 'X is|has|was|with Y' inside a sentence, as (X, verb, Y)."""
    s = chunks_.select("chunk_id", F.explode(T.sentences(F.col("content"))).alias("s"))
    words = s.select("chunk_id", F.regexp_extract_all("s", F.lit(T.LETTERS), F.lit(0)).alias("w"))
    verbs = F.array(*map(F.lit, RULE_VERBS))
    # the first verb that has a word on either side
    at = F.array_position(F.transform(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))), lambda x: F.array_contains(verbs, x)), True).cast("int")
    told = words.withColumn("at", at).where("at > 0")
    return clean_triples(told.select("chunk_id", F.get("w", F.lit(0)).alias("subject"), F.get("w", F.col("at")).alias("predicate"), F.get("w", F.col("at") + 1).alias("object"), F.lit(1.0).alias("confidence")))


def extract(chunks_: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """G5 with a model: client(prompt) -> reply, called where the chunks are; failures become an empty reply."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies = []
            for content in b["content"]:
                try:
                    replies.append(client(prompt(content)))
                except Exception:  # noqa: BLE001  a failed call is logged as a failed chunk by its empty reply
                    replies.append("")
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "reply": replies})

    return parse_triples(chunks_.select("chunk_id", "content").mapInPandas(run, "chunk_id string, reply string"))


def prompt(content: str) -> str:
    return f'List the facts of this passage as JSON: {{"triples": [["subject", "predicate", "object"]]}}\n\n{content}'


def log_summary(log: DataFrame) -> DataFrame:
    """Log lines by status."""
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("triple_count", F.lit(0))).alias("triples"))


def latest_status(log: DataFrame) -> DataFrame:
    """Each chunk's last state."""
    return log.groupBy("chunk_id").agg(F.max_by("status", F.struct("at", "ord")).alias("status"))


def unfinished(chunks_: DataFrame, log: DataFrame) -> DataFrame:
    """Chunks that haven't completed or failed."""
    return chunks_.join(log.where("status in ('completed', 'failed')").select("chunk_id").distinct(), "chunk_id", "left_anti")


def nodes(triples: DataFrame) -> DataFrame:
    """Distinct subjects and objects."""
    return triples.select(F.explode(F.array("subject", "object")).alias("node")).distinct()


def edges(triples: DataFrame) -> DataFrame:
    return triples.select("subject", "predicate", "object").distinct()


def graph_counts(triples: DataFrame) -> DataFrame:
    """A29."""
    return triples.agg(F.count_distinct(F.struct("subject", "predicate", "object")).alias("n_edges"), F.lit(1).alias("k")).join(nodes(triples).agg(F.count(F.lit(1)).alias("n_nodes"), F.lit(1).alias("k")), "k").select("n_nodes", "n_edges")


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Passages, white-space words, characters and their means, 0 for an empty corpus."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    chars = F.length(F.coalesce(F.col(text), F.lit("")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return docs.agg(F.count(F.lit(1)).alias("n"), zero(F.sum(words)).alias("n_words"), zero(F.sum(chars)).alias("n_chars"), F.coalesce(F.avg(words), F.lit(0.0)).alias("mean_words"), F.coalesce(F.avg(chars), F.lit(0.0)).alias("mean_chars"))


def dedup_paragraphs(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct (keys); where a paragraph was first seen is its number."""
    return rows.groupBy(*keys).agg(F.min(order).alias("paragraph_id"), F.count(F.lit(1)).alias("n"))


def latest(runs: DataFrame, order: str) -> DataFrame:
    """The newest run."""
    return runs.orderBy(F.desc(order)).limit(1)


def count_nodes(c: Column) -> Column:
    return F.count_distinct(c)
