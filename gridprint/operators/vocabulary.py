"""Phrases, postings, vocabulary, IDF weights and the term-context table, all in long form.

postings(phrase, context_id) is the base table; a matrix is rows (phrase, context_id, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridprint.functions import text as T


def contexts(df: DataFrame, context_id: str, text: str, order: str | None = None) -> DataFrame:
    """(context_id, text), of repeated ids the last by `order`."""
    if order is None:
        return df.select(F.col(context_id).alias("context_id"), F.col(text).alias("text"))
    return df.groupBy(F.col(context_id).alias("context_id")).agg(F.max_by(text, order).alias("text"))


def content_words(docs: DataFrame, min_length: int = 3) -> DataFrame:
    """(context_id, words): an array of the words, generic ones null, so that neighbours stay neighbours."""
    words = T.tokens(F.col("text"))
    return docs.select("context_id", F.transform(words, lambda w: F.when(~T.is_generic(w, min_length), w)).alias("words"))


def runs(n: int) -> Column:
    """All runs of n content words in the column `words`."""
    words = F.col("words")

    def run(_: Column, i: Column) -> Column:
        parts = [x for k in range(n) for x in ([F.lit(" ")] if k else []) + [F.get(words, i + k)]]
        return F.concat(*parts)  # null beyond the end and next to a generic word

    return F.filter(F.transform(words, run), lambda p: p.isNotNull())


def occurrences(docs: DataFrame, n: int = 1, min_length: int = 3) -> DataFrame:
    """(context_id, phrase) for every run of n words none of which is generic."""
    words = content_words(docs, min_length)
    return words.select("context_id", F.explode(runs(n)).alias("phrase"))


def postings(docs: DataFrame, sizes: tuple[int, ...] = (1,), min_length: int = 3) -> DataFrame:
    """A1, A5: distinct (phrase, context_id). Distinct inside each text first, so little is left to shuffle."""
    words = content_words(docs, min_length)
    parts = [runs(n) for n in sizes]
    out = words.select("context_id", F.explode(F.array_distinct(F.concat(*parts))).alias("phrase"))
    return out.select("phrase", "context_id")


def vocabulary(posts: DataFrame, min_freq: int = 2, keep: list[str] | None = None) -> DataFrame:
    """(phrase, df) with a document frequency of min_freq or more, or in a list of phrases to keep. postings are distinct."""
    counted = posts.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    wanted = F.col("df") >= min_freq
    return counted.where(wanted | F.col("phrase").isin(keep) if keep else wanted)


def idf(vocab: DataFrame, n_contexts: int, smooth: bool = True) -> DataFrame:
    """A3 ln(N / (df + 1)), which may be 0 or less, or A4 ln(N / df), ln N for df 0."""
    if smooth:
        w = F.log(F.lit(float(n_contexts)) / (F.col("df") + 1))
    else:
        w = F.when(F.col("df") > 0, F.log(F.lit(float(n_contexts)) / F.col("df"))).otherwise(F.log(F.lit(float(n_contexts))))
    return vocab.select("phrase", "df", w.alias("idf"))


def term_context(posts: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(phrase, context_id, weight); weight 1 without weights, else the phrase's IDF; other phrases are left out."""
    if weights is None:
        return posts.withColumn("weight", F.lit(1.0))
    return posts.join(weights.select("phrase", F.col("idf").alias("weight")), "phrase").select("phrase", "context_id", "weight")


def phrase_contexts(vocab: DataFrame, posts: DataFrame) -> DataFrame:
    """Every vocabulary phrase with its sorted contexts, none as an empty array (for export)."""
    own = posts.groupBy("phrase").agg(F.array_sort(F.collect_list("context_id")).alias("contexts"))
    return vocab.join(own, "phrase", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast(own.schema["contexts"].dataType)))


def matrix_density(tcm: DataFrame, n_contexts: int) -> DataFrame:
    """One row: nnz, phrases, contexts, density."""
    return tcm.agg(F.count(F.lit(1)).alias("nnz"), F.count_distinct("phrase").alias("n_phrases")).select("nnz", "n_phrases", F.lit(n_contexts).cast("long").alias("n_contexts"), (F.col("nnz") / F.nullif(F.col("n_phrases") * F.lit(n_contexts), F.lit(0).cast("long"))).alias("density"))


def length_histogram(vocab: DataFrame) -> DataFrame:
    """Phrases, share in percent and mean frequency by number of words."""
    by = vocab.groupBy(F.size(F.split("phrase", " ")).alias("n_words")).agg(F.count(F.lit(1)).alias("n_phrases"), F.sum("df").alias("total"), F.avg("df").alias("mean_df"))
    return by.withColumn("percent", 100.0 * F.col("n_phrases") / F.sum("n_phrases").over(W.partitionBy()))


def matched(phrases: DataFrame, vocab: DataFrame) -> DataFrame:
    """The phrases that the vocabulary has."""
    return phrases.join(vocab.select("phrase"), "phrase", "left_semi")


def missing(phrases: DataFrame, vocab: DataFrame) -> DataFrame:
    """The phrases that it lacks."""
    return phrases.join(vocab.select("phrase"), "phrase", "left_anti")


def word_frequency(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(context_id, word, n) of the given words, whole words whatever the case."""
    return docs.select("context_id", F.explode(T.tokens(F.col("text"))).alias("word")).join(words.select("word").distinct(), "word").groupBy("context_id", "word").agg(F.count(F.lit(1)).alias("n"))


def synonyms(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word, standard) with a table (word, lemma); words without an entry stand for themselves."""
    return words.join(table, "word", "left").withColumn("standard", F.coalesce("lemma", "word")).drop("lemma")


def bag_of_words(posts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(context_id, n, bag) with the sorted vocabulary phrases of each context."""
    return matched(posts, vocab).groupBy("context_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("phrase")).alias("bag"))


def weighted_sum(value: Column) -> Column:
    """Sums that results are compared by: rounded, so the order of addition doesn't show."""
    return F.round(F.sum(value), 6)
