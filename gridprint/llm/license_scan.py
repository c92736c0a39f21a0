"""License scans by a positional rare-token index, in DataFrame functions only.

Templates are short fixed texts. Their content words form the licence
vocabulary. One pass over the documents keeps, per row, the positions of
vocabulary words; document frequencies of those words over the whole corpus
give the IDF weights. Each file's rarest licence words, those of highest IDF,
look up the template postings, and give candidate alignments (document position
minus template position). Only at these the file's other licence words are
intersected with the postings by relative position: an alignment is scored by the
IDF weight of all template words found at their places, and counts only if every
mandatory key word stands where the template has it.

Defined cases: null or empty text has no words, no labels and score 0; repeated
rows and null doc_id are scanned row by row; an empty table gives an empty
result; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridprint.llm.common import LOWER, UPPER, lower_ascii, materialise, with_row_id

#: The phrases that every scan counts, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, words of a template, and its mandatory key phrase.
TEMPLATES = [
    ("mit", "mit license", "mit license"),
    ("apache", "apache license", "apache license"),
    ("gpl", "general public license", "general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache", "spdx license identifier apache 2 0", "spdx license identifier apache"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("gpl", "spdx license identifier gpl", "spdx license identifier gpl"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source binary forms"),
    ("bsd", "bsd 3 clause license", "bsd 3 clause license"),
    ("mpl", "mozilla public license version 2 0", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "copy modify distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
]

#: Words that carry no licence evidence by themselves; not indexed.
STOP = "the of and to in is this that for with by on or a an as be are it from at not you any use can person".split()

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_SCORE = 0.6
#: Distinct words of a file that look up the index; the base phrases don't depend on them.
RARE_WORDS = 8


def template_rows() -> list[tuple[int, str, int, str, bool]]:
    """(template, label, position, word, mandatory) for every indexed word of every template."""
    out = []
    for t, (label, text, key) in enumerate(TEMPLATES):
        words, keys = text.split(), set(key.split())
        out += [(t, label, i, w, w in keys) for i, w in enumerate(words) if w not in STOP or (w in keys)]
    return out


def vocabulary() -> list[str]:
    return sorted({w for _, _, _, w, _ in template_rows() if w not in STOP})


def consecutive(hits: Column, phrase: str) -> Column:
    """Start positions of the phrase, from an array of {w, i} that holds all of the phrase's words."""
    words = phrase.split()
    n = len(words)

    def starts(_: Column, k: Column) -> Column:
        ok = F.lit(True)
        for j, w in enumerate(words):
            e = F.get(hits, k + j)
            ok = ok & (e["w"] == w) & (e["i"] == F.get(hits, k)["i"] + j)
        return F.when(ok, F.get(hits, k)["i"].cast("long"))

    return F.filter(F.transform(hits, starts), lambda x: x.isNotNull()) if n else F.array()


def scan(docs: DataFrame, min_score: float = MIN_SCORE, rare_words: int = RARE_WORDS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates per row of docs."""
    spark = docs.sparkSession
    vocab = vocabulary()
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD), F.lit(0))
    tokens = docs.select("doc_id", words.alias("words")).select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.filter(F.transform("words", lambda w, i: F.struct(F.when(w.isin(vocab), w).alias("w"), i.alias("i"))), lambda x: x["w"].isNotNull()).alias("hits"),
    )
    tokens = materialise(with_row_id(tokens), "license-hits")
    hit = tokens.where(F.size("hits") > 0)
    places = hit.select("rid", F.explode("hits").alias("h")).select("rid", F.col("h.w").alias("w"), F.col("h.i").alias("i"))
    df = places.groupBy("w").agg(F.count_distinct("rid").alias("df"))
    n = tokens.count()
    postings = spark.createDataFrame([r for r in template_rows() if r[3] not in STOP], "t int, label string, p int, w string, key boolean")
    weighed = (
        postings.join(df, "w", "left")
        .withColumn("idf", F.round(F.log(F.lit(n + 1) / (F.coalesce("df", F.lit(0)) + 0.5)), 6).cast("decimal(18,6)"))
    )
    per = W.partitionBy("t")
    index = materialise(weighed.select("t", "label", "p", "w", "key", "idf", F.sum("idf").over(per).alias("total"), F.sum(F.col("key").cast("int")).over(per).alias("n_key")).coalesce(1), "license-index")
    # at most as many words a file as the vocabulary has, with one IDF each
    idf = index.groupBy("w").agg(F.max("idf").alias("idf"))
    in_file = hit.select("rid", F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).join(F.broadcast(idf), "w")
    rare = in_file.withColumn("k", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("idf"), "w"))).where(F.col("k") <= rare_words).select("rid", "w")
    postings_of = lambda p: p.join(F.broadcast(index), "w").withColumn("at", F.col("i") - F.col("p"))  # noqa: E731  as many rows as the fixed templates have words
    candidates = postings_of(places.join(rare, ["rid", "w"], "left_semi")).select("rid", "t", "at").distinct()
    found = (
        postings_of(places.join(candidates.select("rid").distinct(), "rid", "left_semi")).join(candidates, ["rid", "t", "at"], "left_semi")
        .groupBy("rid", "t", "label", "at")
        .agg(F.sum("idf").alias("got"), F.max("total").alias("total"), F.sum(F.col("key").cast("int")).alias("keys"), F.max("n_key").alias("n_key"))
        .where(F.col("keys") == F.col("n_key"))
        .withColumn("score", F.round((F.col("got") / F.col("total")).cast("double"), 6))
        .where(F.col("score") >= min_score)
        .groupBy("rid").agg(F.collect_set("label").alias("method_labels"), F.max("score").alias("score"), F.countDistinct("t").alias("n_templates"))
    )
    base = {p: consecutive(F.col("hits"), p) for p in BASE_PHRASES}
    begin = F.flatten(F.array(*base.values()))
    labels = F.filter(F.array(*[F.when(F.size(base[p]) > 0, F.lit(k)) for p, k in BASE_PHRASES.items()]), lambda x: x.isNotNull())
    out = tokens.join(found, "rid", "left")
    return out.select(
        "doc_id", "n_words", F.size(begin).cast("long").alias("n_base"),
        F.array_min(begin).alias("first_word"), F.array_max(begin).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("method_labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_templates", F.lit(0)).cast("long").alias("n_templates"),
    )


def oracle_sql() -> str:
    """The same rows in DuckDB SQL."""
    rows = [r for r in template_rows() if r[3] not in STOP]
    values = ", ".join(f"({t}, '{label}', {p}, '{w}', {str(k).lower()})" for t, label, p, w, k in rows)
    vocab = ", ".join(f"'{w}'" for w in vocabulary())
    phrases = " UNION ALL ".join(
        f"SELECT a.doc_id, '{label}' AS label, a.i FROM hits a " + " ".join(f"JOIN hits h{j} ON h{j}.doc_id = a.doc_id AND h{j}.i = a.i + {j} AND h{j}.w = '{w}'" for j, w in enumerate(p.split()) if j) + f" WHERE a.w = '{p.split()[0]}'"
        for p, label in BASE_PHRASES.items()
    )
    return f"""
    WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
    toks AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM words),
    hits AS (SELECT * FROM toks WHERE w IN ({vocab})),
    dfs AS (SELECT w, count(DISTINCT doc_id) AS df FROM hits GROUP BY w),
    tpl(t, label, p, w, k) AS (VALUES {values}),
    idx AS (SELECT tpl.*, CAST(round(ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 0.5)), 6) AS DECIMAL(18,6)) AS idf FROM tpl LEFT JOIN dfs USING (w)),
    ranked AS (SELECT *, sum(idf) OVER (PARTITION BY t) AS total, sum(k::INT) OVER (PARTITION BY t) AS n_key FROM idx),
    mine AS (SELECT DISTINCT doc_id, w, idf FROM hits JOIN idx USING (w)),
    rare AS (SELECT doc_id, w FROM mine QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idf DESC, w) <= {RARE_WORDS}),
    cand AS (SELECT DISTINCT doc_id, t, i - p AS at FROM hits JOIN rare USING (doc_id, w) JOIN ranked USING (w)),
    found AS (SELECT doc_id, t, label, round((sum(idf)::DOUBLE / max(total)::DOUBLE), 6) AS score FROM hits JOIN ranked USING (w) JOIN cand USING (doc_id, t) WHERE cand.at = i - p
              GROUP BY doc_id, t, label, i - p HAVING sum(k::INT) = max(n_key)),
    good AS (SELECT doc_id, max(score) AS score, count(DISTINCT t) AS n_templates FROM found WHERE score >= {MIN_SCORE} GROUP BY doc_id),
    base AS ({phrases}),
    per AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
    every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM found WHERE score >= {MIN_SCORE}) GROUP BY doc_id)
    SELECT words.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_templates, 0)::BIGINT AS n_templates
    FROM words LEFT JOIN per USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN good USING (doc_id)"""

