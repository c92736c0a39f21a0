"""One query per operator over the supplied tables, and the SQL that gives the same rows.

Contexts are `documents`, queries are the texts of `benchmark`, dense vectors are
`embeddings`. Searches take the rows whose id is divisible by 50 as queries and
meet all rows. Contexts are laid out by a fixed rule, so that SQL can repeat it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridprint.functions import grid as G
from gridprint.functions import text as T
from gridprint.operators import blocks as bl
from gridprint.operators import evaluation as ev
from gridprint.operators import fingerprints as fp
from gridprint.operators import graph, layout
from gridprint.operators import lookup as lo
from gridprint.operators import pairs as pr
from gridprint.operators import query as qu
from gridprint.operators import similarity as sim
from gridprint.operators import vocabulary as vo
from gridprint.plans import sql as S
from gridprint.plans.tables import store

GRID = S.GRID
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d) -> DataFrame:
    return vo.contexts(read(spark, d, "documents"), "doc_id", "text")


def r6(c):
    return F.round(c, 6)


# text

@query("SELECT conv_id AS context_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def corpus_scan_dedup(spark, d):
    return vo.contexts(read(spark, d, "conversations"), "conv_id", "text", "turn")


@query(r"SELECT doc_id, CASE WHEN regexp_matches(t, '[\x{0600}-\x{06FF}]') THEN CASE WHEN regexp_matches(t, '[پچژگ]') THEN 'fa' ELSE 'ar' END ELSE 'en' END AS language FROM (SELECT doc_id, CASE lang WHEN 'fr' THEN 'كتاب ' || text WHEN 'de' THEN text || ' پنج' ELSE text END AS t FROM documents)")
def lang_detect(spark, d):
    t = F.when(F.col("lang") == "fr", F.concat(F.lit("كتاب "), "text")).when(F.col("lang") == "de", F.concat("text", F.lit(" پنج"))).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", T.detect_language(t).alias("language"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_extract(t, '(?s)^(.*[\x{0600}-\x{06FF}])?(.*)$', 1), '^[\s,"'']+|[\s,"'']+$', '', 'g') AS ar, regexp_replace(regexp_extract(t, '(?s)^(.*[\x{0600}-\x{06FF}])?(.*)$', 2), '^[\s,"'']+|[\s,"'']+$', '', 'g') AS en FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'قال هذا, كتاب, "' || text || '"' ELSE text END AS t FROM conversations)""")
def split_bilingual(spark, d):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('قال هذا, كتاب, "'), "text", F.lit('"'))).otherwise(F.col("text"))
    ar, en = T.split_bilingual(t)
    return read(spark, d, "conversations").select("conv_id", "turn", ar.alias("ar"), en.alias("en"))


@query(r"SELECT page_id, regexp_replace(replace(url, '.', '-'), '\b([a-zA-Z]+)-([a-zA-Z]+)\b', '\1 \2', 'g') AS text FROM pages")
def hyphen_normalize(spark, d):
    return read(spark, d, "pages").select("page_id", T.normalize_hyphens(F.replace("url", F.lit("."), F.lit("-"))).alias("text"))


@query(f"SELECT conv_id, turn, translate('إِنَّ ٱلْقِيَامَةَ گۀ ' || text, '{T.lists.ARABIC_FOLD_FROM}', '{T.lists.ARABIC_FOLD_TO}') AS folded FROM conversations")
def arabic_fold(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.fold_arabic(F.concat(F.lit("إِنَّ ٱلْقِيَامَةَ گۀ "), "text")).alias("folded"))


@query(f"WITH {S.TOK}, g AS (SELECT context_id, 1 AS n, w AS p FROM tok UNION ALL SELECT a.context_id, 2, a.w || ' ' || b.w FROM tok a JOIN tok b ON a.context_id = b.context_id AND b.i = a.i + 1 UNION ALL SELECT a.context_id, 3, a.w || ' ' || b.w || ' ' || c.w FROM tok a JOIN tok b ON a.context_id = b.context_id AND b.i = a.i + 1 JOIN tok c ON a.context_id = c.context_id AND c.i = a.i + 2) SELECT context_id, n, count(*) AS n_runs, count(DISTINCT p) AS n_distinct FROM g GROUP BY context_id, n")
def ngrams(spark, d):
    w = docs(spark, d).select("context_id", T.tokens(F.col("text")).alias("w"))
    rows = w.select("context_id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), T.ngrams(F.col("w"), n, n).alias("g")) for n in (1, 2, 3)])).alias("x"))
    return rows.where(F.size("x.g") > 0).select("context_id", "x.n", F.size("x.g").cast("long").alias("n_runs"), F.size(F.array_distinct("x.g")).cast("long").alias("n_distinct"))


@query(f"WITH {S.TOK} SELECT DISTINCT w AS word, {S.generic('w')} AS generic FROM tok")
def generic_filter(spark, d):
    return docs(spark, d).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct().select("word", T.is_generic(F.col("word")).alias("generic"))


@query(r"""SELECT doc_id, len(regexp_extract_all('  ' || regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_]', '  ', 'g') || '  ', ' the '))::INT AS words, ((length(text) - length(replace(lower(text), 'th', ''))) // 2)::INT AS parts FROM documents""")
def occurrence_count(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.count_occurrences(t, F.lit("the")).alias("words"), T.count_occurrences(t, F.lit("TH"), False).alias("parts"))


@query(f"""WITH w AS (SELECT p_partkey, list_filter(string_split_regex(lower(trim(p_name)), '\\s+'), lambda x: x <> '') AS ws FROM part),
s AS (SELECT p_partkey, unnest(list_append(flatten([[array_to_string(ws[i:i + n - 1], ' ') for i in range(1, len(ws) - n + 2)] for n in range(1, 6)]), array_to_string(ws, ' '))) AS span FROM w)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list(span))), '|') AS spans FROM s WHERE span <> '' AND (contains(span, ' ') OR NOT {S.generic('span')}) GROUP BY p_partkey""")
def span_expand(spark, d):
    s = T.spans(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", F.array_join(s, "|").alias("spans")).where("spans <> ''")


@query(f"WITH {S.TOK}, l AS (SELECT w AS word, CASE WHEN regexp_matches(w, '[a-zA-Z]') THEN 'en' ELSE 'other' END AS language FROM tok) SELECT word, language, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 2")
def multilingual_freq(spark, d):
    w = docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return w.select("word", T.detect_word_language(F.col("word")).alias("language"), "n")


@query("SELECT conv_id, turn, (length(text) // 4)::BIGINT AS tokens FROM conversations")
def token_estimate(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1) || '|\n\s*\n')) AS s FROM documents WHERE text IS NOT NULL)
SELECT documents.doc_id, count(s)::BIGINT AS n, coalesce(sum(length(trim(s))), 0)::BIGINT AS chars FROM documents LEFT JOIN s ON s.doc_id = documents.doc_id AND trim(s) <> '' GROUP BY documents.doc_id""")
def sentence_split(spark, d):
    s = read(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("chars"))


# vocabulary and matrix

def posts1(spark, d):
    return vo.postings(docs(spark, d))


def posts2(spark, d):
    return vo.postings(docs(spark, d), (2,))


def idf_of(spark, d, posts, smooth=True):
    return vo.idf(vo.vocabulary(posts), read(spark, d, "documents").count(), smooth)


@query(f"WITH {S.ONE}, {S.VOC} SELECT phrase, df FROM voc")
def vocabulary_df(spark, d):
    return vo.vocabulary(posts1(spark, d))


@query(f"WITH {S.TOK}, one AS (SELECT context_id, w AS phrase, i FROM tok WHERE NOT {S.generic('w')}), posts AS (SELECT DISTINCT phrase, context_id FROM one UNION SELECT DISTINCT a.phrase || ' ' || b.phrase, a.context_id FROM one a JOIN one b ON a.context_id = b.context_id AND b.i = a.i + 1), {S.VOC} SELECT len(string_split(phrase, ' '))::INT AS n_words, count(*) AS n_phrases, sum(df)::BIGINT AS total, round(avg(df), 6) AS mean_df, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM voc GROUP BY 1")
def vocab_stats(spark, d):
    h = vo.length_histogram(vo.vocabulary(vo.postings(docs(spark, d), (1, 2))))
    return h.withColumns({"mean_df": r6(F.col("mean_df")), "percent": r6(F.col("percent").cast("double"))})


@query(f"WITH {S.ONE}, {S.VOC}, {S.IDF} SELECT phrase, df, round(idf, 6) AS idf FROM idf")
def idf_smooth(spark, d):
    return idf_of(spark, d, posts1(spark, d)).withColumn("idf", r6("idf"))


@query(f"WITH {S.ONE}, {S.VOC} SELECT phrase, df, round(ln((SELECT count(*) FROM documents)::DOUBLE / df), 6) AS idf FROM voc")
def idf_plain(spark, d):
    return idf_of(spark, d, posts1(spark, d), False).withColumn("idf", r6("idf"))


@query(f"WITH {S.ONE} SELECT phrase, context_id, 1.0::DOUBLE AS weight FROM posts")
def tcm_build(spark, d):
    return vo.term_context(posts1(spark, d), None)


@query(f"WITH {S.ONE}, {S.VOC}, {S.IDF}, {S.TCM} SELECT phrase, context_id, round(weight, 6) AS weight FROM tcm")
def tcm_tfidf(spark, d):
    p = posts1(spark, d)
    return vo.term_context(p, idf_of(spark, d, p)).withColumn("weight", r6("weight"))


@query(f"WITH {S.ONE}, {S.VOC}, {S.IDF}, {S.TCM}, n AS (SELECT count(*) AS n FROM documents) SELECT count(*) AS nnz, count(DISTINCT phrase) AS n_phrases, max(n) AS n_contexts, round(count(*) / (count(DISTINCT phrase) * max(n)), 9)::DOUBLE AS density FROM tcm, n")
def matrix_density(spark, d):
    p = posts1(spark, d)
    return vo.matrix_density(vo.term_context(p, idf_of(spark, d, p)), read(spark, d, "documents").count()).withColumn("density", F.round("density", 9))


def query_phrases(spark, d, n=2):
    return vo.occurrences(vo.contexts(read(spark, d, "benchmark"), "item_id", "text"), n).groupBy(F.col("context_id").alias("query_id"), "phrase").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.TWO}, {S.VOC}, {S.QUERY} SELECT query_id, phrase, n FROM qphr WHERE phrase IN (SELECT phrase FROM voc)")
def semi_vocab_match(spark, d):
    return vo.matched(query_phrases(spark, d), vo.vocabulary(posts2(spark, d)))


@query(f"WITH {S.TWO}, {S.VOC}, {S.QUERY} SELECT query_id, phrase, n FROM qphr WHERE phrase NOT IN (SELECT phrase FROM voc)")
def anti_oov(spark, d):
    return vo.missing(query_phrases(spark, d), vo.vocabulary(posts2(spark, d)))


@query(f"WITH {S.TOK}, {S.QUERY}, qw AS (SELECT DISTINCT w FROM qone) SELECT context_id, w AS word, count(*) AS n FROM tok WHERE w IN (SELECT w FROM qw) GROUP BY ALL")
def word_freq_eval(spark, d):
    words = vo.occurrences(vo.contexts(read(spark, d, "benchmark"), "item_id", "text")).select(F.col("phrase").alias("word"))
    return vo.word_frequency(docs(spark, d), words)


@query(f"WITH {S.TWO}, {S.VOC} SELECT context_id, count(*) AS n, md5(array_to_string(list_sort(list(phrase)), '|')) AS bag FROM posts WHERE phrase IN (SELECT phrase FROM voc) GROUP BY context_id")
def bow_binary(spark, d):
    p = posts2(spark, d)
    return vo.bag_of_words(p, vo.vocabulary(p)).select("context_id", "n", F.md5(F.array_join("bag", "|").cast("binary")).alias("bag"))


@query("SELECT lang, text, min(doc_id) AS paragraph_id, count(*) AS n FROM documents GROUP BY lang, text")
def paragraph_dedup(spark, d):
    return graph.dedup_paragraphs(read(spark, d, "documents"), ["lang", "text"], "doc_id")


@query(r"SELECT count(*) AS n, sum(w)::BIGINT AS n_words, sum(c)::BIGINT AS n_chars, round(avg(w), 6) AS mean_words, round(avg(c), 6) AS mean_chars FROM (SELECT len(regexp_extract_all(text, '[^\s]+')) AS w, length(text) AS c FROM conversations)")
def corpus_stats(spark, d):
    return graph.corpus_stats(read(spark, d, "conversations")).withColumns({"mean_words": r6("mean_words"), "mean_chars": r6("mean_chars")})


# grid

@query(f"SELECT o_orderkey, {S.morton('o_orderkey % 1024', 'o_custkey % 1024')} AS cell FROM orders")
def morton_encode(spark, d):
    return read(spark, d, "orders").select("o_orderkey", G.morton(F.col("o_orderkey") % 1024, F.col("o_custkey") % 1024).alias("cell"))


@query(f"SELECT l_orderkey, l_linenumber, {S.gather('l_partkey')} AS x, {S.gather('l_partkey >> 1')} AS y FROM lineitem")
def morton_decode(spark, d):
    x, y = G.unmorton(F.col("l_partkey"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))


NEAR = f"SELECT doc_id, doc_id % {GRID} + dx AS x, (doc_id // {GRID}) % {GRID} + dy AS y FROM documents, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE (dx <> 0 OR dy <> 0) AND doc_id % {GRID} + dx BETWEEN 0 AND {GRID - 1} AND (doc_id // {GRID}) % {GRID} + dy BETWEEN 0 AND {GRID - 1}"


@query(f"SELECT doc_id, x::INT AS x, y::INT AS y FROM ({NEAR})")
def grid_neighbors(spark, d):
    at = layout.hash_layout(docs(spark, d), GRID).withColumn("o", F.explode(G.offset_array(1, lambda _: 1.0, centre=False)))
    x, y = F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy")
    return at.select(F.col("context_id").alias("doc_id"), x.alias("x"), y.alias("y")).where(G.inside(F.col("x"), F.col("y"), GRID))


def points(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("context_id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


SCALED = f"p AS (SELECT vec_id AS context_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), b AS (SELECT quantile_cont(x, 0.01) AS lx, quantile_cont(x, 0.99) AS hx, quantile_cont(y, 0.01) AS ly, quantile_cont(y, 0.99) AS hy FROM p), sc AS (SELECT context_id, label, greatest(0, least({GRID - 1}, round_even((x - lx) / (hx - lx) * {GRID - 1}, 0)))::INT AS x, greatest(0, least({GRID - 1}, round_even((y - ly) / (hy - ly) * {GRID - 1}, 0)))::INT AS y FROM p, b)"


@query(f"WITH {SCALED} SELECT context_id, x, y FROM sc")
def grid_scale(spark, d):
    return layout.scale_to_grid(points(spark, d), GRID)


@query("SELECT event_id, least(floor(value / 1000 * 20), 19)::INT AS clip, floor(value / 1000 * 20)::INT AS edges, floor(value / 1000 * 19)::INT AS linear FROM events WHERE value IS NOT NULL")
def equal_width_bin(spark, d):
    v = F.col("value")
    return read(spark, d, "events").where("value is not null").select("event_id", *[layout.equal_width_bin(v, F.lit(0.0), F.lit(1000.0), 20, m).alias(m) for m in ("clip", "edges", "linear")])


@query(f"WITH {SCALED} SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(DISTINCT x * 1000 + y) AS n_unique, round(1 - count(DISTINCT x * 1000 + y) / count(*), 6) AS collision_rate FROM sc")
def coord_stats(spark, d):
    return layout.coordinate_stats(grid_scale(spark, d)).withColumn("collision_rate", r6("collision_rate"))


@query(f"WITH {SCALED} SELECT x, y, count(*) AS n FROM sc GROUP BY x, y")
def cell_histogram(spark, d):
    return layout.cell_histogram(grid_scale(spark, d))


@query(f"WITH {SCALED}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM sc GROUP BY label) SELECT label AS topic, round(cx, 6) AS cx, round(cy, 6) AS cy, count(*) AS n, round(avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)), 6) AS mean_distance, round(stddev_pop(x), 6) AS spread_x, round(stddev_pop(y), 6) AS spread_y FROM sc JOIN c USING (label) GROUP BY label, cx, cy")
def topic_cluster(spark, d):
    at = grid_scale(spark, d).join(read(spark, d, "embeddings").select(F.col("vec_id").alias("context_id"), F.col("label").alias("topic")), "context_id")
    return layout.topic_clusters(at).select("topic", "n", *[r6(c).alias(c) for c in ("cx", "cy", "mean_distance", "spread_x", "spread_y")])


# fingerprints

def doc_cells(spark, d):
    return fp.cells(layout.hash_layout(docs(spark, d), GRID))


def two_word(spark, d):
    """(tcm, raw phrase fingerprints, idf) of two-word phrases."""
    p = posts2(spark, d)
    idf = idf_of(spark, d, p)
    tcm = vo.term_context(p, idf)
    return tcm, fp.phrase_fingerprints(fp.phrase_counts(tcm, doc_cells(spark, d))), idf


def doc_prints(spark, d, change=None):
    """Fingerprints of all documents, or what `change` leaves of them."""
    return bl.documents(bl.neighbours(docs(spark, d)), docs(spark, d).select("context_id"), GRID, bl.as_rows(change), "context_id long, cell long, value double")


def doc_lists(spark, d):
    """The same as an array per document."""
    return bl.documents(bl.neighbours(docs(spark, d)), docs(spark, d).select("context_id"), GRID, bl.as_lists(), "context_id long, cells array<struct<cell: long, value: double>>")


@query(f"WITH {S.PHRASE} SELECT phrase, cell, round(value, 6) AS value FROM pfp")
def phrase_fp_raw(spark, d):
    return two_word(spark, d)[1].withColumn("value", r6("value"))


@query(f"WITH {S.DOC} SELECT context_id, count(*) AS nnz, round(sum(value), 6) AS total, max(value) AS top FROM dfp GROUP BY context_id")
def doc_accumulate(spark, d):
    return doc_prints(spark, d).groupBy("context_id").agg(F.count(F.lit(1)).alias("nnz"), F.round(F.sum("value"), 6).alias("total"), F.max("value").alias("top"))


@query(f"WITH {S.DOC} SELECT lang, cell, round(sum(value), 6) AS value FROM dfp JOIN documents ON doc_id = context_id GROUP BY lang, cell")
def fp_merge(spark, d):
    of = read(spark, d, "documents").select(F.col("doc_id").alias("context_id"), F.col("lang").alias("label"))
    sums = bl.documents(bl.neighbours(docs(spark, d)), of, GRID, bl.label_sums(), "label string, cell long, value double")
    return sums.groupBy(F.col("label").alias("lang"), "cell").agg(F.round(F.sum("value"), 6).alias("value"))


@query(f"WITH {S.DOC}, a AS (SELECT context_id, count(*) AS active FROM dfp GROUP BY context_id) SELECT count(*) AS n, round(avg(active), 6) AS mean_active, round(stddev_pop(active), 6) AS std_active, min(active) AS min_active, max(active) AS max_active, round(avg(1 - active / {GRID * GRID}.0), 6)::DOUBLE AS mean_sparsity FROM a")
def fp_stats(spark, d):
    s = fp.stats(doc_prints(spark, d), "context_id", GRID)
    return s.select("n", r6("mean_active").alias("mean_active"), r6("std_active").alias("std_active"), "min_active", "max_active", r6("mean_sparsity").alias("mean_sparsity"))


@query(f"WITH {S.DOC} SELECT context_id, count(*) AS active, min(value) >= 0 AND min(cell) >= 0 AND max(cell) < {GRID * GRID} AND count(*) BETWEEN 5 AND 500 AS valid FROM dfp GROUP BY context_id")
def fp_validate(spark, d):
    return fp.validate(doc_prints(spark, d), "context_id", GRID, 5, 500)


def flat(spark, d):
    """`embeddings` as rows (id, cell, value)."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("cell", "value")).select("id", F.col("cell").cast("long").alias("cell"), F.col("value").cast("double").alias("value"))


def _norm(mode: str, norm: str) -> None:
    def f(spark, d):
        return fp.normalise(flat(spark, d), "id", mode).withColumn("value", r6("value"))

    QUERIES[f"fp_normalize_{mode}"] = f
    ORACLES[f"fp_normalize_{mode}"] = f"WITH {S.EMB}, n AS (SELECT id, {norm} AS norm FROM flat GROUP BY id) SELECT id, cell, round({'CASE WHEN value <> 0 THEN 1.0 ELSE 0.0 END' if mode == 'binary' else 'CASE WHEN norm > 0 THEN value / norm ELSE value END'}, 6)::DOUBLE AS value FROM flat JOIN n USING (id)"


for _m, _f in {"l1": "sum(abs(value))", "l2": "sqrt(sum(value * value))", "max": "max(abs(value))", "binary": "1.0"}.items():
    _norm(_m, _f)


@query(f"WITH {S.DOC} SELECT context_id, cell, value FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY value DESC, cell) AS k FROM dfp) WHERE k <= 50")
def sparsify_topk(spark, d):
    return doc_prints(spark, d, bl.top(50))


@query(f"WITH {S.DOC} SELECT context_id, cell, value FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY cell) AS k FROM dfp) WHERE k <= 50")
def sparsify_morton(spark, d):
    return doc_prints(spark, d, bl.first(50))


@query(f"WITH {S.DOC} SELECT context_id, cell, value FROM (SELECT *, rank() OVER (PARTITION BY context_id ORDER BY value DESC) AS k FROM dfp WHERE value > 0) WHERE k <= {int(GRID * GRID * 0.05)}")
def sparsify_ties(spark, d):
    return doc_prints(spark, d, bl.top_ties(int(GRID * GRID * 0.05)))


@query(f"WITH {S.DOC} SELECT context_id, cell, 1.0::DOUBLE AS value FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY value DESC, cell) AS k FROM dfp) WHERE k <= 20")
def sdr_binary(spark, d):
    return doc_prints(spark, d, bl.top(20)).withColumn("value", F.lit(1.0))


# queries

def _weights(mode: str) -> None:
    def f(spark, d):
        _, prints, idf = two_word(spark, d)
        return qu.fingerprint(qu.weights(vo.matched(query_phrases(spark, d), idf), idf, mode), prints).withColumn("value", r6("value"))

    w = {"uniform": "1.0", "frequency": "n::DOUBLE", "idf": "idf"}[mode]
    QUERIES[f"query_fp_{mode}"] = f
    ORACLES[f"query_fp_{mode}"] = f"WITH {S.PHRASE}, {S.QUERY}, a AS (SELECT query_id, cell, sum({w} * value) AS v FROM qphr JOIN idf USING (phrase) JOIN pfp USING (phrase) GROUP BY query_id, cell), n AS (SELECT query_id, sqrt(sum(v * v)) AS norm FROM a GROUP BY query_id) SELECT query_id, cell, round(CASE WHEN norm > 0 THEN v / norm ELSE v END, 6)::DOUBLE AS value FROM a JOIN n USING (query_id)"


for _m in ("uniform", "frequency", "idf"):
    _weights(_m)

QFP = f"{S.DOC}, {S.QUERY}, qfp AS (SELECT query_id, cell, sum(idf * value) AS v FROM qphr JOIN idf USING (phrase) JOIN pfp USING (phrase) GROUP BY query_id, cell)"


def query_prints(spark, d, norm="none"):
    _, prints, idf = two_word(spark, d)
    return qu.fingerprint(qu.weights(vo.matched(query_phrases(spark, d), idf), idf), prints, norm)


@query(f"WITH {S.TWO}, {S.VOC}, {S.IDF}, {S.QUERY}, x AS (SELECT query_id, phrase, coalesce(idf, 1.0) AS w FROM qphr LEFT JOIN idf USING (phrase) UNION ALL SELECT query_id, phrase, coalesce(idf, 1.0) * (1.0 / n) ** 2 * 0.6 FROM qphr LEFT JOIN idf USING (phrase)) SELECT query_id, phrase, round(max(w), 6)::DOUBLE AS weight FROM x GROUP BY query_id, phrase")
def query_weight_merge(spark, d):
    q = query_phrases(spark, d).join(idf_of(spark, d, posts2(spark, d)).select("phrase", "idf"), "phrase", "left")
    return qu.merge_weights(q, q.withColumn("similarity", 1.0 / F.col("n"))).withColumn("weight", r6("weight"))


SPREAD = f"dense AS (SELECT query_id, count_if(v <> 0) / {GRID * GRID}.0 >= 0.005 AS dense FROM qfp GROUP BY query_id), spot AS (SELECT query_id, dense, {S.gather('cell')} AS x, {S.gather('cell >> 1')} AS y, cell, v FROM qfp JOIN dense USING (query_id)), moved AS (SELECT query_id, x + dx AS x, y + dy AS y, v * (CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE 0.5 END) AS v FROM spot, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE dense), spread AS (SELECT query_id, {S.morton('x', 'y')} AS cell, sum(v) AS v FROM moved WHERE x BETWEEN 0 AND {GRID - 1} AND y BETWEEN 0 AND {GRID - 1} GROUP BY 1, 2 UNION ALL SELECT query_id, cell, v FROM spot WHERE NOT dense)"


@query(f"WITH {QFP}, {SPREAD} SELECT query_id, cell, round(v, 6) AS value FROM spread")
def spread(spark, d):
    return fp.spread(query_prints(spark, d), "query_id", GRID).withColumn("value", r6("value"))


@query(f"WITH {QFP}, spot AS (SELECT query_id, {S.gather('cell')} AS x, {S.gather('cell >> 1')} AS y, v FROM qfp), moved AS (SELECT query_id, CASE WHEN x - dx BETWEEN 0 AND {GRID - 1} THEN x - dx ELSE x END AS x, CASE WHEN y - dy BETWEEN 0 AND {GRID - 1} THEN y - dy ELSE y END AS y, v / (2 ** (abs(dx) + abs(dy))) AS v FROM spot, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)) SELECT query_id, {S.morton('x', 'y')} AS cell, round(sum(v), 6) AS value FROM moved GROUP BY 1, 2")
def geometric_kernel(spark, d):
    return fp.geometric(query_prints(spark, d), "query_id", GRID).withColumn("value", r6("value"))


RANK = f"{QFP}, {SPREAD}, size AS (SELECT context_id, count(*) AS nnz FROM dfp GROUP BY context_id), norm AS (SELECT query_id, sqrt(sum(v * v)) AS norm FROM spread GROUP BY query_id), sims AS (SELECT query_id, context_id, sum(v * value) AS dot FROM spread JOIN dfp USING (cell) GROUP BY query_id, context_id), scored AS (SELECT norm.query_id, size.context_id, round(coalesce(dot / nullif(norm * sqrt(nnz), 0), 0), 6) AS score FROM norm CROSS JOIN size LEFT JOIN sims ON sims.query_id = norm.query_id AND sims.context_id = size.context_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, context_id) AS rank FROM scored)"


@query(f"WITH {RANK} SELECT query_id, context_id, score, rank::INT AS rank FROM ranked WHERE rank <= 10")
def doc_ranking(spark, d):
    """The flagship: benchmark texts rank all documents by spread fingerprints."""
    asked = store(query_phrases(spark, d), "query-phrases")
    own = store(bl.postings_of(asked.select("phrase").distinct(), bl.neighbours(docs(spark, d))), "query-postings")  # phrases of the benchmark's texts
    idf = idf_of(spark, d, own)
    prints = fp.phrase_fingerprints(fp.phrase_counts(vo.term_context(own, idf), doc_cells(spark, d)))
    q = qu.fingerprint(qu.weights(vo.matched(asked, idf), idf), prints, "none")
    return qu.rank(fp.spread(q, "query_id", GRID), lambda emit, schema: bl.documents(bl.neighbours(docs(spark, d)), docs(spark, d).select("context_id"), GRID, emit, schema), 10)


@query(f"WITH {RANK}, top AS (SELECT * FROM ranked WHERE rank <= 10) SELECT query_id, rank::INT AS rank, context_id AS id, score, round(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank), 6) AS gap, round(max(score) OVER (PARTITION BY query_id) / nullif(avg(score) OVER (PARTITION BY query_id), 0), 6) AS top_to_mean FROM top")
def score_gaps(spark, d):
    return ev.score_gaps(doc_ranking(spark, d).withColumnRenamed("context_id", "id"))


@query(f"WITH {S.DOC} SELECT context_id, rank::INT AS rank, cell, {S.gather('cell')} AS x, {S.gather('cell >> 1')} AS y, value FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY value DESC, cell) AS rank FROM dfp) WHERE rank <= 10")
def top_cells(spark, d):
    return qu.top_cells(doc_prints(spark, d, bl.top(10)), "context_id", 10)


def two_prints(spark, d):
    """Fingerprints of the English and the French documents together."""
    m = store(fp_merge(spark, d), "merged")  # a grid per language; read twice
    return m.where("lang = 'en'"), m.where("lang = 'fr'")


TWO_PRINTS = f"{S.DOC}, merged AS (SELECT lang, cell, round(sum(value), 6) AS value FROM dfp JOIN documents ON doc_id = context_id GROUP BY lang, cell), joint AS (SELECT cell, coalesce(e.value, 0) AS a, coalesce(f.value, 0) AS b FROM (SELECT * FROM merged WHERE lang = 'en') e FULL JOIN (SELECT * FROM merged WHERE lang = 'fr') f USING (cell))"


@query(f"WITH {TWO_PRINTS} SELECT cell, round(a - b, 6) AS difference FROM joint")
def difference_map(spark, d):
    return fp.overlap(*two_prints(spark, d)).select("cell", F.round(F.col("a") - F.col("b"), 6).alias("difference"))


@query(f"WITH {TWO_PRINTS} SELECT count_if(a > 0 AND b > 0)::BIGINT AS common, count_if(a > 0 AND b <= 0)::BIGINT AS only_a, count_if(b > 0 AND a <= 0)::BIGINT AS only_b FROM joint")
def fp_overlap(spark, d):
    a, b = F.col("a") > 0, F.col("b") > 0
    return fp.overlap(*two_prints(spark, d)).agg(F.count_if(a & b).alias("common"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))


@query(f"WITH {TWO_PRINTS} SELECT row_number() OVER (ORDER BY least(a, b) DESC, cell)::INT AS rank, cell, least(a, b) AS shared FROM joint WHERE least(a, b) > 0 QUALIFY rank <= 20")
def overlap_cells(spark, d):
    top = fp.overlap(*two_prints(spark, d)).select("cell", F.least("a", "b").alias("shared")).where("shared > 0").orderBy(F.desc("shared"), "cell").limit(20)
    return top.select(F.row_number().over(W.orderBy(F.desc("shared"), "cell")).alias("rank"), "cell", "shared")


@query(f"WITH {S.DOC}, b AS (SELECT context_id, value, least(floor(value / 10) + 1, 31)::BIGINT AS bin FROM dfp WHERE value > 0) SELECT context_id, bin, count(*) AS n FROM b GROUP BY context_id, bin")
def activation_histogram(spark, d):
    bin_ = F.least(F.width_bucket("value", F.lit(0.0), F.lit(300.0), F.lit(30)), F.lit(31).cast("long"))
    return doc_prints(spark, d).where("value > 0").groupBy("context_id", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# similarity

def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


def block(spark, d):
    v = vectors(spark, d)
    return v.where("id % 50 = 0").select(F.col("id").alias("q_id"), F.col("label").alias("q_label"), F.col("vector").alias("q_vector"))


def _measure(name: str, value, sql: str, pairs=None) -> None:
    def f(spark, d):
        if pairs is not None:
            return pairs(block(spark, d), vectors(spark, d))
        met = sim.against(block(spark, d), vectors(spark, d)).where("q_id <> id")
        return met.select("q_id", "id", r6(value(F.col("q_vector"), F.col("vector")).cast("double")).alias("similarity"))

    QUERIES[name] = f
    ORACLES[name] = f"WITH {S.EMB} SELECT q_id, id, round(({sql})::DOUBLE, 6) AS similarity FROM met"


DOT, AA, BB = (f"list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1] * z[2]))" for x, y in (("qv", "v"), ("qv", "qv"), ("v", "v")))
MIN, MAX = (f"list_sum(list_transform(list_zip(qv, v), lambda z: {f}(z[1], z[2])))" for f in ("least", "greatest"))
DIST = "sqrt(list_sum(list_transform(list_zip(qv, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
BITS = "array_to_string(list_transform({}, lambda z: CASE WHEN z > 0 THEN '1' ELSE '0' END), '')"
COS = f"coalesce({DOT} / nullif(sqrt({AA}) * sqrt({BB}), 0), 0)"
_measure("cosine", sim.cosine, COS)
_measure("euclidean", sim.euclidean_similarity, f"CASE WHEN {DIST} = 0 THEN 'Infinity'::DOUBLE ELSE 1 / {DIST} END")
_measure("jaccard_weighted", lambda a, b: sim.jaccard_weighted(F.transform(a, F.abs), F.transform(b, F.abs)), "list_sum(list_transform(list_zip(qv, v), lambda z: least(abs(z[1]), abs(z[2])))) / list_sum(list_transform(list_zip(qv, v), lambda z: greatest(abs(z[1]), abs(z[2]))))")
_measure("dice", lambda a, b: sim.dice(F.transform(a, F.abs), F.transform(b, F.abs)), "2 * list_sum(list_transform(list_zip(qv, v), lambda z: least(abs(z[1]), abs(z[2])))) / list_sum(list_transform(list_zip(qv, v), lambda z: abs(z[1]) + abs(z[2])))")
_measure("hamming", lambda a, b: sim.hamming(F.transform(a, lambda x: x > 0), F.transform(b, lambda x: x > 0)), "list_sum(list_transform(list_zip(qv, v), lambda z: CASE WHEN (z[1] > 0) = (z[2] > 0) THEN 1.0 ELSE 0.0 END)) / len(v)")
_measure("jaccard_set", None, "coalesce(list_sum(list_transform(list_zip(qv, v), lambda z: CASE WHEN z[1] > 0 AND z[2] > 0 THEN 1.0 ELSE 0.0 END)) / nullif(list_sum(list_transform(list_zip(qv, v), lambda z: CASE WHEN z[1] > 0 OR z[2] > 0 THEN 1.0 ELSE 0.0 END)), 0), 0)", pr.jaccard_set)
_measure("levenshtein_sim", None, f"1 - levenshtein({BITS.format('qv')}, {BITS.format('v')}) / len(v)", pr.levenshtein)


def _knn(metric: str, distance: str) -> None:
    QUERIES[f"knn_{metric}"] = lambda spark, d: sim.knn(block(spark, d).drop("q_label"), vectors(spark, d).drop("label"), 10, metric)
    ORACLES[f"knn_{metric}"] = f"WITH {S.EMB}, x AS (SELECT q_id, id, round(({distance})::DOUBLE, 6) AS _distance FROM met) SELECT q_id, id, _distance, row_number() OVER (PARTITION BY q_id ORDER BY _distance, id)::INT AS rank FROM x QUALIFY rank <= 10"


for _m, _f in {"cosine": f"1 - {COS}", "l2": DIST, "ip": f"-{DOT}"}.items():
    _knn(_m, _f)


@query(f"WITH {S.EMB}, x AS (SELECT q_id, id, list_transform(qv, lambda z: z) AS a, v AS b, qv FROM met) SELECT q_id, id, len(list_filter(a, lambda z: z > 0)) AS active_a, len(list_filter(b, lambda z: z > 0)) AS active_b, len(list_filter(a, lambda z: z > 0.5)) AS strong_a, len(list_filter(b, lambda z: z > 0.5)) AS strong_b, round(list_max(a), 6) AS max_a, round(list_max(b), 6) AS max_b, len(list_filter(list_zip(a, b), lambda z: least(z[1], z[2]) > 0)) AS overlap, round(list_max(list_transform(list_zip(a, b), lambda z: least(z[1], z[2]))), 6) AS max_overlap, round(list_min(list_transform(list_zip(a, b), lambda z: z[1] - z[2])), 6) AS min_diff, round(list_max(list_transform(list_zip(a, b), lambda z: z[1] - z[2])), 6) AS max_diff, round({DIST.replace('v)', 'b)').replace('(qb)', '(qv)')}, 6) AS euclidean, round(coalesce(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / nullif(sqrt(list_sum(list_transform(a, lambda z: z * z))) * sqrt(list_sum(list_transform(b, lambda z: z * z))), 0), 0), 6) AS cosine FROM x")
def pair_stats(spark, d):
    return pr.pair_stats(block(spark, d), vectors(spark, d))


@query(f"WITH {S.EMB}, x AS (SELECT q_label = label AS same, {COS} AS s FROM met), y AS (SELECT avg(s) FILTER (same) AS a, avg(s) FILTER (NOT same) AS b FROM x) SELECT round(a, 6) AS mean_same, round(b, 6) AS mean_different, round(a - b, 6) AS separation, a - b > 0.1 AS good FROM y")
def pair_separation(spark, d):
    met = sim.against(block(spark, d), vectors(spark, d)).where("q_id <> id")
    s = sim.separation(met.select((F.col("q_label") == F.col("label")).alias("same"), sim.cosine(F.col("q_vector"), F.col("vector")).alias("similarity")))
    return s.withColumns({c: r6(c) for c in ("mean_same", "mean_different", "separation")})


def tfidf2(spark, d):
    return two_word(spark, d)[0]


def query_docs(spark, d):
    return docs(spark, d).where("context_id % 50 = 0").select("context_id")


@query(f"WITH {S.TWO}, {S.VOC}, {S.IDF}, {S.TCM} SELECT context_id, phrase, round(weight, 6) AS weight, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY round(weight, 6) DESC, phrase) AS rank FROM tcm) WHERE rank <= 5")
def top_terms(spark, d):
    return sim.top_k(tfidf2(spark, d).select("context_id", "phrase", r6("weight").alias("weight")), "context_id", [F.desc("weight"), F.asc("phrase")], 5)


@query(f"WITH {S.TWO}, {S.VOC}, {S.IDF}, {S.TCM} SELECT a.context_id AS q, b.context_id, a.phrase, round(least(a.weight, b.weight), 6) AS shared, row_number() OVER (PARTITION BY a.context_id, b.context_id ORDER BY round(least(a.weight, b.weight), 6) DESC, a.phrase)::INT AS rank FROM tcm a JOIN tcm b ON a.phrase = b.phrase AND a.context_id <> b.context_id WHERE a.context_id % 50 = 0 QUALIFY rank <= 3")
def shared_terms(spark, d):
    return sim.shared_terms(query_docs(spark, d), tfidf2(spark, d), "context_id", 3)


LONG = "norm AS (SELECT {e}, sqrt(sum(weight * weight)) AS norm FROM tcm GROUP BY {e}), dots AS (SELECT a.{e} AS q, b.{e} AS e, sum(a.weight * b.weight) AS dot FROM tcm a JOIN tcm b ON a.{k} = b.{k} AND a.{e} <> b.{e} WHERE {w} GROUP BY 1, 2), sims AS (SELECT q, dots.e AS {e}, round(coalesce(dot / nullif(n.norm * m.norm, 0), 0), 6) AS similarity FROM dots JOIN norm n ON n.{e} = dots.q JOIN norm m ON m.{e} = dots.e) SELECT q, {e}, similarity, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, {e})::INT AS rank FROM sims QUALIFY rank <= 5"


@query(f"WITH {S.TWO}, {S.VOC}, {S.IDF}, {S.TCM}, {LONG.format(e='context_id', k='phrase', w='a.context_id % 50 = 0')}")
def similar_contexts(spark, d):
    s = sim.long_cosine(query_docs(spark, d), tfidf2(spark, d), "context_id", "phrase", "weight")
    return sim.top_k(s, "q", [F.desc("similarity"), F.asc("context_id")], 5)


@query(f"WITH {S.TWO}, {S.VOC}, {S.IDF}, {S.TCM}, {S.QUERY}, {LONG.format(e='phrase', k='context_id', w='a.phrase IN (SELECT phrase FROM qphr)')}")
def similar_phrases(spark, d):
    s = sim.long_cosine(query_phrases(spark, d).select("phrase"), tfidf2(spark, d), "phrase", "context_id", "weight")
    return sim.top_k(s, "q", [F.desc("similarity"), F.asc("phrase")], 5)


@query(f"WITH {S.TWO}, {S.VOC}, {S.IDF}, {S.TCM} SELECT a.context_id AS src, b.context_id AS dst, round(sum(a.weight * b.weight) / 20, 6) AS weight FROM tcm a JOIN tcm b ON a.phrase = b.phrase AND a.context_id <> b.context_id WHERE a.context_id % 50 = 0 GROUP BY 1, 2 HAVING round(sum(a.weight * b.weight) / 20, 6) > 0.1")
def context_graph_edges(spark, d):
    return sim.context_graph(query_docs(spark, d), tfidf2(spark, d))


# evaluation: nearest vectors against vectors of the same label

NEAREST = f"{S.EMB}, x AS (SELECT q_id, id, q_label, label, round(({COS})::DOUBLE, 6) AS s FROM met), top AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS rank, (q_label = label)::INT AS hit FROM x QUALIFY rank <= 10), gold AS (SELECT q_id, count(*) AS n_gold FROM met WHERE q_label = label GROUP BY q_id), j AS (SELECT q_id AS query_id, rank, hit, coalesce(n_gold, 0) AS n_gold, sum(hit) OVER (PARTITION BY q_id ORDER BY rank) AS hits FROM top LEFT JOIN gold USING (q_id))"


def ranked_labels(spark, d):
    near = pr.nearest(block(spark, d), vectors(spark, d), 10).withColumnRenamed("q_id", "query_id")
    ranked = sim.top_k(near, "query_id", [F.desc("score"), F.asc("id")], 10).select("query_id", "id", "rank", "score")
    met = sim.against(block(spark, d), vectors(spark, d)).where("q_id <> id and q_label = label")
    return ranked, met.select(F.col("q_id").alias("query_id"), "id")


def judged(spark, d):
    return ev.judged(*ranked_labels(spark, d))


MRR = "m AS (SELECT query_id, coalesce(min(rank) FILTER (hit = 1), 0)::BIGINT AS found_at, round(coalesce(1.0 / min(rank) FILTER (hit = 1), 0), 6)::DOUBLE AS mrr, round(sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) / greatest(max(n_gold), 1), 6)::DOUBLE AS ap FROM j GROUP BY query_id)"


@query(f"WITH {NEAREST}, {MRR} SELECT * FROM m")
def metrics_mrr_ap(spark, d):
    return ev.mrr_ap(judged(spark, d))


@query(f"WITH {NEAREST} SELECT query_id, " + ", ".join(f"round(sum(hit) FILTER (rank <= {k}) / {k}, 6)::DOUBLE AS p_{k}, round(coalesce(sum(hit) FILTER (rank <= {k}) / nullif(max(n_gold), 0), 0), 6)::DOUBLE AS r_{k}" for k in (1, 2, 3, 5)) + " FROM j GROUP BY query_id")
def metrics_pr_at_k(spark, d):
    return ev.precision_recall(judged(spark, d))


def _ndcg(gain: str, ideal: str) -> str:
    return f"WITH {NEAREST} SELECT query_id, " + ", ".join(f"round(coalesce(coalesce(sum({gain}) FILTER (rank <= {k} AND hit = 1), 0) / nullif(list_sum([CASE WHEN i <= max(n_gold) THEN {ideal} ELSE 0 END for i in range(1, {k + 1})]), 0), 0), 6)::DOUBLE AS ndcg_{k}" for k in (1, 2, 3, 5)) + " FROM j GROUP BY query_id"


@query(_ndcg("1 / log2(rank + 1)", "1 / log2(i + 1)"))
def metrics_ndcg(spark, d):
    return ev.ndcg(judged(spark, d))


@query(_ndcg("1.0 / length(ltrim(bin(rank + 1), '0'))", "1.0 / length(ltrim(bin(i), '0'))"))
def metrics_ndcg_ref(spark, d):
    return ev.ndcg(judged(spark, d), bit_length=True)


@query(f"WITH {NEAREST}, {MRR}, l AS (UNPIVOT (SELECT query_id, mrr, ap FROM m) ON mrr, ap INTO NAME metric VALUE v) SELECT metric, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max FROM l GROUP BY metric")
def metrics_summary(spark, d):
    return ev.summary(metrics_mrr_ap(spark, d), ["mrr", "ap"])


@query(f"WITH {NEAREST}, {MRR}, l AS (UNPIVOT (SELECT query_id, mrr, ap FROM m) ON mrr, ap INTO NAME metric VALUE v) SELECT metric, round(avg(v), 6) AS mean, list_sort(list(v))[count(*) // 2 + 1] AS median, round(stddev_pop(v), 6) AS std, count_if(v = 0)::BIGINT AS zeros, count_if(v = 1)::BIGINT AS perfect FROM l GROUP BY metric")
def metrics_distribution(spark, d):
    return ev.distribution(metrics_mrr_ap(spark, d), ["mrr", "ap"])


@query(f"WITH {NEAREST}, {MRR} SELECT count_if(found_at = 1)::BIGINT AS found_r1, count_if(found_at = 2)::BIGINT AS found_r2, count_if(found_at BETWEEN 3 AND 5)::BIGINT AS found_r3_5, count_if(found_at > 5)::BIGINT AS found_later, count_if(found_at = 0)::BIGINT AS not_found FROM m")
def metrics_counters(spark, d):
    return ev.rank_counters(metrics_mrr_ap(spark, d))


@query(f"WITH {NEAREST} SELECT q_id AS query_id, id, s AS score, row_number() OVER (PARTITION BY q_id ORDER BY rank)::INT AS rank FROM top WHERE label <= 4")
def candidate_filter(spark, d):
    ranked = store(ranked_labels(spark, d)[0], "ranked")  # ten rows a query; read twice
    pool = ranked.select("query_id", "id").join(vectors(spark, d).where("label <= 4").select("id"), "id")
    return ev.candidates(ranked, pool)


@query(f"WITH {S.EMB}, x AS (SELECT q_id AS question, label % 4 AS option, max(round(({COS})::DOUBLE, 6)) AS score FROM met GROUP BY 1, 2) SELECT question, chr((65 + arg_max(option, score * 1000 - option / 1e6))::INT) AS answer FROM x GROUP BY question")
def mc_accuracy(spark, d):
    met = sim.against(block(spark, d), vectors(spark, d)).where("q_id <> id").groupBy(F.col("q_id").alias("question"), (F.col("label") % 4).alias("option")).agg(F.max(r6(sim.cosine(F.col("q_vector"), F.col("vector")))).alias("score"))
    return ev.best_option(met)


# triples and logs

def triples(spark, d):
    """Orders as subjects, line status as predicates, parts as objects."""
    l = read(spark, d, "lineitem")  # noqa: E741
    return l.select(F.concat(F.lit("order "), "l_orderkey").alias("subject"), F.when(F.col("l_linenumber") == 7, " ").otherwise(F.col("l_linestatus")).alias("predicate"), F.concat(F.lit(" part "), "l_partkey").alias("object"))


TRIPLES = "t AS (SELECT trim('order ' || l_orderkey) AS subject, trim(CASE WHEN l_linenumber = 7 THEN ' ' ELSE l_linestatus END) AS predicate, trim(' part ' || l_partkey) AS object FROM lineitem), c AS (SELECT * FROM t WHERE predicate <> '')"


@query(f"WITH {TRIPLES} SELECT * FROM c")
def triples_filter(spark, d):
    return graph.clean_triples(triples(spark, d))


@query(f"WITH {TRIPLES}, n AS (SELECT subject AS node FROM c UNION SELECT object FROM c) SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS n_edges")
def graph_counts(spark, d):
    return graph.graph_counts(graph.clean_triples(triples(spark, d)))


def log(spark, d):
    e = read(spark, d, "events")
    status = F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "completed").otherwise("failed")
    return e.select(F.concat(F.lit("u"), "user_id").alias("chunk_id"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), (F.col("event_id") % 7).alias("triple_count"))


LOG = "lg AS (SELECT 'u' || user_id AS chunk_id, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' ELSE 'failed' END AS status, ts, event_id, event_id % 7 AS triple_count FROM events)"


@query(f"WITH {LOG} SELECT status, count(*) AS n, sum(triple_count)::BIGINT AS triples FROM lg GROUP BY status")
def wal_summary(spark, d):
    return graph.log_summary(log(spark, d))


@query(f"WITH {LOG}, s AS (SELECT chunk_id, arg_max(status, (ts, event_id)) AS status FROM lg GROUP BY chunk_id) SELECT status, count(*) AS n FROM s GROUP BY status")
def wal_latest(spark, d):
    return graph.latest_status(log(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'u' || c_custkey AS chunk_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_id % 3 <> 0 AND user_id IS NOT NULL)")
def wal_resume(spark, d):
    return graph.unfinished(read(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("chunk_id")), log(spark, d))


# look-ups

@query(f"WITH {S.ONE}, {S.VOC}, {S.IDF}, {S.TCM} SELECT context_id, count(*) AS nnz, round(sum(weight), 6) AS total, round(avg(weight), 6) AS mean FROM tcm GROUP BY context_id")
def context_stats(spark, d):
    p = posts1(spark, d)
    return lo.context_stats(vo.term_context(p, idf_of(spark, d, p))).withColumns({"total": r6("total"), "mean": r6("mean")})


@query(f"WITH {S.ONE} SELECT DISTINCT phrase FROM posts JOIN documents ON doc_id = context_id WHERE lang IN ('de', 'fr')")
def phrase_union(spark, d):
    of = lambda x: vo.postings(vo.contexts(read(spark, d, "documents").where(F.col("lang") == x), "doc_id", "text"))
    return lo.phrase_union(of("de"), of("fr"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 7")
def point_lookup(spark, d):
    return lo.lookup(read(spark, d, "embeddings"), "vec_id", 7).select("vec_id", "label")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def row_counts(spark, d):
    return lo.row_counts(documents=read(spark, d, "documents"), embeddings=read(spark, d, "embeddings"))


@query("SELECT max(len(embedding))::INT AS size, max(len(embedding)) = min(len(embedding)) AS uniform FROM embeddings")
def vector_size(spark, d):
    return lo.vector_size(read(spark, d, "embeddings"), "embedding")


@query("SELECT s_suppkey AS step, bool_and(n_regionkey < 3) AS ready FROM supplier, nation WHERE n_nationkey IN (s_nationkey, s_suppkey % 25) GROUP BY s_suppkey")
def step_readiness(spark, d):
    steps = read(spark, d, "supplier").select(F.col("s_suppkey").alias("step"), F.array(F.col("s_nationkey").cast("long"), F.col("s_suppkey") % 25).alias("depends_on"))
    return lo.ready_steps(steps, read(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("step")))


@query("SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)")
def orphaned_runs(spark, d):
    return lo.orphans(read(spark, d, "customer").select(F.col("c_custkey").alias("name")), read(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("name")))


@query("WITH w AS (SELECT l_orderkey AS context_id, l_partkey AS word FROM lineitem WHERE l_linenumber <= 3), k AS (SELECT context_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM w JOIN embeddings ON vec_id = word), m AS (SELECT context_id, i, avg(v) AS v FROM k GROUP BY ALL), n AS (SELECT context_id, round(sum(v * i), 6) AS check_sum, round(sqrt(sum(v * v)), 6) AS norm FROM m GROUP BY context_id) SELECT context_id, coalesce(check_sum, 0.0)::DOUBLE AS check_sum, coalesce(norm, 0.0)::DOUBLE AS norm FROM (SELECT DISTINCT context_id FROM w) LEFT JOIN n USING (context_id)")
def mean_vectors(spark, d):
    words = read(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("context_id"), F.col("l_partkey").alias("word"))
    v = lo.mean_vectors(words, read(spark, d, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector")), 64)
    total = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return v.select("context_id", r6(total).alias("check_sum"), r6(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))


@query(f"WITH {SCALED} SELECT context_id, round(CASE WHEN label % 3 = 0 THEN x + 0.1 * ({GRID // 2} - x) ELSE x END, 6)::DOUBLE AS x, round(CASE WHEN label % 3 = 0 THEN y + 0.1 * ({GRID // 2} - y) ELSE y END, 6)::DOUBLE AS y FROM sc")
def position_nudge(spark, d):
    wrong = read(spark, d, "embeddings").where("label % 3 = 0").select(F.col("vec_id").alias("context_id"), F.lit(GRID // 2).alias("tx"), F.lit(GRID // 2).alias("ty"))
    return lo.nudge(grid_scale(spark, d), wrong).select("context_id", r6("x").cast("double").alias("x"), r6("y").cast("double").alias("y"))


@query("SELECT doc_id AS context_id FROM documents ORDER BY md5('0:' || doc_id) LIMIT 20")
def random_contexts(spark, d):
    return lo.random_contexts(docs(spark, d), 20)


# rows only

def smoothed(sigma: float) -> str:
    """SQL of the merged fingerprints, smoothed: a source adds to a target by the kernel's share that reads it there, mirrored edges included."""
    kernel = G.gaussian(sigma)
    r = len(kernel) // 2
    share: dict[tuple[int, int], float] = {}
    for t in range(GRID):
        for i, w in enumerate(kernel):
            m = (t + i - r) % (2 * GRID)
            s = m if m < GRID else 2 * GRID - 1 - m
            share[t, s] = share.get((t, s), 0.0) + w
    values = ", ".join(f"({t}, {s}, {w!r}::DOUBLE)" for (t, s), w in share.items())
    return f"{S.DOC}, merged AS (SELECT lang, cell, round(sum(value), 6) AS value FROM dfp JOIN documents ON doc_id = context_id GROUP BY lang, cell), spots AS (SELECT lang, {S.gather('cell')} AS x, {S.gather('cell >> 1')} AS y, value FROM merged), k(t, s, w) AS (VALUES {values}), rows_ AS (SELECT lang, y, k.t AS x, sum(value * w) AS v FROM spots JOIN k ON k.s = spots.x GROUP BY ALL), soft AS (SELECT lang, x, k.t AS y, sum(v * w) AS v FROM rows_ JOIN k ON k.s = rows_.y GROUP BY ALL)"


@query(f"WITH {smoothed(1.5)} SELECT lang, {S.morton('x', 'y')} AS cell, round(v, 6) AS value FROM soft WHERE v <> 0")
def gaussian_smooth(spark, d):
    m = fp_merge(spark, d).select("lang", "cell", "value")
    return fp.per_grid(m, "lang", GRID, lambda g: fp.smooth(g, 1.5)).withColumn("value", r6("value"))


@query(f"WITH {smoothed(1.0)}, top AS (SELECT a.lang, a.x, a.y, max(b.v) AS top, max(a.v) AS v FROM soft a JOIN soft b ON a.lang = b.lang AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL) SELECT lang, cell, value FROM top JOIN merged USING (lang) WHERE cell = {S.morton('x', 'y')} AND v = top AND v > 0 AND value <> 0")
def peak_detect(spark, d):
    m = fp_merge(spark, d).select("lang", "cell", "value")
    return fp.per_grid(m, "lang", GRID, lambda g: fp.peaks(fp.smooth(g, 1.0), 2) * g)


@query()
def sdr_topological(spark, d):
    return doc_prints(spark, d, bl.on_grids(GRID, fp.topological_all))


@query()
def pca_layout(spark, d):
    return layout.pca(layout.transpose_normalise(tfidf2(spark, d))).select("context_id", r6("x").alias("x"), r6("y").alias("y"))


@query()
def collision_resolve(spark, d):
    return layout.resolve_collisions(grid_scale(spark, d), GRID)


@query(f"""WITH t AS (SELECT DISTINCT p_name AS term FROM part), g AS (SELECT term, substr(term, i, n) AS g FROM t, (SELECT unnest([1, 2, 3]) AS n), LATERAL (SELECT unnest(range(1, length(term) - n + 2)) AS i)),
c AS (SELECT term, ('0x' || right(md5(unnest(['A', 'B']) || g), 4))::INT % {GRID * GRID} AS cell FROM g) SELECT term, cell::BIGINT AS cell, count(*)::DOUBLE AS value FROM c GROUP BY ALL""")
def pseudo_fingerprint(spark, d):
    return qu.pseudo_fingerprint(read(spark, d, "part").select(F.col("p_name").alias("term")).distinct(), GRID)


@query()
def oov_expand(spark, d):
    p = vo.postings(docs(spark, d), (1, 2))
    vocab = vo.vocabulary(p)
    prints = fp.phrase_fingerprints(fp.phrase_counts(p.join(vocab, "phrase", "left_semi"), doc_cells(spark, d)))
    terms = vo.missing(query_phrases(spark, d), vocab).select(F.col("phrase").alias("term")).distinct()
    return qu.expand_unknown(terms, store(vocab, "vocabulary"), store(prints, "phrases"), GRID)


@query()
def chunk_passages(spark, d):
    return graph.chunk(read(spark, d, "documents").select(F.col("doc_id").alias("passage_idx"), "text"))


@query()
def extract_triples_rules(spark, d):
    return graph.rule_triples(chunk_passages(spark, d))


@query()
def diversity_sample(spark, d):
    order = F.xxhash64("context_id", F.lit(5))  # as in fp.diversity, which takes the same documents
    some = store(doc_lists(spark, d).orderBy(order, "context_id").limit(200), "documents")
    return fp.diversity(some.select("context_id", F.inline("cells")), "context_id")


@query()
def query_end_to_end(spark, d):
    from gridprint.plans.pipeline import Pipeline

    engine = Pipeline(grid=GRID, sizes=(2,))
    return engine.query(engine.index(docs(spark, d)), read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
