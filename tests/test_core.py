import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridprint.functions import grid as G
from gridprint.functions import text as T
from gridprint.operators import evaluation as ev
from gridprint.operators import fingerprints as fp
from gridprint.operators import graph, layout
from gridprint.operators import query as qu
from gridprint.operators import similarity as sim
from gridprint.operators import vocabulary as vo
from gridprint.plans.pipeline import Pipeline
from gridprint.sources import readers, sinks
from gridprint.streaming import ingest


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


# text

def test_hyphens_in_one_pass(spark):
    f = lambda s: T.normalize_hyphens(F.lit(s))
    assert one(spark, f("state-of-the-art"), f("rule-based x"), f("a-1")) == ("state of-the art", "rule based x", "a-1")


def test_languages_and_bilingual_lines(spark):
    ar, en = T.split_bilingual(F.lit('بِسْمِ اللَّهِ, "In the name, of God"'))
    d = lambda s: T.detect_language(F.lit(s))
    assert one(spark, d("كتاب"), d("پنج کتاب"), d("book"), en, F.length(ar) > 0) == ("ar", "fa", "en", "In the name, of God", True)
    only_ar, none = T.split_bilingual(F.lit("كتاب"))
    nothing, only_en = T.split_bilingual(F.lit("a book"))
    assert one(spark, only_ar, none, nothing, only_en) == ("كتاب", "", "", "a book")


def test_arabic_folding_and_phrases(spark):
    p = lambda s: T.normalize_arabic_phrase(F.lit(s))
    assert one(spark, T.fold_arabic(F.lit("إِنَّ ٱلْمَدْرَسَة")), p("من الكتاب العظيم"), p("من"), p("به")) == ("ان المدرسه", "الكتاب العظيم", None, None)
    words = F.split(F.lit("و الكتاب من العظيم"), " ")
    assert one(spark, T.arabic_phrases(words))[0] == ["الكتاب", "العظيم", "الكتاب من", "من العظيم", "الكتاب من العظيم"]


def test_ngrams_spans_and_generic_words(spark):
    w = F.split(F.lit("a b c"), " ")
    assert one(spark, T.ngrams(w, 1, 2), T.ngrams(F.array(F.lit("a")), 2, 3)) == (["a", "b", "c", "a b", "b c"], [])
    assert one(spark, T.spans(F.lit("new use of AI")))[0] == ["new", "new use", "new use of", "new use of ai", "of ai", "use", "use of", "use of ai"]
    g = lambda s: T.is_generic(F.lit(s))
    assert one(spark, g("ai"), g("the"), g("123"), g("use"), g("also")) == (True, True, True, False, True)


def test_occurrences(spark):
    c = lambda t, p, b=True: T.count_occurrences(F.lit(t), F.lit(p), b)
    assert one(spark, c("The cat the catalog", "the"), c("The cat the catalog", "CAT"), c("The cat the catalog", "cat", False), c("a.b axb", "a.b"), c("x", "", False)) == (2, 1, 2, 1, 0)


def test_rule_triples(spark):
    text = "The éé éé éé éé éé éé éé éé éé éé éé éé éé éé éé éé engine is fast. No verb here. Is it so? Paris was big with lights."
    chunks = spark.createDataFrame([("c", text), ("d", "é " * 5000)], "chunk_id string, content string")
    got = [(r["subject"], r["predicate"], r["object"]) for r in graph.rule_triples(chunks).collect()]
    assert got == [("The", "is", "fast"), ("Paris", "was", "big")]


def test_lemmas_and_structure(spark):
    tag = lambda *x: F.array(*[F.struct(F.lit(a).alias("tok"), F.lit(b).alias("tag")) for a, b in x])
    assert one(spark, T.lemma(F.lit("boxes")), T.lemma(F.lit("cities")), T.lemma(F.lit("class")), T.lemma(F.lit("children")), T.lemma(F.lit("running"), F.lit("v"))) == ("box", "city", "class", "child", "run")
    forms = {"making": "make", "used": "use", "stopped": "stop", "reading": "read", "created": "create", "tries": "try", "studied": "study", "solving": "solve", "opened": "open", "sing": "sing", "falling": "fall", "reducing": "reduce"}
    assert one(spark, *[T.lemma(F.lit(w), F.lit("v")) for w in forms]) == tuple(forms.values())
    assert one(spark, T.lemma(F.lit("happiest"), F.lit("a")), T.lemma(F.lit("biggest"), F.lit("a"))) == ("happy", "big")
    assert one(spark, T.valid_structure(tag(("run", "VB"))), T.valid_structure(tag(("big", "JJ"), ("cat", "NN"))), T.valid_structure(tag(("cat", "NN"), ("big", "JJ")))) == (False, True, False)
    assert one(spark, T.bigram_candidates(tag(("big", "JJ"), ("cat", "NN"), ("runs", "VB"))))[0] == ["big cat"]
    assert one(spark, T.wordnet_pos(F.lit("VBN")), T.wordnet_pos(F.lit("VBD")), T.wordnet_pos(F.lit("IN"))) == ("a", "v", "n")


# grid

def test_morton_round_trip(spark):
    df = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    df = df.withColumn("cell", G.morton(F.col("x"), F.col("y")))
    u, v = G.unmorton(F.col("cell"))
    rows = df.select("x", "y", "cell", u.alias("u"), v.alias("v")).collect()
    assert all((r["x"], r["y"]) == (r["u"], r["v"]) for r in rows) and len({r["cell"] for r in rows}) == 256
    assert [next(r["cell"] for r in rows if (r["x"], r["y"]) == p) for p in ((0, 0), (1, 0), (0, 1), (1, 1), (5, 3))] == [0, 1, 2, 3, 27]


def prints(spark, dense, name="e"):
    ys, xs = np.nonzero(dense)
    rows = [(name, int(x), int(y), float(dense[y, x])) for y, x in zip(ys, xs)]
    df = spark.createDataFrame(rows or [("", 0, 0, 0.0)], "e string, x int, y int, value double").where(F.lit(bool(rows)))
    return df.select("e", G.morton(F.col("x"), F.col("y")).alias("cell"), "value")


def back(df, n):
    x, y = G.unmorton(F.col("cell"))
    out = np.zeros((n, n))
    for r in df.select(x.alias("x"), y.alias("y"), "value").collect():
        out[r["y"], r["x"]] = r["value"]
    return out


def test_spreading(spark):
    g = np.zeros((8, 8))
    g[0, 0], g[4, 4] = 2.0, 1.0
    want = np.zeros((8, 8))
    for y, x in ((0, 0), (4, 4)):
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if 0 <= y + dy < 8 and 0 <= x + dx < 8:
                    want[y + dy, x + dx] += g[y, x] * (1 if dx == dy == 0 else 0.5)
    assert np.allclose(back(fp.spread(prints(spark, g), "e", 8), 8), want)
    assert np.array_equal(back(fp.spread(prints(spark, g), "e", 8, radius=0), 8), g)
    assert np.array_equal(back(fp.spread(prints(spark, g), "e", 8, guard=0.5), 8), g)


def test_geometric_kernel(spark):
    g = np.random.default_rng(1).random((8, 8)) * (np.random.default_rng(2).random((8, 8)) > 0.5)
    wide = np.pad(g, 1, mode="symmetric")
    k = np.array([[0.25, 0.5, 0.25], [0.5, 1, 0.5], [0.25, 0.5, 0.25]])
    want = sum(k[i, j] * wide[i : i + 8, j : j + 8] for i in range(3) for j in range(3))
    assert np.allclose(back(fp.geometric(prints(spark, g), "e", 8), 8), want)


def test_smoothing_is_linear_and_keeps_mass():
    rng = np.random.default_rng(3)
    a, b = rng.random((16, 16)), rng.random((16, 16))
    assert np.allclose(fp.smooth(2 * a + b, 1.5), 2 * fp.smooth(a, 1.5) + fp.smooth(b, 1.5))
    assert np.isclose(fp.smooth(a, 1.5).sum(), a.sum())


def test_sparsifier():
    assert not fp.topological(np.zeros((8, 8))).any()
    assert not fp.peaks(np.zeros((4, 4)), 1).any() and fp.peaks(np.ones((4, 4)), 1).all()
    g = np.zeros((16, 16))
    g[3, 3], g[12, 12] = 5.0, 5.0
    out = fp.topological(g, share=0.02, sigma=0)
    assert out[3, 3] > 0 and out[12, 12] > 0 and np.count_nonzero(out) == 2
    heights = np.array([4.0, 3.0, 2.0, 1.0])

    def slow(budget):
        bits = np.maximum(1, (heights / heights.sum() * budget).astype(int))
        while bits.sum() > budget:
            bits[bits.argmax()] -= 1
        bits[0] += budget - bits.sum()
        return bits

    for budget in (2, 3, 4, 5, 10, 37):
        assert fp.share_bits(heights, budget).tolist() == slow(budget).tolist()


def test_norms_top_k_and_ties(spark):
    df = spark.createDataFrame([("a", 0, 3.0), ("a", 1, 4.0), ("a", 2, 3.0), ("z", 0, 0.0)], "e string, cell long, value double")
    norm = {m: {(r["e"], r["cell"]): round(r["value"], 6) for r in fp.normalise(df, "e", m).collect()} for m in ("l1", "l2", "max", "binary")}
    assert norm["l1"]["a", 1] == 0.4 and norm["max"]["a", 0] == 0.75 and norm["binary"]["a", 2] == 1 and norm["l2"]["z", 0] == 0
    assert sorted(r["cell"] for r in fp.sparsify(df, "e", 2).collect()) == [0, 1]
    assert sorted(r["cell"] for r in fp.sparsify_ties(df, "e", 2).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        fp.normalise(df, "e", "l3")


# layout

def test_collisions(spark):
    same = spark.createDataFrame([(i, 1, 1) for i in range(5)], "context_id long, x int, y int")
    got = [(r["x"], r["y"]) for r in layout.resolve_collisions(same, 4).orderBy("context_id").collect()]
    assert got == [(1, 1), (0, 0), (0, 1), (0, 2), (1, 0)]
    many = spark.createDataFrame([(i, 1, 1) for i in range(20)], "context_id long, x int, y int")
    assert len({(r["x"], r["y"]) for r in layout.resolve_collisions(many, 4).collect()}) == 16
    assert layout.spread_collisions(many, 8).count() == 20


def test_scaling_and_bins(spark):
    df = spark.createDataFrame([(i, float(i), 7.0) for i in range(101)], "context_id long, x double, y double")
    rows = layout.scale_to_grid(df, 11).orderBy("context_id").collect()
    assert rows[0]["x"] == 0 and rows[100]["x"] == 10 and rows[50]["x"] == 5 and {r["y"] for r in rows} == {5}
    b = lambda m: layout.equal_width_bin(F.lit(10.0), F.lit(0.0), F.lit(10.0), 5, m)
    assert one(spark, b("clip"), b("edges"), b("linear")) == (4, 5, 4)


def test_kde_and_flags(spark):
    df = spark.createDataFrame([(1, 2, 2), (2, 2, 2), (3, 6, 6)], "context_id long, x int, y int")
    d = {r["context_id"]: r["density"] for r in layout.kde(df).collect()}
    assert d[1] == d[2] and d[1] > 1.9 * d[3]
    assert layout.density_flags(df, 8).first()["centralised"]


# vocabulary and queries

def test_idf_can_be_negative(spark):
    df = spark.createDataFrame([("all", 3), ("two", 2), ("one", 1)], "phrase string, df long")
    got = {r["phrase"]: r["idf"] for r in vo.idf(df, 3).collect()}
    assert np.allclose([got["all"], got["two"], got["one"]], [np.log(3 / 4), 0, np.log(3 / 2)])


def test_vocabulary_keeps_listed_phrases(spark):
    posts = vo.postings(spark.createDataFrame([(1, "rare words, common words"), (2, "common words")], "context_id long, text string"), (1, 2))
    assert {r["phrase"]: r["df"] for r in vo.vocabulary(posts, 2, ["rare"]).collect()} == {"common": 2, "words": 2, "common words": 2, "rare": 1}


def test_ranking_keeps_zero_scores_and_breaks_ties_by_id(spark):
    q = spark.createDataFrame([(1, 0, 1.0)], "query_id long, cell long, value double")
    d = spark.createDataFrame([(7, 0, 2.0), (3, 0, 2.0), (5, 1, 1.0), (4, 1, 1.0), (9, 0, 0.0)], "context_id long, cell long, value double")
    assert [(r["context_id"], r["score"]) for r in qu.rank(q, d, 10).orderBy("rank").collect()] == [(3, 2.0), (7, 2.0), (4, 0.0), (5, 0.0)]
    assert qu.rank(q, d, 10, least=0.1).count() == 2


def test_pseudo_fingerprint(spark):
    import hashlib

    rows = {r["cell"]: r["value"] for r in qu.pseudo_fingerprint(spark.createDataFrame([("abé",)], "term string"), 16).collect()}
    want: dict = {}
    for g in ("a", "b", "é", "ab", "bé", "abé"):
        for s in "AB":
            c = int(hashlib.md5((s + g).encode()).hexdigest(), 16) % 256
            want[c] = want.get(c, 0) + 1
    assert rows == want


def test_unknown_words(spark):
    vocab = spark.createDataFrame([("deep learning",), ("learning",), ("cat food",)], "phrase string")
    cells = spark.createDataFrame([("deep learning", 1, 1.0), ("learning", 1, 1.0), ("learning", 2, 1.0), ("cat food", 9, 1.0)], "phrase string, cell long, value double")
    terms = spark.createDataFrame([("learning rate schedule",), ("learning rate",), ("learning learning x y",), ("rate learning learning",)], "term string")
    got = {(r["term"], r["phrase"]) for r in qu.expand_unknown(terms, vocab, cells, 16).collect()}
    assert got == set()  # one known word of several is too few
    both = vocab.union(spark.createDataFrame([("rate",)], "phrase string"))
    cells = cells.union(spark.createDataFrame([("rate", 1, 1.0)], cells.schema))
    got = {(r["term"], r["phrase"]) for r in qu.expand_unknown(terms, both, cells, 16).collect()}
    assert ("learning rate", "deep learning") in got and ("learning rate", "learning") not in got


def test_pipeline_ranks_the_right_document(spark):
    texts = ["solar panels turn sunlight into electric power", "wind turbines and solar panels make electric power", "the stock market fell as interest rates rose", "interest rates and the stock market", "cats drink milk and cats sleep", "dogs and cats sleep"]
    contexts = spark.createDataFrame(list(enumerate(texts)), "context_id long, text string")
    for reducer, share in (("hash", 1.0), ("pca", 0.2)):
        engine = Pipeline(grid=16, reducer=reducer, top_percent=share, min_freq=2)
        got = engine.query(engine.index(contexts), spark.createDataFrame([("q", "stock market interest rates")], "query_id string, text string"))
        assert {r["context_id"] for r in got.where("rank <= 2").collect()} <= {2, 3}


# similarity and evaluation

def test_measures(spark):
    a, b, z = F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    got = one(spark, sim.cosine(a, z), sim.jaccard_weighted(a, b), sim.dice(a, b), sim.hamming(a, b), sim.euclidean_similarity(a, a), sim.jaccard_set(F.array(), F.array()), sim.levenshtein_similarity(a, b))
    assert np.allclose(got, [0, 1 / 6, 2 / 7, 1 / 3, np.inf, 0, 1 / 3])


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("g", "b", 1), ("n", "x", 1)], "query_id string, id string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("g", "b")], "query_id string, id string")
    rows = ev.judged(ranked, gold)
    m = {r["query_id"]: (r["found_at"], r["mrr"], r["ap"]) for r in ev.mrr_ap(rows).collect()}
    assert m == {"q": (2, 0.5, 0.5), "g": (1, 1.0, 1.0), "n": (0, 0.0, 0.0)}
    standard, other = ({r["query_id"]: r["ndcg_1"] for r in ev.ndcg(rows, bit_length=b).collect()} for b in (False, True))
    assert standard == {"q": 0.0, "g": 1.0, "n": 0.0} and other["g"] == 0.5
    assert {r["query_id"]: r["p_2"] for r in ev.precision_recall(rows).collect()}["q"] == 0.5


# chunks, triples, log

def test_chunks():
    s = ["x" * 1600, "y" * 2800, "z" * 600]
    assert [(len(c), o) for c, o in graph.chunks(s, 1000, 150, 200, 2000)] == [(1600, 0), (2800 + 1 + 600, 0)]
    assert graph.chunks(["a" * 400] * 12, 300, 100, 50, 400) == [(" ".join(["a" * 400] * 3), 400)] * 5 + [(" ".join(["a" * 400] * 2), 0)]
    assert graph.chunks([], 1000, 150, 200, 2000) == []


def test_triples_from_replies(spark):
    rows = [("c1", '{"triples": [["a", "is", "b"], ["x", "y"], ["a", " ", "b"]]}'), ("c2", 'Sure! {"triples": [["s", "p", "o", "more"]]} Done.'), ("c3", "{broken"), ("c4", None)]
    got = graph.parse_triples(spark.createDataFrame(rows, "chunk_id string, reply string")).collect()
    assert sorted((r["chunk_id"], r["subject"], r["predicate"], r["object"]) for r in got) == [("c1", "a", "is", "b"), ("c2", "s", "p", "o")]

    def client(p):
        if "bad" in p:
            raise RuntimeError("insufficient credit")
        return '{"triples": [["k", "l", "m"]]}'

    out = graph.extract(spark.createDataFrame([("1", "good"), ("2", "bad")], "chunk_id string, content string"), client)
    assert [r["chunk_id"] for r in out.collect()] == ["1"]
    assert one(spark, T.credit_error(F.lit("Insufficient Credits")), T.credit_error(F.lit("timeout"))) == (True, False)


def test_log(spark):
    log = spark.createDataFrame([("a", "pending", 1, 1, 0), ("a", "completed", 2, 2, 4), ("b", "pending", 1, 3, 0), ("b", "failed", 2, 4, 0), ("c", "pending", 1, 5, 0)], "chunk_id string, status string, at int, ord int, triple_count int")
    assert {r["status"]: (r["n"], r["triples"]) for r in graph.log_summary(log).collect()} == {"pending": (3, 0), "completed": (1, 4), "failed": (1, 0)}
    assert {r["chunk_id"]: r["status"] for r in graph.latest_status(log).collect()} == {"a": "completed", "b": "failed", "c": "pending"}
    chunks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "chunk_id string")
    assert {r["chunk_id"] for r in graph.unfinished(chunks, log).collect()} == {"c", "d"}


# sources, sinks, streams

def test_corpus_lines(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("1,a, b\n\nnocomma\n1,c\n 2 , d \n")
    assert {r["context_id"]: r["text"] for r in readers.corpus(spark, str(p)).collect()} == {"1": "c", "2": "d"}
    assert readers.corpus_lines(spark, str(p)).count() == 3


def test_other_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert {r["phrase"]: r["freq"] for r in readers.phrase_counts(spark, put("p.txt", "a:3\nb:x\nc:d:4\ne:1\n"), 2).collect()} == {"a": 3}
    assert [(r["context_id"], r["x"]) for r in readers.coordinates_json(spark, put("c.json", json.dumps({"k": {"x": 1, "y": 2}, "l": {"x": 1}}))).collect()] == [("k", 1)]
    assert readers.coordinates_csv(spark, put("c.csv", "id,x,y\na,1,2\nb,1\n")).count() == 1
    assert [(r["x"], r["y"]) for r in readers.coordinates_quoted(spark, put("q.csv", 'id,at\na,"1, 2"\nb,zz\n')).collect()] == [(1.0, 2.0)]
    assert {r["idx"] for r in readers.passages(spark, put("d.json", json.dumps([{"title": "t", "text": "x"}, {"title": "u", "text": "y", "idx": 9}]))).collect()} == {0, 9}
    assert sorted((r["y"], r["x"], r["value"]) for r in readers.tsv_matrices(spark, put("m.tsv", "1\t2\n3\t4\n")).collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    assert readers.triples(spark, put("t.csv", "s,p,o,c\na,b,c,1\na, ,c,1\n")).count() == 1
    assert [(r["id"], r["cell"], r["value"]) for r in readers.fingerprint_cache(spark, put("f.json", json.dumps({"k": {"coordinates": [[1, 2]], "values": [0.5]}})), 4).collect()] == [("k", 6, 0.5)]
    assert readers.entries(spark, put("e.jsonl", '{"id": "1", "question": "q", "paragraphs": [{"idx": 0, "title": "t", "paragraph_text": "x", "is_supporting": true}]}\n')).first()["paragraphs"][0]["is_supporting"]
    (tmp_path / "bits").mkdir()
    (tmp_path / "bits" / "big%20cat.json").write_text(json.dumps({"grid_size": 4, "active_bits": [3, 5]}))
    assert {(r["phrase"].replace("%20", " "), r["cell"]) for r in readers.bit_lists(spark, str(tmp_path / "bits")).collect()} == {("big cat", 3), ("big cat", 5)}
    lines = readers.passages_to_lines(spark.createDataFrame([(1, "t", "a\nb")], "idx int, title string, text string"))
    assert lines.first()["value"] == "1,t: a b"


def test_artifacts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 6, 2.0), ("b", 0, 3.0)], "e string, cell long, value double")
    sinks.fingerprints(df, "e", str(tmp_path / "fp"), 4)
    assert readers.table(spark, str(tmp_path / "fp" / "cells"), ["e", "cell"]).count() == 3
    with pytest.raises(ValueError):
        readers.table(spark, str(tmp_path / "fp" / "cells"), ["nope"])
    assert {r["e"]: r["vector"][6] for r in sinks.dense(df, "e", 4).collect()} == {"a": 2.0, "b": 0.0}
    sinks.batches(spark.range(250).coalesce(1), str(tmp_path / "b"), 100)
    assert len(list((tmp_path / "b").glob("part-*.json"))) == 3
    assert "| a | 1 |" in sinks.report(spark.createDataFrame([("a", 1.0)], "k string, v double"))


def test_stream_of_contexts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "solar power"), (2, "solar panels")], "id long, body string").write.parquet(src)
    stream = ingest.contexts(spark, src, "id long, body string", "id", "body")
    ingest.ingest(stream, str(tmp_path / "posts"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(3, "wind power")], "id long, body string").write.mode("append").parquet(src)
    ingest.ingest(ingest.contexts(spark, src, "id long, body string", "id", "body"), str(tmp_path / "posts"), str(tmp_path / "cp")).awaitTermination()
    assert {r["phrase"]: r["df"] for r in ingest.weights(spark, str(tmp_path / "posts")).collect()} == {"solar": 2, "power": 2}
