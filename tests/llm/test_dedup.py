import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridprint.llm import exact_dedup, near_dedup
from gridprint.llm.hashing import shingles

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, rid int, digest string"
ODD = [(1, None), (2, ""), (2, ""), (None, "A b"), (4, "a B"), (4, "a b"), (5, "word " * 30_000), (6, "É"), (7, "é"), (8, "one two"), (9, "one two"), (10, "   ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# exact

def check_exact(rows, got):
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(low(t), []).append(i)
    want = sorted((hashlib.sha256(low(t).encode()).hexdigest(), -1 if i is None else i, max((x for x in by[low(t)] if x is not None), default=None), len(by[low(t)])) for i, t in rows)
    assert want == sorted((r["sha"], -1 if r["doc_id"] is None else r["doc_id"], r["keep_id"], r["group_size"]) for r in got)
    assert sum(r["kept"] for r in got) == len(by)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_odd_rows(spark):
    check_exact(ODD, exact_dedup.groups(frame(spark, ODD)).collect())
    assert exact_dedup.groups(frame(spark, [])).count() == 0


def test_exact_whole_table_in_small_batches(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_exact(rows, exact_dedup.groups(docs.repartition(5), batch_bytes=1000, hot=2).collect())


def test_exact_bytes_are_compared_when_digests_collide(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + ODD
    got = exact_dedup.groups(docs.select("doc_id", "text").unionByName(frame(spark, ODD).select("doc_id", "text")), digest=lambda s: F.substring(s, 1, 1), hot=10)
    check_exact(rows, got.collect())


def test_exact_state_of_an_earlier_call(spark, tmp_path):
    state = str(tmp_path / "state")
    calls = [[(1, "A b"), (2, "c"), (5, "a B"), (3, None)], [(4, "a b"), (6, "C"), (7, "new"), (8, "")], [(9, "A B")]]
    want = [{1: (5, 2), 5: (5, 2), 2: (2, 1), 3: (3, 1)}, {4: (5, 3), 6: (6, 2), 7: (7, 1), 8: (8, 2)}, {9: (9, 4)}]
    for i, (rows, own) in enumerate(zip(calls, want, strict=True)):
        path = str(tmp_path / f"docs{i}")
        frame(spark, rows).write.parquet(path)
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.report(spark.read.parquet(path), state).collect()}
        assert got == own


def test_exact_text_of_an_earlier_call_is_compared(spark, tmp_path):
    """With digests that collide, only the file that the locator names can tell the texts apart."""
    state, ids = str(tmp_path / "state"), []
    for i, rows in enumerate([[(7, "one")], [(1, "two"), (2, "Two")]]):
        path = str(tmp_path / f"docs{i}")
        frame(spark, rows).write.parquet(path)
        ids = exact_dedup.groups(spark.read.parquet(path), digest=lambda s: F.lit("same"), state=state).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in ids} == {(1, 2, 2), (2, 2, 2)}


CLASHING = "id long, sha string, own_sha string, row string, n long, copy int, _id int, _sha int, _n int, _copy int, lang_pred string, score double, bits double, accepted boolean, rid int, root int, key int"


def test_stages_with_clashing_names(spark):
    from gridprint.llm import language_id, mixing

    names = [f.split()[0] for f in CLASHING.split(", ")]
    docs = frame(spark, [(i, t * 9) for i, t in enumerate(["a long text ", "A long text ", "other words here ", "a few more words "])]).select("doc_id", "text", F.lit("en").alias("lang"), *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in CLASHING.split(", ")])
    labels = spark.createDataFrame([(0, "x"), (2, "y")], "doc_id long, domain string")
    for out, n in ((language_id.accepted(docs), 4), (exact_dedup.distinct_texts(docs), 3), (near_dedup.representatives(docs), 3), (mixing.mixed(docs, labels, None), 4)):
        assert out.columns == ["doc_id", "text", "lang", *names]
        assert out.count() == n


def test_distinct_texts_keep_columns(spark):
    out = exact_dedup.distinct_texts(frame(spark, ODD))
    assert out.columns == ["doc_id", "text", "rid", "digest"] and out.count() == len({low(t) for _, t in ODD})


# near

def brute_components(rows):
    sets = [set(shingles(low(t)).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_near_links_that_no_hub_round_offers(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHARING", 1e-6)  # every member is alone in its group
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "some other text of more than five words")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.linked(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def check_near(rows, got):
    null = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(null, brute_components(rows))) == sorted(null((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_whole_table(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_near(rows, near_dedup.linked(docs).collect())


def test_near_odd_rows(spark):
    check_near(ODD, near_dedup.linked(frame(spark, ODD)).collect())
    assert near_dedup.linked(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_drifting_copies(spark, rounds):
    """A chain in which only neighbours are alike, a large group around one text, and texts that share half."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    rows, text = [], [rng.choice(words) for _ in range(120)]
    for _ in range(25):
        rows.append((len(rows), " ".join(text)))
        text = text[3:] + [rng.choice(words) for _ in range(3)]
    base = [rng.choice(words) for _ in range(150)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((len(rows), " ".join(copy)))
    shared = base[:60]
    for _ in range(20):
        rows.append((len(rows), " ".join(shared + [rng.choice(words) for _ in range(60)])))
    rng.shuffle(rows)
    check_near(rows, near_dedup.linked(frame(spark, rows), hub_rounds=rounds).collect())


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for n in (3, 40, 2000):
        for share in (0.3, 0.75, 0.95):
            a = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            k = max(1, int(n * share))
            x, y = np.unique(a[:n]), np.unique(np.concatenate([a[:k], a[n : 2 * n - k]]))
            sx, sy = near_dedup.sketch(x), near_dedup.sketch(y)
            assert (sx != near_dedup._EMPTY).all()
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append(abs((sx == sy).mean() - true))
    assert max(errors) < 0.2 and np.mean(errors) < 0.08


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    for v in root:
        assert got.get(v, v) == find(v)


def test_words_are_hashed_alike():
    assert np.array_equal(shingles("A b\tC d\x0be f"), shingles("a b c  d e f "))
    assert not np.array_equal(shingles("a b c d e"), shingles("a b c d  é"))
    assert len(shingles("a b")) == 1 and len(shingles(" \n")) == 0 and len(shingles(None)) == 0
    assert len(shingles("x " * 50)) == 1
    assert not np.array_equal(shingles("a b"), shingles("a b a b"))
