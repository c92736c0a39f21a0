"""Fingerprints of documents are added up in blocks, not as a row for each phrase, document and cell."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridprint.operators import blocks as bl
from gridprint.operators import fingerprints as fp
from gridprint.operators import query as qu
from gridprint.operators import vocabulary as vo
from gridprint.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_blocks_give_the_sums_of_the_joined_rows(spark):
    """Prints of a few and of many cells, ids that are strings."""
    docs = catalog.docs(spark, SF)
    posts = vo.postings(docs, (1,))
    idf = vo.idf(vo.vocabulary(posts), docs.count())
    tcm = vo.term_context(posts, idf)
    at = catalog.doc_cells(spark, SF)
    prints = fp.phrase_fingerprints(fp.phrase_counts(tcm, at))
    want = {(str(r[0]), r[1]): r[2] for r in fp.accumulate(tcm, prints, "context_id").collect()}
    named = posts.join(at, "context_id").select("phrase", F.col("context_id").cast("string").alias("context_id"), "cell")
    got = bl.documents(named, docs.select(F.col("context_id").cast("string").alias("context_id")), catalog.GRID, bl.as_rows(), "context_id string, cell long, value double", F.col("cell")).collect()
    assert len(got) == len({(r[0], r[1]) for r in got}) > 1000
    assert {k for k, v in want.items() if abs(v) > 1e-6} <= {(r[0], r[1]) for r in got}
    assert all(abs(want[r[0], r[1]] - r[2]) < 1e-6 for r in got)


@pytest.mark.parametrize("name", ["doc_accumulate", "activation_histogram", "fp_stats", "fp_validate", "top_cells", "sdr_binary", "sparsify_ties", "sparsify_morton", "sparsify_topk", "peak_detect", "gaussian_smooth", "overlap_cells", "fp_overlap", "difference_map", "fp_merge"])
def test_no_join_by_phrase(spark, name):
    assert not re.search(r"Join.*phrase", plan(catalog.QUERIES[name](spark, SF)))


def test_numbers_come_back():
    x = np.array([0, 1, 255, 256, -3, 2**40])
    assert (bl._numbers(bl._bytes(x)) == x).all() and len(bl._numbers(bl._bytes(x[:0]))) == 0


@pytest.mark.parametrize("kind", [pa.int64(), pa.int32(), pa.string()])
def test_postings_come_back_packed(monkeypatch, kind):
    """All of them, phrase by phrase, in less than a row each takes; ranges that are too large are opened in parts."""
    draw = np.random.default_rng(2)
    n = 50_000
    h = draw.integers(-(2**63), 2**63 - 1, 4000)[draw.integers(0, 4000, n)]
    h[:3] = [-(2**63), 2**63 - 1, 0]
    ids = np.sort(draw.integers(-50, 5000, n))
    rows = pa.RecordBatch.from_arrays([pa.array(h), pa.array(draw.integers(0, 2, n)), pa.array(ids).cast(kind), pa.array(np.abs(ids) % 1024), pa.array(np.abs(ids) % 3)], ["h", "g", "context_id", "cell", "block"])
    pieces = pa.Table.from_batches(bl._deal(7, 1024)(iter([rows.slice(0, 30_000), rows.slice(30_000)]))).sort_by("part")
    assert len(set(pieces["part"].to_pylist())) == 7
    assert kind == pa.string() or sum(len(x.as_py()) for k in bl.PIECE for x in pieces[k]) < 12 * n
    monkeypatch.setattr(bl, "CHUNK", 2000)
    back = pa.Table.from_batches(bl._undeal(iter(pieces.to_batches())))
    got, want = (list(zip(*(t.column(k).to_pylist() for k in range(5)), strict=True)) for t in (back, pa.Table.from_batches([rows])))
    assert sorted(got) == sorted(want) and [x[:2] for x in got] == sorted(x[:2] for x in got)


def test_postings_are_packed_before_they_are_dealt(spark):
    assert re.search(r"RepartitionByExpression \[part", plan(catalog.fp_merge(spark, SF)))


@pytest.mark.parametrize("name", ["doc_ranking", "score_gaps"])
def test_cells_of_documents_are_not_gathered(spark, name):
    assert not re.search(r"collect_list\(struct\(cell", plan(catalog.QUERIES[name](spark, SF)))


def test_only_the_sample_is_stored(spark, monkeypatch):
    """The same documents as fp.diversity takes of all, and the same result."""
    sizes = []
    monkeypatch.setattr(catalog, "store", lambda df, name: sizes.append(df.count()) or df)
    got = catalog.diversity_sample(spark, SF).first()
    want = fp.diversity(catalog.doc_prints(spark, SF), "context_id").first()
    assert sizes and max(sizes) <= 200
    assert got["n_pairs"] == want["n_pairs"] and abs(got["diversity"] - want["diversity"]) < 1e-9


def test_grids_together_as_one_by_one():
    draw = np.random.default_rng(1)
    some = [np.zeros((32, 32)), np.ones((32, 32)), *(np.where(draw.random((32, 32)) < p, np.round(draw.random((32, 32)) * 9, d), 0) for p in (0.02, 0.3, 0.9, 1) for d in (0, 6) for _ in range(8))]
    some[5][3, 4] = 1000
    got = fp.topological_all(np.array(some))
    for x, y in zip(some, got, strict=True):
        assert np.array_equal(fp.topological(x), y)


def test_grids_are_not_grouped_by_a_shuffle(spark):
    assert "FlatMapGroups" not in plan(catalog.sdr_topological(spark, SF))


@pytest.mark.parametrize("kind", [pa.int64(), pa.int32(), pa.string()])
def test_blocks_come_packed(kind):
    """Every pair of phrase and document, with the phrase's print, in less room than numbers that are apart from their like."""
    draw = np.random.default_rng(3)
    n, size = 200_000, 4096
    h = draw.integers(-(2**63), 2**63 - 1, 60_000)[(60_000 * draw.random(n) ** 3).astype(int)]
    ids, at = np.unique(np.stack([h, draw.integers(-500, 9000, n)]), axis=1)
    cell, block = at * 37 % size, at % 4
    rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids % 3), pa.array(at).cast(kind), pa.array(cell), pa.array(block)], ["h", "g", "context_id", "cell", "block"])
    pieces = pa.Table.from_batches(bl._deal(3, size)(iter([rows]))).sort_by("part")
    got, room = [], 0
    for batch in bl._pack(2, size)(iter(pieces.to_batches())):
        row = {x: batch.column(k)[0] for k, x in enumerate(bl.NAMES)}
        line, m, df, nc, steps, count = (bl._numbers(row[x].as_py()) for x in bl.PARTS if x != "ids")
        room += sum(len(row[x].as_py()) for x in bl.PARTS)
        named = bl._named(row["contexts"], row["ids"].as_py())
        own = np.array(named.take(pa.array(np.cumsum(line) % len(named))).to_pylist(), object)
        cells = np.cumsum(steps) % size
        for a, b, c, d, k in zip(np.cumsum(m) - m, np.cumsum(m), np.cumsum(nc) - nc, np.cumsum(nc), df, strict=True):
            got.append((row["block"].as_py(), tuple(sorted(map(int, own[a:b]))), int(k), tuple(zip(cells[c:d].tolist(), count[c:d].tolist(), strict=True))))
    want, pairs = [], 0
    cuts = np.append(bl._starts(ids), len(ids))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= 2:
            pairs += b - a
            print_ = tuple(zip(*(x.tolist() for x in np.unique(cell[a:b], return_counts=True)), strict=True))
            want += [(int(k), tuple(sorted(at[a:b][block[a:b] == k].tolist())), int(b - a), print_) for k in np.unique(block[a:b])]
    assert sorted(got) == sorted(want)
    assert room < 6 * pairs


@pytest.mark.parametrize("kept", [1 << 20, 100])
def test_a_block_is_added_up_in_several_tables(spark, monkeypatch, kept):
    """Prints come once to a block that has more documents than a table; packed phrases stay in memory or go to a file."""
    monkeypatch.setattr(bl, "KEPT", kept)
    monkeypatch.setattr(bl, "TABLE", 30)
    draw = np.random.default_rng(4)
    size = 64
    h, at = np.unique(np.stack([(400 * draw.random(6000) ** 2).astype(np.int64), draw.integers(0, 100, 6000)]), axis=1)
    rows = pa.RecordBatch.from_arrays([pa.array(h), pa.array(h % 5), pa.array(at), pa.array(at * 7 % size), pa.array(at * 0)], ["h", "g", "context_id", "cell", "block"])
    packed = [*bl._pack(2, size)(bl._deal(1, size)(iter([rows])))]
    nothing = [pa.array([None], pa.binary())] * len(bl.PARTS)
    head = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([list(range(100))], pa.list_(pa.int64())), *nothing, pa.array(["a"])], bl.NAMES)
    seen = []
    list(bl._sum(lambda ids, lines, labels: seen.append((ids.to_pylist(), lines.copy(), labels)) or iter(()), 100, size, True)(iter([head, *packed])))
    assert [len(x[0]) for x in seen] == [30, 30, 30, 10] and all(len(x[2]) == len(x[0]) for x in seen)
    want = np.zeros((100, size))
    for k in np.unique(h):
        own = at[h == k]
        if len(own) >= 2:
            count = np.bincount(own * 7 % size, minlength=size)
            want[own] += count / count.max() * np.log(100 / (len(own) + 1))
    assert np.allclose(np.concatenate([x[1] for x in seen]), want)


@pytest.mark.parametrize("bits", [2, 17])
def test_phrases_of_common_words_are_numbered(spark, monkeypatch, bits):
    """The same fingerprints as from phrases that are strings, whether few or all words have numbers."""
    monkeypatch.setattr(bl, "BITS", bits)
    common = bl._common
    monkeypatch.setattr(bl, "_common", lambda words, n: common(words, n)[: 1 << bits])
    docs = catalog.docs(spark, SF)
    read = lambda posts: sorted(bl.documents(posts, docs.select("context_id"), catalog.GRID, bl.as_rows(), "context_id {kind}, cell long, value double").collect())
    got, want = read(bl.neighbours(docs)), read(vo.postings(docs, (2,)))
    assert len(got) > 1000 and [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=0, atol=1.5e-6)


def test_numbers_and_hashes_of_phrases_are_apart():
    a, b = (x.ravel() for x in np.meshgrid(np.arange(300) * 400, np.arange(131000, 131072)))
    h = bl._number(a, b)
    assert len(np.unique(h)) == len(a) and not (h & (1 << bl.LOW) - 1).any()
    ids = [[1, 2, 3, None, 1, 2], [2, 1], [7, 8, 1, 2], [], None, [5], [3, 0]]
    rows = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(range(7)), pa.array(range(7)), pa.array(ids, pa.list_(pa.int64()))], ["context_id", "cell", "block", "words"])
    got = [(h, g, k) for x in bl._pairs(np.array([1, 2, 7]))(iter([rows])) for h, g, k in zip(*(x.column(k).to_pylist() for k in range(3)), strict=True)]
    assert [k for *_, k in got] == [0, 0, 1, 2, 2, 2, 6] and sum(g == bl.NUMBERED for _, g, _ in got) == 3
    assert len({x[:2] for x in got}) == 6 and {k for *x, k in got if x[1] == bl.NUMBERED} == {0, 1, 2}


def test_numbered_phrases_take_less_room():
    """Less than half of what hashes of phrases take, words as unequal as in texts."""
    draw = np.random.default_rng(5)
    words = (draw.random((2000, 200)) ** 6 * 1e5).astype(np.int64)
    rows = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(np.arange(2000) % 1024), pa.array(np.arange(2000) % 3), pa.array(list(words))], ["context_id", "cell", "block", "words"])
    room = [sum(len(x.as_py()) for batch in bl._deal(7, 1024)(bl._pairs(common)(iter([rows]))) for k in ("h", "g", "rest") for x in batch.column(k)) for common in (np.arange(100_000), np.zeros(0, np.int64))]
    assert room[0] < room[1] / 2


@pytest.mark.parametrize("name", ["peak_detect", "score_gaps"])
def test_phrases_are_not_dealt_as_strings(spark, name):
    assert "xxhash64(phrase" not in plan(catalog.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["doc_ranking", "score_gaps"])
def test_documents_are_ranked_where_they_are_added_up(spark, name):
    assert not re.search(r"MapInArrow run\(context_id#\d+L?, cells#", plan(catalog.QUERIES[name](spark, SF)))


def test_ranking_of_lines_as_of_lists(spark, monkeypatch):
    """Also with more queries than go to all tasks at once."""
    docs = catalog.docs(spark, SF)
    q = spark.createDataFrame([(f"q{i}", int(c), float(c % 7 + 1)) for i in range(9) for c in range(i, 1024, 50 + 9 * i)], "query_id string, cell long, value double")
    lines = lambda emit, schema: bl.documents(bl.neighbours(docs), docs.select("context_id"), catalog.GRID, emit, schema)
    want = sorted(qu.rank(q, catalog.doc_lists(spark, SF), 5).collect())
    assert len(want) == 45 and sorted(qu.rank(q, lines, 5).collect()) == want
    monkeypatch.setattr(qu, "QUERY_CELLS", 60)
    assert sorted(qu.rank(q, lines, 5).collect()) == want
    assert qu.rank(q.limit(0), lines, 5).count() == 0


def test_postings_of_some_phrases(spark):
    """The same as a join of all; phrases that begin or end alike, and one that no document has."""
    docs = catalog.docs(spark, SF)
    posts = vo.postings(docs, (2,))
    some = posts.groupBy("phrase").count().where("count > 1").select("phrase").unionByName(spark.createDataFrame([("no such",)], "phrase string"))
    got = [tuple(r) for r in bl.postings_of(some, bl.neighbours(docs)).collect()]
    want = [tuple(r) for r in posts.join(some, "phrase", "left_semi").collect()]
    assert len(want) > 1000 and sorted(got) == sorted(want)
