"""Measures for blocks of pairs against the plain column expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridprint.operators import pairs as pr
from gridprint.operators import similarity as sim
from gridprint.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(spark, rows):
    """(queries, rows, all pairs) of lists of numbers."""
    v = spark.createDataFrame(list(enumerate(rows)), "id long, vector array<double>")
    q = v.where("id % 3 = 0").select(F.col("id").alias("q_id"), F.col("vector").alias("q_vector"))
    return q, v, sim.against(q, v).where("q_id <> id")


def key(df):
    return sorted(tuple(r) for r in df.collect())


def test_edits_of_short_and_long_strings():
    def plainly(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(last[j + 1] + 1, new[j] + 1, last[j] + (x != y)))
            last = new
        return last[-1]

    draw = np.random.default_rng(3)
    for size in (1, 2, 7, 63, 64):
        a, b = (draw.integers(0, 2, (12, size)) for _ in range(2))
        words = (a.astype(np.uint64) << np.arange(size, dtype=np.uint64)).sum(1, dtype=np.uint64)
        got = pr.edits(words, np.where(b.T > 0, np.uint64(0), ~np.uint64(0)), size)
        assert got.tolist() == [[plainly(x, y) for y in b] for x in a]


@pytest.mark.parametrize("rows", [[[1.0, -2.0, 0.5], [0.0, 0.0, 0.0], [0.25, 3.0, 0.5], [1.0, -2.0, 0.5]], [[1.0, 2.0], [1.0], None, [0.0, 3.0, 1.0]], [[0.0, float("nan")], [1.0, 2.0], [None, 1.0], [3.0, 1.0]]])
def test_measures_match_the_columns(spark, rows):
    """Vectors of one length, of several, null, and with odd numbers."""
    q, v, met = plain(spark, rows)
    a, b = F.col("q_vector"), F.col("vector")
    assert str(key(pr.pair_stats(q, v))) == str(key(met.select("q_id", "id", *sim.pair_stats(a, b))))
    assert str(key(pr.jaccard_set(q, v))) == str(key(met.select("q_id", "id", F.round(sim.jaccard_set(sim.active_cells(a), sim.active_cells(b)), 6))))
    assert str(key(pr.levenshtein(q, v))) == str(key(met.select("q_id", "id", F.round(sim.levenshtein_similarity(a, b), 6))))
    best = lambda df: key(sim.top_k(df, "q_id", [F.desc("score"), F.asc("id")], 2))
    assert str(best(pr.nearest(q, v, 2))) == str(best(met.select("q_id", "id", F.round(sim.cosine(a, b), 6).alias("score"))))


@pytest.mark.parametrize("name", ["jaccard_set", "levenshtein_sim", "pair_stats"])
def test_pairs_are_not_joined_row_by_row(spark, name):
    assert "NestedLoopJoin" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_candidates_are_ranked_once(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(catalog, "store", lambda df, name: sizes.append(df.count()) or df)
    n = catalog.block(spark, SF).count()
    assert catalog.candidate_filter(spark, SF).count() and sizes == [10 * n]
