import hashlib
import random

import numpy as np
import pytest

from gridprint.llm import suffix_dedup

N = suffix_dedup.LENGTH
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, o int")


def brute(rows):
    """rows in document order -> (n_bytes, n_removed, n_spans, sha) of each."""
    seen, out = set(), []
    for _, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - N + 1):
            w = raw[i : i + N]
            if w in seen:
                gone[i : i + N] = True
            seen.add(w)
        runs = int((gone[:-1] & ~gone[1:]).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, df, rows):
    got = suffix_dedup.report(df).collect()
    assert len(got) == len(rows)
    key = lambda i: (i is not None, i or 0)
    want = sorted((key(i), *x) for (i, _), x in zip(rows, brute(rows)))
    assert sorted((key(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(spark, docs, [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])


def planted(seed=1):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé fg\n") for _ in range(n))
    passage, long = text(150), text(5000)
    rows = [(0, long), (1, None), (2, ""), (3, "a" * 1500), (4, "ab " * 400), (5, text(99)), (6, long[100:4000] + text(10) + long[:300])]
    rows += [(10 + i, text(rng.randrange(120)) + passage[: rng.randrange(80, 151)] + text(rng.randrange(120))) for i in range(60)]
    rows += [(100 + i, long[:2000]) for i in range(5)]
    near = list(long)
    for i in range(110, 130):
        near[rng.randrange(len(near))] = "Z"
        rows.append((i, "".join(near)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_planted(spark, monkeypatch, small):
    rows = planted()
    if small:  # pieces of long documents, many levels, split anchors; in this process, as workers have their own settings
        monkeypatch.setattr(suffix_dedup, "BLOCK", 777)
        monkeypatch.setattr(suffix_dedup, "BATCH", 300)
        monkeypatch.setattr(suffix_dedup, "HOT", 3)
        run_locally(rows)
    else:
        check(spark, frame(spark, rows[::-1]), rows)


def run_locally(rows):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["o", "text"])
    settled = pa.Table.from_batches(list(suffix_dedup.settle(iter(list(suffix_dedup.scan(iter([batch.slice(0, 20), batch.slice(20)]))))))).to_pylist()
    runs, needs = {}, {}
    for r in settled:
        if r["kind"] == 1:
            runs.setdefault(r["o"], []).append({"start": r["first"], "end": r["first"] + r["n"] + N - 1})
        else:
            needs.setdefault(r["o"], []).append(r)
    text = dict(rows)
    wanted = pa.RecordBatch.from_arrays([pa.array(list(needs)), pa.array([text[o] for o in needs]), pa.array([[{k: r[k] for k in ("h", "c", "first", "off", "n")} for r in v] for v in needs.values()])], ["o", "text", "needs"])
    contexts = list(suffix_dedup.contexts(iter([wanted])))
    assert any(p > 0 for b in contexts for p in b.column("part").to_pylist())
    whole = pa.Table.from_batches(contexts)
    for part in sorted(set(whole.column("part").to_pylist())):
        own = whole.filter(pa.compute.equal(whole.column("part"), part))
        for b in suffix_dedup.index(iter(own.to_batches())):
            for r in b.to_pylist():
                runs.setdefault(r["o"], []).append(r)
    last = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows]), pa.array([[{"start": r["start"], "end": r["end"]} for r in runs.get(i, [])] for i, _ in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "text", "runs"])
    [got] = suffix_dedup.cut(iter([last]))
    mine = [(n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for n, k, s in zip(*(got.column(c).to_pylist() for c in ("n_bytes", "kept", "spans")))]
    assert mine == brute(rows)


def test_odd_rows(spark):
    long = "The quick brown fox. " * 12
    rows = [(None, long + "x"), (1, long), (1, long), (2, None), (3, "short"), (4, "y" + long)]
    check(spark, frame(spark, rows), rows)
    assert suffix_dedup.report(frame(spark, [])).count() == 0


def test_levels_grow_geometrically():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 3, 30_000).astype(np.uint8)  # with null bytes, also at the end
    suffixes = text[np.arange(0, len(text) - N)[:, None] + np.arange(N)].view(suffix_dedup.SUFFIX)[:, 0]
    family = suffix_dedup.Family()
    for part in np.array_split(suffixes, 64):
        assert not family.add(part).any()
    assert family.add(suffixes).all()
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == len(suffixes) and len(sizes) <= 8 and sizes == sorted(sizes, reverse=True)
    for level in family.levels:
        rows = [level[i : i + 1].tobytes() for i in range(len(level))]
        assert rows == sorted(rows)


def test_common_prefixes():
    rows = np.zeros((3, N), np.uint8)
    rows[1, 40], rows[2, N - 1] = 1, 1
    own = rows.view(suffix_dedup.SUFFIX)[:, 0]
    assert suffix_dedup.common_prefix(own[[0, 0, 0]], own).tolist() == [N, 40, N - 1]
