"""Suffix-array deduplication with a logarithmic index family.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier:
in a document with a smaller doc_id, or earlier in the same one.

Suffixes are grouped by anchor. A window (LENGTH bytes) is anchored at the
position in it whose K-byte string has the smallest hash, which depends on the
window's bytes alone, so equal windows have equal anchors at equal offsets.

1. Each task finds the anchors of its documents. An anchor's context is all
   bytes of the windows that it anchors. Of equal contexts only the first one of
   a batch travels; the windows of the others are matched at once. Rows are
   narrow: anchor hash, context hash, document, positions.
2. Per anchor hash, equal contexts (by two 64-bit hashes, of the anchor and of the
   whole context) are matched to the first; an anchor with one
   context left is finished, which is almost all of them. The rest fetch bytes.
3. Per anchor hash, a logarithmic family of suffix arrays takes the remaining
   windows in document order, batch by batch: a batch gets its suffix array, whose
   neighbours with a common prefix of LENGTH bytes repeat, is merge-scanned against
   the existing levels for such prefixes, and what is new becomes a level; levels of
   similar size are merged, so there are logarithmically many. Arrays are in the
   order of their suffixes' bytes, of which the first LENGTH count.
   Anchors with very many contexts are split by the window's offset in them.

All windows of all documents are covered. Defined cases: null or short text
loses nothing; rows that repeat a doc_id, and null doc_id (before all others),
come in the order of their row numbers; matches never cross documents; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprint.llm.common import by_size, materialise, scratch_path, ship, with_row_id
from gridprint.llm.hashing import BASE_2, U, mix, prefix, ranges

LENGTH, K = 100, 24
#: Bytes that are hashed at once, windows of a batch of the index, contexts of an anchor beyond which its offsets are split.
BLOCK, BATCH, HOT = 1 << 20, 100_000, 4_000
#: Bytes of texts whose anchors are sorted at once; equal contexts among them are matched before anything travels.
SLICE = 16 << 20


def pieces(data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, owner of each byte, position of each byte in its owner) of at most BLOCK bytes or so. Long documents come in pieces that overlap by LENGTH - 1."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for i, raw in enumerate(data):
        whole = np.frombuffer(raw, np.uint8)
        for at in range(0, len(whole) - LENGTH + 1, BLOCK - LENGTH + 1):
            part = whole[at : at + BLOCK]
            if size + len(part) > BLOCK and held:
                yield _piece(held)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield _piece(held)


def _piece(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = [len(p) for _, _, p in held]
    return np.concatenate([p for _, _, p in held]), np.repeat([i for i, _, _ in held], n), np.concatenate([np.arange(a, a + len(p)) for _, a, p in held])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(data: np.ndarray, owner: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Per anchor: h (hash of its K bytes), c (hash of its context and its offset there), owner, first (start of its first window), off (the anchor's offset from there), n (windows), in positions of the owner; lo, the start in data."""
    n = len(data)
    sums, sums_2 = prefix(data), prefix(data, BASE_2)
    start = np.arange(n - K + 1)
    h = ranges(sums, start, start + K)
    low = U((1 << 20) - 1)
    least = sliding_min(h & ~low | start.astype(U), LENGTH - K + 1)
    pos = (least & low).astype(np.int64)
    valid = owner[: n - LENGTH + 1] == owner[LENGTH - 1 :]
    # pieces of one owner lie apart, or follow each other only with a gap in positions
    valid &= at[LENGTH - 1 :] - at[: n - LENGTH + 1] == LENGTH - 1
    windows = np.flatnonzero(valid)
    if not len(windows):
        return {k: np.zeros(0, np.int64) for k in ("h", "c", "owner", "first", "off", "n", "lo")}
    p = pos[windows]
    edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    first = windows[edge]
    last = windows[np.concatenate([edge[1:] - 1, [len(windows) - 1]])]
    p = p[edge]
    off, count = p - first, last - first + 1
    c = ranges(sums_2, first, last + LENGTH, BASE_2) ^ mix(off.astype(U) + U(7)) ^ ranges(sums, first, last + LENGTH)
    return {"h": h[p].view(np.int64), "c": c.view(np.int64), "owner": owner[first], "first": at[first], "off": off, "n": count, "lo": first}


FOUND = "kind int, h long, c long, o long, first int, off int, n int"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(o, text) -> anchors (kind 0) and matched windows (kind 1; h is random there, n windows from first on)."""
    for batch in (part for whole in batches for part in by_size(whole, 1, SLICE)):
        o = batch.column(0).to_numpy(zero_copy_only=False)
        parts: dict[str, list[np.ndarray]] = {}
        for data, owner, at in pieces([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]):
            got = anchors(data, owner, at)
            for k in ("h", "c", "owner", "first", "off", "n"):
                parts.setdefault(k, []).append(got[k])
        if not parts:
            continue
        a = {k: np.concatenate(v) for k, v in parts.items()}
        a["o"] = o[a.pop("owner")]
        yield from emit(a, first_of_class(a))


def first_of_class(a: dict[str, np.ndarray]) -> np.ndarray:
    """Whether a row is the first, by document and position, of those with its anchor and context."""
    sort = np.lexsort((a["first"], a["o"], a["c"], a["h"]))
    h, c = a["h"][sort], a["c"][sort]
    lead = np.ones(len(sort), bool)
    lead[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    out = np.zeros(len(sort), bool)
    out[sort[lead]] = True
    return out


def emit(a: dict[str, np.ndarray], lead: np.ndarray, size: int = 500_000) -> Iterator[pa.RecordBatch]:
    kind = np.where(lead, 0, 1).astype(np.int32)
    h = np.where(lead, a["h"], mix(a["o"].astype(U) ^ a["h"].view(U)).view(np.int64))
    cols = {"kind": kind, "h": h, "c": np.where(lead, a["c"], 0), "o": a["o"], "first": a["first"].astype(np.int32), "off": a["off"].astype(np.int32), "n": a["n"].astype(np.int32)}
    for k in range(0, len(h), size):
        yield pa.RecordBatch.from_arrays([pa.array(v[k : k + size]) for v in cols.values()], list(cols))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of some anchor hashes -> matched windows (kind 1), and contexts that the index needs (kind 2; c is the number of contexts of the anchor)."""
    got = list(batches)
    if not got:
        return
    names = ("kind", "h", "c", "o", "first", "off", "n")
    a = {k: np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i, k in enumerate(names)}
    del got
    known = a["kind"] == 1
    yield from _rows({k: v[known] for k, v in a.items()}, 1, a["h"][known])
    a = {k: v[~known] for k, v in a.items()}
    if not len(a["h"]):
        return
    lead = first_of_class(a)
    yield from _rows({k: v[~lead] for k, v in a.items()}, 1, a["h"][~lead])
    a = {k: v[lead] for k, v in a.items()}
    _, index, n = np.unique(a["h"], return_inverse=True, return_counts=True)
    contexts = n[index]
    more = contexts > 1
    rest = {k: v[more] for k, v in a.items()} | {"c": contexts[more]}
    yield from _rows(rest, 2, rest["h"])


def _rows(a: dict[str, np.ndarray], kind: int, h: np.ndarray, size: int = 500_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(h), size):
        s = slice(k, k + size)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[s]), kind, np.int32)), pa.array(h[s]), pa.array(a["c"][s].astype(np.int64)), *(pa.array(a[x][s].astype(np.int64 if x == "o" else np.int32)) for x in ("o", "first", "off", "n"))], ["kind", "h", "c", "o", "first", "off", "n"])


CONTEXT = "h long, part int, o long, first int, off int, skip int, n int, bytes binary"


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(o, text, needs array<struct<h, c, first, off, n>>) -> the bytes of each needed context; of an anchor with many contexts, a part per ten windows' offsets."""
    for batch in batches:
        rows: list[tuple] = []
        for o, text, needs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for x in needs:
                first, off, n = x["first"], x["off"], x["n"]
                if x["c"] <= HOT:
                    rows.append((x["h"], 0, o, first, off, 0, n, raw[first : first + n + LENGTH - 1]))
                    continue
                # window k of the context has its anchor at off - k
                for part in range((off - n + 1) // 10, off // 10 + 1):
                    lo, hi = max(0, off - (10 * part + 9)), min(n - 1, off - 10 * part)
                    if lo <= hi:
                        rows.append((x["h"], 1 + part, o, first, off, lo, hi - lo + 1, raw[first + lo : first + hi + LENGTH]))
            if len(rows) >= 50_000:
                yield _contexts(rows)
                rows = []
        if rows:
            yield _contexts(rows)


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "part", "o", "first", "off", "skip", "n", "bytes"])


#: A suffix up to the length that counts: bytes that numpy sorts and searches as strings.
SUFFIX = np.dtype(f"S{LENGTH}")


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each pair of suffixes, LENGTH at most."""
    same = a.view(np.uint8).reshape(-1, LENGTH) == b.view(np.uint8).reshape(-1, LENGTH)
    return np.where(same.all(1), LENGTH, same.argmin(1))


class Family:
    """Levels of suffix arrays, in the order of their suffixes: each LENGTH bytes of distinct suffixes."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """Take a batch in document order; whether each suffix's first LENGTH bytes have come before, in it or in a level."""
        seen = np.zeros(len(suffixes), bool)
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        repeats = common_prefix(array[1:], array[:-1]) >= LENGTH
        seen[order[1:][repeats]] = True
        lead = np.concatenate([[True], ~repeats]) if len(array) else np.zeros(0, bool)
        array, order = array[lead], order[lead]
        fresh = np.ones(len(array), bool)
        for level in self.levels:
            # merged with a level, an equal suffix stands right behind
            at = np.minimum(np.searchsorted(level, array), len(level) - 1)
            fresh &= common_prefix(array, level[at]) < LENGTH
        seen[order[~fresh]] = True
        self._push(array[fresh])
        return seen

    def _push(self, array: np.ndarray) -> None:
        while self.levels and len(self.levels[-1]) <= 2 * len(array):
            old = self.levels.pop()
            array = np.insert(old, np.searchsorted(old, array), array)
        if len(array):
            self.levels.append(array)


def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All contexts of some anchors -> matched runs (o, start, end)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    col = {k: table.column(k).to_numpy() for k in ("h", "part", "o", "first", "off", "skip", "n")}
    chunks = table.column("bytes").chunks
    text = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[np.frombuffer(c.buffers()[1], np.int32)[c.offset] : np.frombuffer(c.buffers()[1], np.int32)[c.offset + len(c)]] for c in chunks])
    size = col["n"].astype(np.int64) + LENGTH - 1
    begin = np.cumsum(size) - size
    order = np.lexsort((col["first"], col["o"]))
    family, span = Family(), np.arange(LENGTH)
    at = 0
    total = np.cumsum(col["n"][order].astype(np.int64))
    while at < len(order):
        until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH, side="right")))
        rows = order[at:until]
        at = until
        n = col["n"][rows].astype(np.int64)
        own = np.repeat(np.arange(len(rows)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        starts = begin[rows][own] + step
        start = col["first"][rows].astype(np.int64)[own] + col["skip"][rows].astype(np.int64)[own] + step
        o = col["o"][rows][own]
        sort = np.lexsort((start, o))
        seen = np.zeros(len(own), bool)
        seen[sort] = family.add(text[starts[sort][:, None] + span].view(SUFFIX)[:, 0])
        hit = np.flatnonzero(seen)
        if len(hit):
            cut = np.concatenate([[True], (own[hit][1:] != own[hit][:-1]) | (start[hit][1:] != start[hit][:-1] + 1)])
            edge = np.flatnonzero(cut)
            last = np.concatenate([edge[1:] - 1, [len(hit) - 1]])
            yield pa.RecordBatch.from_arrays([pa.array(o[hit][edge]), pa.array(start[hit][edge].astype(np.int64)), pa.array((start[hit][last] + LENGTH).astype(np.int64))], ["o", "start", "end"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs array<struct<start, end>>) -> (doc_id, n_bytes, kept, spans), runs joined."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        n, kept, spans = [], [], []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            out, parts, at = [], [], 0
            for r in sorted(runs or [], key=lambda r: r["start"]):
                if out and r["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], r["end"])
                else:
                    out.append({"start": r["start"], "end": r["end"]})
            for r in out:
                parts.append(raw[at : r["start"]])
                at = r["end"]
            n.append(len(raw))
            kept.append(b"".join([*parts, raw[at:]]))
            spans.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "n_bytes", "kept", "spans"])


def ordered(docs: DataFrame) -> DataFrame:
    """(o, doc_id, text): o is unique and in the order of doc_id; doc_id itself where that is so already."""
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if repeated.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("o"), "doc_id", "text")
    rows = materialise(with_row_id(docs.select("doc_id", "text")), "rows")
    rank = materialise(rows.select("rid", "doc_id").orderBy(F.asc_nulls_first("doc_id"), "rid").select("rid", F.monotonically_increasing_id().alias("o")), "ranks")
    return rows.join(rank, "rid").select("o", "doc_id", "text")


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (remaining bytes), spans (removed runs of bytes: start, end) per row."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one copy of the texts in the shared folder, bucketed, so that later joins by document move only narrow rows
    name = f"gridprint_suffix_{uuid.uuid4().hex[:12]}"
    ordered(docs).repartition(parts, "o").write.bucketBy(parts, "o").option("compression", "zstd").option("path", scratch_path(spark, "suffix-texts")).saveAsTable(name, format="parquet")
    rows = spark.table(name)
    ids = docs.schema["doc_id"].dataType.simpleString()
    found = rows.select("o", "text").mapInArrow(scan, FOUND).repartition(parts, "h").mapInArrow(settle, FOUND)
    found = materialise(found, "anchors")
    needs = found.where("kind = 2").groupBy("o").agg(F.collect_list(F.struct("h", "c", "first", "off", "n")).alias("needs"))
    wanted = rows.select("o", "text").join(needs.hint("merge"), "o").select("o", "text", "needs").mapInArrow(contexts, CONTEXT)
    late = wanted.repartition(parts, "h", "part").mapInArrow(index, "o long, start long, end long")
    early = found.where("kind = 1").select("o", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("n") + LENGTH - 1).cast("long").alias("end"))
    runs = early.unionByName(late).groupBy("o").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    joined = rows.join(runs.hint("merge"), "o", "left").select("doc_id", "text", "runs")
    spark.sql(f"DROP TABLE {name}")  # its name only: the files are not in the warehouse
    return joined.mapInArrow(cut, f"doc_id {ids}, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
