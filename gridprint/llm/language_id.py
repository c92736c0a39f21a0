"""Language identification with interpolated Kneser-Ney character models.

Counting runs over every learning row: each task counts character n-grams of
the highest order with numpy and one aggregation sums them per language. Further
aggregations derive the lower orders (continuation counts), and tasks that hold
whole histories turn counts to discounted probabilities. All n-grams are kept: the
driver passes chunks of sorted arrays on to files, which every executor fetches and
workers map, so no process holds the tables. Scoring looks every distinct n-gram of a block up by
binary search and sums log probabilities per document; the language with the
lowest cross-entropy a character wins.

Rejection is calibrated on the learned counts: their mean and deviation of
surprisal per language give the cross-entropy that a text of n characters may
have. A text beyond mean + z * deviation / sqrt(n) + slack is rejected.

Text is lower-cased, everything but letters becomes one space, and each text is
padded with spaces. Defined cases: null text or text without a letter gives
`und`, score 0, rejected; null lang is never learned from; rows with null
doc_id are scored but not learned from; if nothing was learned, every row is
`und`. Further columns are ignored.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridprint.llm.common import by_size, materialise, ship, sparing

ORDER = 4
DISCOUNT = 0.75
#: N-grams that a chunk of a stored array has about.
CHUNK = 100_000
#: Characters that are looked up at once, and bytes of texts that are decoded at once.
BLOCK, SLICE = 250_000, 4 << 20
Z, SLACK = 8.0, 1.0
UNKNOWN = "und"
_ALPHA: list[np.ndarray] = []


def alpha_table() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def letters(text: str | None) -> np.ndarray:
    """Code points of the letters, runs of others as one space, three spaces before and one after; empty without a letter."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = alpha_table()[cp] if len(cp) else np.zeros(0, bool)
    if not ok.any():
        return np.zeros(0, np.int64)
    cp = np.where(ok, np.minimum(cp, 0xFFFF), 32).astype(np.int64)
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    cp = cp[keep]
    if cp[-1] != 32:
        cp = np.append(cp, 32)
    return np.concatenate([np.full(ORDER - 1, 32, np.int64), cp])


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """(code points, row of each predicted character, whether it is predicted, rows without letters) of at most about BLOCK characters; longer texts are cut with an overlap."""
    parts, owners, empty, size = [], [], [], 0
    for i, t in enumerate(texts):
        cp = letters(t)
        if not len(cp):
            empty.append(i)
            continue
        for at in range(0, max(1, len(cp) - (ORDER - 1)), BLOCK):
            piece = cp[at : at + BLOCK + ORDER - 1]
            parts.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= BLOCK:
                yield _join(parts, owners, empty)
                parts, owners, empty, size = [], [], [], 0
    if parts or empty:
        yield _join(parts, owners, empty)


def _join(parts: list[np.ndarray], owners: list[int], empty: list[int]):
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), empty
    lengths = np.array([len(p) for p in parts])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    use = np.ones(int(lengths.sum()), bool)
    for k in range(ORDER - 1):
        use[first + k] = False
    return np.concatenate(parts), np.repeat(np.array(owners), lengths), use, empty


def gram_codes(cp: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(dense code of the n-gram that ends at each used character, the code points of the dense alphabet, its size)."""
    present = np.flatnonzero(np.bincount(cp, minlength=1))
    dense = np.zeros(present[-1] + 1, np.int64)
    dense[present] = np.arange(len(present))
    c, k = dense[cp], len(present)
    code = c.copy()
    for j in range(1, ORDER):
        code[j:] += c[:-j] * k**j
    return code[use], present, k


def distinct(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, counts, index of each code among them)."""
    if k**ORDER <= 1 << 22:
        n = np.bincount(code, minlength=1)
        found = np.flatnonzero(n)
        where = np.zeros(len(n), np.int32)
        where[found] = np.arange(len(found))
        return found, n[found], where[code]
    found, index, n = np.unique(code, return_inverse=True, return_counts=True)
    return found, n, index


def packed(code: np.ndarray, present: np.ndarray, k: int) -> np.ndarray:
    """Exact 64-bit key: 16 bits a character, the last one lowest."""
    out = np.zeros(len(code), np.uint64)
    for j in range(ORDER):
        out |= present[(code // k**j) % k].astype(np.uint64) << np.uint64(16 * j)
    return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's rows (lang, text)."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        keys, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(index, np.concatenate([p[1] for p in parts])).astype(np.int64)

    for batch in (part for whole in batches for part in by_size(whole, 1, SLICE)):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for cp, _, use, _ in blocks(texts):
                if not len(cp):
                    continue
                code, present, k = gram_codes(cp, use)
                found, n, _ = distinct(code, k)
                parts = held.setdefault(lang, [])
                parts.append((packed(found, present, k), n))
                if len(parts) >= 16:
                    held[lang] = [merged(parts)]
    for lang, parts in held.items():
        keys, n = merged(parts)
        for at in range(0, len(keys), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(n[part])], ["lang", "gram", "n"])


class KneserNey:
    """One language: per order sorted keys with discounted shares, and sorted histories with back-off weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discount: float = DISCOUNT):
        self.levels = []  # from the highest order: (keys, share, histories, weight)
        for order in range(ORDER, 0, -1):
            sort = np.argsort(keys, kind="stable")
            keys, counts = keys[sort], counts[sort].astype(np.float64)
            past, index = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(index, counts)
            kinds = np.bincount(index)
            self.levels.append((keys, np.maximum(counts - discount, 0) / total[index], past, discount * kinds / total))
            shorter = keys & np.uint64((1 << 16 * (order - 1)) - 1)
            keys, counts = np.unique(shorter, return_counts=True)  # in how many histories an n-gram stands
        self.uniform = 1.0 / (len(self.levels[-1][0]) + 1)

    @classmethod
    def of(cls, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> KneserNey:
        """From levels that are ready."""
        out = cls.__new__(cls)
        out.levels, out.uniform = levels, 1.0 / (len(levels[-1][0]) + 1)
        return out

    def probability(self, grams: np.ndarray) -> np.ndarray:
        p, factor = np.zeros(len(grams)), np.ones(len(grams))
        for depth, (keys, share, past, weight) in enumerate(self.levels):
            short = grams & np.uint64((1 << 16 * (ORDER - depth)) - 1) if depth else grams
            at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
            p += factor * np.where(keys[at] == short, share[at], 0)
            history = short >> np.uint64(16)
            at = np.minimum(np.searchsorted(past, history), len(past) - 1)
            factor = factor * np.where(past[at] == history, weight[at], 1)
        return p + factor * self.uniform

    def spread(self, keys: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
        """Mean and deviation of the surprisal of what was learned, in bits a character."""
        bits = -np.log2(self.probability(keys))
        mean = float(np.average(bits, weights=counts))
        return mean, float(np.sqrt(np.average((bits - mean) ** 2, weights=counts)))


class Model:
    def __init__(self, table: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(table)
        self.models = [KneserNey(*table[x]) for x in self.langs]
        self.spread = np.array([m.spread(*table[x]) for x, m in zip(self.langs, self.models, strict=True)]).reshape(-1, 2)

    def score(self, texts: list[str | None], z: float = Z, slack: float = SLACK) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, bits a character, accepted) of each text."""
        m, size = len(texts), len(self.langs)
        bits, n = np.zeros((m, max(1, size))), np.zeros(m)
        for cp, owner, use, _ in blocks(texts):
            if not len(cp) or not size:
                continue
            code, present, k = gram_codes(cp, use)
            found, _, index = distinct(code, k)
            keys, own = packed(found, present, k), owner[use]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            rows = own[starts]
            np.add.at(n, rows, np.diff(np.append(starts, len(own))))
            for j, model in enumerate(self.models):
                np.add.at(bits[:, j], rows, np.add.reduceat(-np.log2(model.probability(keys))[index], starts))
        some = (n > 0) & (size > 0)
        entropy = bits / np.maximum(n, 1)[:, None]
        best = entropy.argmin(1)
        lowest = entropy[np.arange(m), best]
        # the posterior of the best language if characters counted up to 32 times
        score = np.where(some, 1 / np.exp2(np.maximum((lowest[:, None] - entropy) * np.minimum(n, 32)[:, None], -500)).sum(1), 0)
        mean, deviation = (self.spread[best].T if size else (np.zeros(m), np.zeros(m)))
        accepted = some & (lowest <= mean + z * deviation / np.sqrt(np.maximum(n, 1)) + slack)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.minimum(score, 1.0), np.where(some, lowest, 0.0), accepted


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


PARTS = (("keys", np.uint64), ("share", np.float64), ("past", np.uint64), ("weight", np.float64))


def discounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (lang, level, history, gram, n), whole histories -> (lang, level, keys, share, past, weight), arrays as bytes."""

    def chunks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lang = rows.column(0).to_numpy()
        level, history, gram, n = (rows.column(k).to_numpy() for k in range(1, 5))
        cuts = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (level[1:] != level[:-1]), [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            past, index = np.unique(history[a:b].view(np.uint64), return_inverse=True)
            counts = n[a:b].astype(np.float64)
            total = np.bincount(index, counts)
            parts = gram[a:b].view(np.uint64), np.maximum(counts - DISCOUNT, 0) / total[index], past, DISCOUNT * np.bincount(index) / total
            yield pa.RecordBatch.from_arrays([pa.array([lang[a]]), pa.array([level[a]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["lang", "level", *(k for k, _ in PARTS)])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < CHUNK:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        lang, level, history = (rows.column(k).to_numpy() for k in range(3))
        last = np.flatnonzero((lang != lang[-1]) | (level != level[-1]) | (history != history[-1]))
        until = int(last[-1]) + 1 if len(last) else 0
        if until:
            yield from chunks(rows.slice(0, until))
        held = rows.slice(until).combine_chunks().to_batches()
    if any(x.num_rows for x in held):
        yield from chunks(pa.Table.from_batches(held).combine_chunks())


class Stored:
    """The levels of all languages in four files that Spark brings to every executor; index has the ranges of (lang, level) in n-grams and in histories."""

    def __init__(self, levels: DataFrame):
        folder, name = tempfile.mkdtemp(), f"ngrams-{uuid.uuid4().hex[:12]}"
        self.names = {k: f"{name}.{k}" for k, _ in PARTS}
        self.index: dict[tuple[str, int], list[int]] = {}
        done, before = [0, 0], None
        files = {k: open(os.path.join(folder, x), "wb") for k, x in self.names.items()}
        for row in levels.toLocalIterator():
            at = row["lang"], row["level"], int.from_bytes(row["past"][:8], "little")
            if before is not None and at <= before:
                raise RuntimeError("n-grams came out of order")
            before = at
            for k, f in files.items():
                f.write(row[k])
            own = self.index.setdefault(at[:2], [done[0], done[0], done[1], done[1]])
            done[0] += len(row["keys"]) // 8
            done[1] += len(row["past"]) // 8
            own[1], own[3] = done
        for f in files.values():
            f.close()
        if self.index:
            for x in self.names.values():
                levels.sparkSession.sparkContext.addFile(os.path.join(folder, x))
        atexit.register(shutil.rmtree, folder, True)  # executors that start later fetch them too

    def models(self) -> dict[str, KneserNey]:
        """By language, over mapped files."""
        if not self.index:
            return {}
        whole = {k: np.memmap(SparkFiles.get(self.names[k]), kind, "r") for k, kind in PARTS}

        def level(lang: str, order: int):
            a, b, c, d = self.index[lang, order]
            return whole["keys"][a:b], whole["share"][a:b], whole["past"][c:d], whole["weight"][c:d]

        return {x: KneserNey.of([level(x, order) for order in range(ORDER, 0, -1)]) for x in sorted({x for x, _ in self.index})}


class StoredModel(Model):
    """A model whose tables are mapped where it is used."""

    def __init__(self, stored: Stored, langs: list[str], spread: np.ndarray):
        self.stored, self.langs, self.spread = stored, langs, spread

    def __getattr__(self, name: str):
        if name != "models":
            raise AttributeError(name)
        self.models = list(self.stored.models().values())
        return self.models

    def __reduce__(self):
        return StoredModel, (self.stored, self.langs, self.spread)


def fit(learn: DataFrame) -> Model:
    """Learn from rows (lang, text); all n-grams are kept."""
    spark = learn.sparkSession
    ship(spark)
    counts = learn.where("lang is not null and text is not null").select("lang", "text").mapInArrow(sparing(count_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "ngrams")
    table, every = counts, []
    for order in range(ORDER, 0, -1):
        every.append(table.select("lang", F.lit(order).alias("level"), F.shiftrightunsigned("gram", 16).alias("history"), "gram", "n"))
        # in how many histories a shorter n-gram stands
        table = table.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    rows = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    # a history has at most 65,536 n-grams; low 16 bits order them as unsigned numbers
    sorted_rows = rows.repartitionByRange("lang", "level", "history").sortWithinPartitions("lang", "level", "history", F.col("gram").bitwiseAND(F.lit(0xFFFF)))
    stored = Stored(sorted_rows.mapInArrow(sparing(discounted), "lang string, level int, keys binary, share binary, past binary, weight binary"))

    def surprisals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = stored.models()
        for batch in batches:
            lang, keys, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().astype(np.float64)
            for x in sorted(set(lang)):
                own = lang == x
                bits = -np.log2(models[x].probability(keys[own]))
                yield pa.RecordBatch.from_arrays([pa.array([x]), *(pa.array([float(v.sum())]) for v in (n[own], n[own] * bits, n[own] * bits**2))], ["lang", "n", "s1", "s2"])

    sums = counts.mapInArrow(sparing(surprisals), "lang string, n double, s1 double, s2 double").groupBy("lang").agg(*(F.sum(x).alias(x) for x in ("n", "s1", "s2"))).collect()
    spread = {r["lang"]: (r["s1"] / r["n"], np.sqrt(max(0.0, r["s2"] / r["n"] - (r["s1"] / r["n"]) ** 2))) for r in sums}
    langs = sorted(spread)
    return StoredModel(stored, langs, np.array([spread[x] for x in langs]).reshape(-1, 2))


def predict(docs: DataFrame, model: Model, z: float = Z, slack: float = SLACK) -> DataFrame:
    """doc_id, lang_pred, score, bits and accepted of each row (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1, SLICE):
                langs, score, bits, ok = shared.value.score(part.column(1).to_pylist(), z, slack)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(bits), pa.array(ok)], ["doc_id", "lang_pred", "score", "bits", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(sparing(run), f"doc_id {kind}, lang_pred string, score double, bits double, accepted boolean")


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())


def accepted(docs: DataFrame, model: Model | None = None, z: float = Z, slack: float = SLACK) -> DataFrame:
    """The rows of docs, all columns, whose language is recognised."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(learning_rows(docs)) if model is None else model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, at, SLICE):
                yield part.filter(pa.array(shared.value.score(part.column(at).to_pylist(), z, slack)[3], pa.bool_()))

    return docs.mapInArrow(sparing(run), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, bits: learned from the rows that are not held out."""
    model = fit(learning_rows(docs))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted", "bits")
