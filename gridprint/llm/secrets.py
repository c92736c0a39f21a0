"""Secret scans by grammar inference.

The base patterns label credentials: assigned values, access keys, hex strings.
From a bounded sample of each kind a prefix tree is built and its statistically
compatible states are merged (Hoeffding bound on the end and transition rates,
in the red-blue order), which gives one probabilistic automaton a kind. All tokens
of all texts that have the alphabet of credentials, dots included, and the length
of the shortest labelled ones are then scored: the likelihood of their format under
the best automaton against a character model of ordinary tokens; those that the automaton explains better by `margin` nats a character
become spans too.

Defined cases: null text counts as empty; whole texts are scanned; repeated
rows and null doc_id are scanned row by row; without labelled credentials no
span is added; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridprint.llm.common import ship

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run; shorter ones fail
#: Candidates: the alphabet and the least length of assigned values.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
KINDS = ("assign", "access", "hex")
#: Ordinary tokens: from LONG characters on, and shorter ones, which are far more and would leave the long ones no place in a sample.
ORDINARY, LONG = ("long", "short"), 16
#: Labelled credentials of a kind, and ordinary tokens of a class, that the automata and the character model are fitted on, and the
#: characters that one of these has at most. Longer ones are scored like others.
SAMPLE, LEARNED = 400, 256
ALPHA, MARGIN = 0.05, 0.8
#: Scores that a worker remembers, and characters of the longest tokens that they are of.
MEMO, MEMO_CHARS = 100_000, 64


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    low = text if not text.isascii() else text.lower()
    if not text.isascii() or any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def untouched(text: str, base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Tokens that no base span touches, in one pass over both."""
    joined: list[list[int]] = []
    for a, _, b in base:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    at = 0
    for m in TOKEN.finditer(text):
        while at < len(joined) and joined[at][1] <= m.start():
            at += 1
        if at == len(joined) or joined[at][0] >= m.end():
            yield m


def value_of(text: str, kind: int, start: int, end: int) -> str:
    """The credential in a base span."""
    return ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


class Automaton:
    """A probabilistic automaton by state merging."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for w in sorted(words):
            s = 0
            for ch in w:
                if ch not in self.next[s]:
                    self.next[s][ch] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                self.count[s][ch] = self.count[s].get(ch, 0) + 1
                s = self.next[s][ch]
            self.ends[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.symbols = len({c for w in words for c in w}) + 1
        self._merge()

    def visits(self, s: int) -> int:
        return self.ends[s] + sum(self.count[s].values())

    def _differs(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits(a), self.visits(b)
            if not n or not m:
                continue
            if self._differs(self.ends[a], n, self.ends[b], m):
                return False
            for ch in self.count[a].keys() | self.count[b].keys():
                if self._differs(self.count[a].get(ch, 0), n, self.count[b].get(ch, 0), m):
                    return False
                if ch in self.next[a] and ch in self.next[b]:
                    todo.append((self.next[a][ch], self.next[b][ch]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a tree's counts to a state, and its subtrees where the state has none."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for ch, n in self.count[b].items():
                self.count[a][ch] = self.count[a].get(ch, 0) + n
                if ch in self.next[a]:
                    todo.append((self.next[a][ch], self.next[b][ch]))
                else:
                    self.next[a][ch] = self.next[b][ch]

    def _merge(self) -> None:
        red = [0]
        held = {0}
        while True:
            blue = [(s, ch) for s in red for ch in sorted(self.next[s]) if self.next[s][ch] not in held]
            if not blue:
                break
            s, ch = max(blue, key=lambda x: self.visits(self.next[x[0]][x[1]]))
            b = self.next[s][ch]
            for r in red:
                if self._compatible(r, b):
                    self.next[s][ch] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
                held.add(b)
        self.states = red
        self.table = {}
        for s in red:
            n = self.visits(s) + 0.5 * self.symbols
            self.table[s] = ({ch: (math.log((k + 0.1) / n), self.next[s][ch]) for ch, k in self.count[s].items()}, math.log(0.1 / n), math.log((self.ends[s] + 0.1) / n))

    def log_likelihood(self, word: str) -> float:
        """Of the word and its end; an unseen transition costs its smoothing share and keeps the state."""
        s, total = 0, 0.0
        for ch in word:
            moves, unseen, _ = self.table[s]
            if ch in moves:
                p, s = moves[ch]
                total += p
            else:
                total += unseen
        return total + self.table[s][2]


class Plain:
    """Character bigrams of ordinary tokens; without any, every character is equally likely."""

    def __init__(self, words: list[str]):
        self.pair: dict[str, int] = {}
        self.one: dict[str, int] = {}
        for w in words:
            for a, b in zip("^" + w, w, strict=False):
                self.pair[a + b] = self.pair.get(a + b, 0) + 1
                self.one[a] = self.one.get(a, 0) + 1

    def log_likelihood(self, word: str) -> float:
        return sum(math.log((self.pair.get(a + b, 0) + 0.5) / (self.one.get(a, 0) + 0.5 * 67)) for a, b in zip("^" + word, word, strict=False))


class Grammar:
    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str], margin: float = MARGIN):
        self.automata = {k: Automaton(v) for k, v in sorted(labelled.items()) if v}
        self.plain, self.margin = Plain(ordinary), margin
        self.seen: dict[str, tuple[str, float]] = {}

    def score(self, word: str) -> tuple[str, float]:
        """(best kind, nats a character that it explains better than the character model); ('', -inf) without automata."""
        if not self.automata:
            return "", -math.inf
        other = self.plain.log_likelihood(word)
        return max(((k, (a.log_likelihood(word) - other) / len(word)) for k, a in self.automata.items()), key=lambda x: (x[1], x[0]))

    def remembered(self, word: str) -> tuple[str, float]:
        """score() of a word; ordinary words come again and again."""
        if len(word) > MEMO_CHARS:
            return self.score(word)
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= MEMO:
                self.seen.clear()
            got = self.seen[word] = self.score(word)
        return got

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str, int, float]]:
        """(start, kind, end, score) of tokens that no base span touches."""
        out = []
        for m in untouched(text, base):
            kind, score = self.remembered(m[0])
            if score >= self.margin:
                out.append((m.start(), f"format_{kind}", m.end(), score))
        return out


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, key) of credentials, and of ordinary tokens by their first alphabetic words; key orders them at random but always alike."""
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            text = text or ""
            base = base_spans(text)
            rows += [(KINDS[k], value_of(text, k, a, b)) for a, k, b in base]
            rows += [(ORDINARY[len(m[0]) < LONG], m[0]) for m in untouched(text, base)]
        rows = [(k, v, hashlib.md5(v.encode()).hexdigest()) for k, v in dict.fromkeys(rows) if len(v) <= LEARNED]
        keep = [r for kind in (*ORDINARY, *KINDS) for r in sorted((r for r in rows if r[0] == kind), key=lambda r: r[2])[: SAMPLE]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in keep], pa.string()) for i in range(3)], ["kind", "value", "key"])


def infer(docs: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Fit the automata on at most `sample` distinct credentials of each kind and ordinary tokens of each class, drawn by hash from all rows."""
    ship(docs.sparkSession)
    found = docs.select("text").mapInArrow(labelled, "kind string, value string, key string").groupBy("kind", "value", "key").agg(F.count(F.lit(1)).alias("n"))
    # a top-k report: first in 64 parts of each kind, so that what meets in one place is bounded
    for by in (["kind", F.substring("key", -2, 2) >= "80", F.substring("key", -3, 1), F.substring("key", -4, 1) >= "8"], ["kind"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("key", "value"))).where(F.col("rank") <= sample)
    rows = found.collect()
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["kind"], []).append(r["value"])
    return Grammar({k: sorted(by.get(k, [])) for k in KINDS}, sorted(w for k in ORDINARY for w in by.get(k, [])))


def scan(docs: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """doc_id, base (kind:start:end, comma-joined), n_assign, n_access, n_hex, spans (base and added ones), per row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(infer(docs) if grammar is None else grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                added = model.spans(text, base)
                order = {k: i for i, k in enumerate(KINDS)}
                every = sorted([(a, KINDS[k], b) for a, k, b in base] + [(a, k, b) for a, k, b, _ in added], key=lambda x: (x[0], order.get(x[1], 9), x[1], x[2]))
                n = [sum(1 for _, k, _ in base if k == i) for i in range(3)]
                rows.append((*n, ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base), ",".join(f"{k}:{a}:{b}" for a, k, b in every)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
