"""Quality rules as a short-circuit cascade.

The counts of the base contract are computed for every text. The further rules
are measured on a bounded sample: seconds a text and share of texts rejected.
They then run in the order of rejections per second, and a text leaves at its
first rejection. The verdict is that of all rules, whatever the order.

Defined cases: null or empty text has no words and fails the base; whole texts
are read, however long; repeated rows and null doc_id are judged row by row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprint.llm.common import ship

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = "#*$%&|<>"
UPPERCASE = re.compile("[A-Z]")
#: Rows that a cost and a selectivity are estimated on.
SAMPLE = 1000
MIN_WORDS, MAX_REPEAT_SHARE = 50, 50


class Text(NamedTuple):
    text: str
    words: list[str]
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int


def repeat_words(words: list[str]) -> int:
    """Words in 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    n, total, until = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if n[w] > 1:
            total += i + 3 - max(i, until)
            until = i + 3
    return total


def measure(text: str | None) -> Text:
    text = text or ""
    words = WORDS(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return Text(text, words, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(words))


def base_failed(t: Text) -> bool:
    return len(t.words) < MIN_WORDS or 100 * t.n_repeat_words > MAX_REPEAT_SHARE * len(t.words)


#: Each rule says whether it rejects a text.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 2 * t.n_symbols > len(t.words),
    "repeated_lines": lambda t: 2 * t.n_dup_lines > t.n_lines,
    "word_length": lambda t: not 2 * len(t.words) <= t.word_chars <= 20 * len(t.words),
    "exclamations": lambda t: 2 * t.text.count("!") > len(t.words),
    "capitals": lambda t: 10 * len(UPPERCASE.findall(t.text)) > 6 * t.word_chars,
    "no_letters": lambda t: 2 * sum(map(str.isalpha, "".join(t.words))) < t.word_chars,
}


def estimate(docs: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """Rule -> (seconds a text, share rejected), on about `sample` rows drawn from all partitions."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [measure(t) for t in batch.column(0).to_pylist()]
            for name, rule in RULES.items():
                began = time.perf_counter()
                rejected = sum(map(rule, texts))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([time.perf_counter() - began]), pa.array([rejected]), pa.array([len(texts)])], ["rule", "seconds", "rejected", "n"])

    n = docs.count()
    rows = docs.select("text").sample(fraction=min(1.0, sample / max(1, n)), seed=17)
    got = rows.mapInArrow(run, "rule string, seconds double, rejected long, n long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n")).collect()
    return {g["rule"]: (g["s"] / max(1, g["n"]), g["r"] / max(1, g["n"])) for g in got}


def cascade(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per second, highest first; ties and unmeasured rules by name."""
    return sorted(RULES, key=lambda k: (-estimates[k][1] / max(estimates[k][0], 1e-9) if k in estimates else 0.0, k))


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the rule that rejected the text (`base`, a rule, or null)."""
    ship(docs.sparkSession)
    order = cascade(estimate(docs)) if order is None else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                t = measure(text)
                failed = base_failed(t)
                why = "base" if failed else next((k for k in order if RULES[k](t)), None)
                rows.append((len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, why is None, why))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def oracle_sql() -> str:
    """The same counts and verdict in DuckDB SQL."""
    return r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
    dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    m AS (SELECT d.doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 coalesce(n_lines, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
                 length(t) - length(replace(t, '!', '')) AS bangs, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters
          FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
    v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT (base_failed OR 2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * bangs > n_words OR 10 * caps > 6 * word_chars OR 2 * letters < word_chars) AS kept
    FROM v"""
