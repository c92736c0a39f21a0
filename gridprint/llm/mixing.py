"""Soft-membership mixing to target weights, in DataFrame functions only.

A table of labelled rows (doc_id, domain) trains a naive Bayes classifier on
words that tell the domains apart and on a few marks of style. It gives every
document a posterior over domains, so its tokens count in part for each. Rates
r >= 0 are fitted by projected gradient on the least squares of
expected domain token totals against target totals: sum_i t_i p_id r_i = w_d T.
The gradient has one number a domain, so a step is one distributed sum over a
narrow table and a rate is the same short fold for every row. Steps are scaled by
the inverse of the domains' Gram matrix, which makes a step of one safe, and by
1 / t_i, so that documents with equal posteriors get equal rates whatever their
length. A document is then taken floor(r) times, and once more with probability
r - floor(r), drawn from the hash of its identifier.

Defined cases: null or empty text has no tokens, the prior as its posterior and
the rate that this gives; without labelled rows there is one domain and all rates
are 1; labels for absent documents, null labels and repeated labels (the smallest
domain counts) are tolerated; rows with null doc_id are rated like others; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridprint.llm.common import lower_ascii, materialise, rows_as_one

#: Labelled rows that the classifier is fitted on at most, and rows that a feature must stand in; all that do and tell domains apart are used.
MAX_LABELLED, MIN_ROWS = 20_000, 5
#: Log-likelihood ratio (G statistic) that a feature's counts must have against equal shares in all domains: what chance gives one in a billion features.
MIN_EVIDENCE = 50.0
#: Share of some domain's labelled rows that a feature must stand in; words of one group of copies don't.
MIN_SHARE = 0.02
#: How much more often a feature must stand in some domain than in all rows; common words only tell long texts from short.
MIN_LIFT = 3.0
STEPS, TOLERANCE = 30, 1e-6
#: Posteriors below this are not told from it: evidence of many marks is not independent.
FLOOR = 1e-3
#: Target share of tokens for the domains of `labels`, renormalised over the domains that exist.
TARGETS = {"clean": 0.9, "poor": 0.07, "toxic": 0.03}
WORD = r"[\p{L}]+"


def label_domains(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) as (doc_id, domain)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null")


def tokens(text: Column) -> Column:
    """Words: runs of characters other than the six ASCII white-space characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def style(text: Column, n: Column) -> Column:
    """Marks of style, each present or absent, as names that no word has."""
    t = F.coalesce(text, F.lit(""))

    def many(chars: str, share: float) -> Column:
        return F.length(t) - F.length(F.translate(t, chars, "")) > share * n

    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    marks = {"#repeats": F.size(lines) - F.size(F.array_distinct(lines)) > 0.3 * F.size(lines), "#symbols": many("#*$%&", 0.5), "#bars": many("|", 0.3), "#shouts": many("!", 0.3), "#short": n < 20}
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in marks.items()]), lambda x: x.isNotNull())


class Classifier:
    """Naive Bayes over the presence of features."""

    def __init__(self, domains: list[str], prior: list[float], weights: dict[str, list[float]], absent: list[float]):
        self.domains, self.prior, self.weights, self.absent = domains, prior, weights, absent

    def posterior(self, present: Column) -> list[Column]:
        """Column per domain, from an array of the features that are present."""
        if len(self.domains) == 1:
            return [F.lit(1.0)]
        start = F.array(*[F.lit(math.log(p) + a) for p, a in zip(self.prior, self.absent, strict=True)])
        if not self.weights:
            logs = start
        else:
            # maps are searched from end to end, so there are many short ones
            parts: list[list[Column]] = [[] for _ in range(1 + len(self.weights) // 8)]
            for k, v in sorted(self.weights.items()):
                parts[zlib.crc32(k.encode()) % len(parts)] += [F.lit(k), F.array(*map(F.lit, v))]
            table = F.array(*[F.create_map(*p) if p else F.create_map(F.lit(""), F.array(*[F.lit(0.0)] * len(self.domains))) for p in parts])
            own = lambda w: F.element_at(F.get(table, (F.crc32(w.cast("binary")) % len(parts)).cast("int")), w)
            logs = F.aggregate(present, start, lambda acc, w: F.zip_with(acc, own(w), lambda a, b: a + b))
        top = F.array_max(logs)
        odds = F.transform(logs, lambda x: F.greatest(F.exp(x - top), F.lit(FLOOR)))
        total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
        return [F.get(odds, F.lit(i)) / total for i in range(len(self.domains))]


def features(text: Column, n: Column) -> Column:
    return F.concat(F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))), style(text, n))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """Train on at most max_labelled labelled rows, drawn by hash; keep the features that stand in enough of them and tell the domains apart."""
    chosen = labels.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("n", tokens(F.col("text")))  # at most max_labelled ids
    rows = materialise(rows.select("domain", features(F.col("text"), F.col("n")).alias("f")), "labelled")
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(sizes)
    if not domains:
        return Classifier(["all"], [1.0], {}, [0.0])
    total = sum(sizes.values())
    counted = rows.select("domain", F.explode("f").alias("f")).groupBy("f").agg(*[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    shares = [(F.col(f"n{i}") + 0.5) / (sizes[d] + 1.0) for i, d in enumerate(domains)]
    mean = sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0)) / float(total)
    lift = F.greatest(*shares, F.lit(0.0)) / (mean + 0.5 / total)
    evidence = 2.0 * sum((F.when(F.col(f"n{i}") > 0, F.col(f"n{i}") * F.log(F.col(f"n{i}") / (mean * sizes[d]))).otherwise(0.0) for i, d in enumerate(domains)), F.lit(0.0))
    best = sorted(counted.where((mean * total >= MIN_ROWS) & (lift >= MIN_LIFT) & (evidence >= MIN_EVIDENCE) & (F.greatest(*shares, F.lit(0.0)) >= MIN_SHARE)).collect(), key=lambda r: r["f"])  # bounded by the labelled rows
    weights, absent = {}, [0.0] * len(domains)
    for r in best:
        p = [(r[f"n{i}"] + 0.5) / (sizes[d] + 1.0) for i, d in enumerate(domains)]
        weights[r["f"]] = [math.log(x) - math.log1p(-x) for x in p]
        absent = [a + math.log1p(-x) for a, x in zip(absent, p, strict=True)]
    return Classifier(domains, [sizes[d] / total for d in domains], weights, absent)


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens and p_<domain> per row."""
    words = [k for k in model.weights if not k.startswith("#")]
    marks = [k for k in model.weights if k.startswith("#")]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "text", tokens(F.col("text")).alias("n_tokens"))
    found = F.array().cast("array<string>")
    if words:
        found = F.array_distinct(F.filter(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), lambda w: w.isin(words)))
    if marks:
        found = F.concat(found, F.filter(style(F.col("text"), F.col("n_tokens")), lambda w: w.isin(marks)))
    rows = rows.select("doc_id", "n_tokens", found.alias("found"))
    return rows.select("doc_id", "n_tokens", *[p.alias(f"p_{d}") for d, p in zip(model.domains, model.posterior(F.col("found")), strict=True)])


def _rate(p: list[Column], steps: list[list[float]]) -> Column:
    """The projected-gradient iterate after the given steps, from 1."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    moves = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    along = lambda s: sum((F.get(s, F.lit(i)) * c for i, c in enumerate(p)), F.lit(0.0))
    return F.aggregate(moves, rate, lambda r, s: F.greatest(F.lit(0.0), r - along(s)))


def fit_rates(soft: DataFrame, domains: list[str], targets: dict[str, float] | None = None, steps: int = STEPS) -> tuple[list[list[float]], list[float]]:
    """(the steps of the fit, relative residual per step). soft: a materialised table of n_tokens and p_<domain>."""
    p = [F.col(f"p_{d}") for d in domains]
    t = F.col("n_tokens").cast("double")
    k = len(domains)
    def totals(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens a domain, and the Gram matrix of the rows with a positive rate."""
        cells = [(i, j) for i in range(k) for j in range(i, k)]
        got = soft.withColumn("_r", rate).agg(*[F.sum(t * p[i] * F.col("_r")).alias(f"s{i}") for i in range(k)], *[F.sum(F.when(F.col("_r") > 0, t * p[i] * p[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i, j in cells]).first()
        gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        return np.array([got[f"s{i}"] or 0.0 for i in range(k)]), gram

    sums, whole = totals(F.lit(1.0))
    total = sums.sum()
    if total <= 0:
        return [], []
    wanted = sums if targets is None else np.array([targets.get(d, 0.0) for d in domains])
    b = (wanted / wanted.sum() if wanted.sum() > 0 else sums / total) * total
    done, residuals, gram = [], [], whole
    for _ in range(steps):
        off = sums - b
        residuals.append(float(np.abs(off).max() / total))
        if residuals[-1] < TOLERANCE:
            break
        # rows at zero don't move the sums, so their share is left out, unless that went too far
        if len(residuals) > 1 and residuals[-1] >= residuals[-2]:
            gram = whole
        done.append([float(x) for x in np.linalg.pinv(gram, rcond=1e-9) @ off])
        sums, gram = totals(_rate(p, done))
    return done, residuals


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = TARGETS, seed: int = 42) -> DataFrame:
    """doc_id, n_tokens, p_<domain>..., rate, n_copies per row. labels: (doc_id, domain)."""
    model = fit(docs, labels)
    soft = materialise(posteriors(docs, model), "posteriors")
    steps, _ = fit_rates(soft, model.domains, targets if model.domains != ["all"] else None)
    out = soft.withColumn("rate", _rate([F.col(f"p_{d}") for d in model.domains], steps))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return out.withColumn("n_copies", (F.floor("rate") + F.when(unit < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = TARGETS) -> DataFrame:
    """The rows of docs, all columns, each as often as its rate says."""
    taken = mix(docs, labels, targets).where("n_copies > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max("n_copies").alias("n"))
    many = rows_as_one(docs).join(taken, F.col("row.doc_id").eqNullSafe(F.col("id")))
    return many.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")
