"""Grid fingerprints in long form: (entity, cell, value); zeros aren't stored."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridprint.functions import grid as G


def cells(coords: DataFrame) -> DataFrame:
    """(context_id, cell)."""
    return coords.select("context_id", G.morton(F.col("x"), F.col("y")).alias("cell"))


def phrase_counts(tcm: DataFrame, at: DataFrame) -> DataFrame:
    """(phrase, cell, n): a phrase's contexts per cell."""
    return tcm.select("phrase", "context_id").join(at, "context_id").groupBy("phrase", "cell").agg(F.count(F.lit(1)).alias("n"))


def phrase_fingerprints(counts: DataFrame) -> DataFrame:
    """V19 without smoothing: counts divided by the phrase's largest."""
    top = counts.groupBy("phrase").agg(F.max("n").alias("top"))
    return counts.join(top, "phrase").select("phrase", "cell", (F.col("n") / F.col("top")).alias("value"))


def accumulate(members: DataFrame, prints: DataFrame, entity: str, weight: str = "weight") -> DataFrame:
    """(entity, cell, value): sum of the members' fingerprints times their weights. members: (entity, phrase, weight)."""
    return members.join(prints, "phrase").groupBy(entity, "cell").agg(F.sum(F.col(weight) * F.col("value")).alias("value"))


def normalise(prints: DataFrame, entity: str, mode: str) -> DataFrame:
    """l2, l1, max or binary; a zero norm leaves the row as it is."""
    if mode == "binary":
        return prints.withColumn("value", F.when(F.col("value") != 0, 1.0).otherwise(0.0))
    of = {"l2": F.sqrt(F.sum(F.col("value") * F.col("value"))), "l1": F.sum(F.abs("value")), "max": F.max(F.abs("value"))}
    if mode not in of:
        raise ValueError(f"unknown norm {mode!r}")
    norm = prints.groupBy(entity).agg(of[mode].alias("_norm"))
    return prints.join(norm, entity).withColumn("value", F.when(F.col("_norm") > 0, F.col("value") / F.col("_norm")).otherwise(F.col("value"))).drop("_norm")


def min_max(prints: DataFrame, entity: str, eps: float = 1e-10) -> DataFrame:
    """Active cells on the scale 0..1 for display."""
    b = prints.groupBy(entity).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return prints.join(b, entity).withColumn("value", (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)).drop("_lo", "_hi")


def stats(prints: DataFrame, entity: str, grid: int) -> DataFrame:
    """One row over the collection."""
    per = prints.groupBy(entity).agg(F.count_if(F.col("value") != 0).alias("active"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("active").alias("mean_active"), F.stddev_pop("active").alias("std_active"), F.min("active").alias("min_active"), F.max("active").alias("max_active"), F.avg(1 - F.col("active") / float(grid * grid)).alias("mean_sparsity"))


def phrase_stats(vocab: DataFrame, prints: DataFrame, grid: int) -> DataFrame:
    """Phrases without a fingerprint count as rows of zeros."""
    per = prints.groupBy("phrase").agg(F.count(F.lit(1)).alias("active"), F.max("value").alias("top"))
    every = vocab.select("phrase").join(per, "phrase", "left")
    return every.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("active").isNull().cast("double")).alias("skip_rate"), (100 * (1 - F.sum(F.coalesce("active", F.lit(0))) / (F.count(F.lit(1)) * float(grid * grid)))).alias("sparsity_percent"), F.avg(F.coalesce("top", F.lit(0.0))).alias("mean_top"))


def validate(prints: DataFrame, entity: str, grid: int, min_active: int = 1, max_active: int | None = None) -> DataFrame:
    """(entity, active, valid)."""
    ok = (F.min("value") >= 0) & (F.min("cell") >= 0) & (F.max("cell") < grid * grid)
    n = F.count_if(F.col("value") != 0)
    return prints.groupBy(entity).agg(n.alias("active"), (ok & n.between(min_active, grid * grid if max_active is None else max_active)).alias("valid"))


def sparsify(prints: DataFrame, entity: str, k: int, by: str = "value") -> DataFrame:
    """Exactly k active cells, by value (ties by cell) or the first ones by address."""
    order = [F.desc("value"), F.asc("cell")] if by == "value" else [F.asc("cell")]
    kept = prints.where("value <> 0").withColumn("_k", F.row_number().over(W.partitionBy(entity).orderBy(*order)))
    return kept.where(F.col("_k") <= k).drop("_k")


def sparsify_ties(prints: DataFrame, entity: str, k: int) -> DataFrame:
    """The cells of the k largest values, with all ties."""
    kept = prints.where("value > 0").withColumn("_k", F.rank().over(W.partitionBy(entity).orderBy(F.desc("value"))))
    return kept.where(F.col("_k") <= k).drop("_k")


def binary(prints: DataFrame, entity: str, k: int) -> DataFrame:
    """The k largest cells as 1."""
    return sparsify(prints, entity, k).withColumn("value", F.lit(1.0))


def spread(prints: DataFrame, entity: str, grid: int, radius: int = 1, decay: float = 0.5, guard: float = 0.005) -> DataFrame:
    """Every cell adds value * decay ** distance to its neighbours; prints with a density under the guard stay as they are."""
    if radius == 0:
        return prints
    x, y = G.unmorton(F.col("cell"))
    dense = prints.groupBy(entity).agg((F.count_if(F.col("value") != 0) / float(grid * grid) >= guard).alias("_dense"))
    own = prints.join(dense, entity)
    moved = own.where("_dense").select(entity, x.alias("x"), y.alias("y"), "value", F.explode(G.offset_array(radius, lambda d: decay**d)).alias("o"))
    moved = moved.select(entity, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("value") * F.col("o.w")).alias("value"))
    wide = moved.where(G.inside(F.col("x"), F.col("y"), grid)).groupBy(entity, G.morton(F.col("x"), F.col("y")).alias("cell")).agg(F.sum("value").alias("value"))
    return wide.unionByName(own.where("not _dense").select(entity, "cell", "value"))


def geometric(prints: DataFrame, entity: str, grid: int) -> DataFrame:
    """A 3 x 3 kernel of 1, 1/2 and 1/4 with mirrored edges. Every cell collects from its nine neighbours, so each source offers itself to all cells that it is mirrored to."""
    x, y = G.unmorton(F.col("cell"))
    steps = [(dx, dy, {0: 1.0, 1: 0.5, 2: 0.25}[abs(dx) + abs(dy)]) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    moves = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(w).alias("w")) for a, b, w in steps])
    out = prints.select(entity, x.alias("x"), y.alias("y"), "value", F.explode(moves).alias("o"))
    # target t reads mirror(t + d): a source s is read from t = s - d, and at an edge also from itself for the offset that leaves the grid
    tx, ty = F.col("x") - F.col("o.dx"), F.col("y") - F.col("o.dy")
    shown = out.select(entity, "value", F.col("o.w").alias("w"), F.when(tx.between(0, grid - 1), tx).otherwise(F.col("x")).alias("x"), F.when(ty.between(0, grid - 1), ty).otherwise(F.col("y")).alias("y"))
    return shown.groupBy(entity, G.morton(F.col("x"), F.col("y")).alias("cell")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """V20 on one grid, or on each of several (..., y, x): separable, the edge mirrored."""
    if sigma <= 0:
        return values
    kernel = np.array(G.gaussian(sigma))
    r = len(kernel) // 2
    for axis in (values.ndim - 2, values.ndim - 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(values.ndim)]
        wide = np.pad(values, pad, mode="symmetric")
        values = sum(w * np.take(wide, np.arange(i, i + values.shape[axis]), axis=axis) for i, w in enumerate(kernel))
    return values


def peaks(values: np.ndarray, distance: int) -> np.ndarray:
    """V21 on one grid, or on each of several (..., y, x): cells that are the positive maximum of the square around them."""
    top = values
    for axis in (values.ndim - 2, values.ndim - 1):
        n = values.shape[axis]
        wide = np.pad(top, [(distance, distance) if a == axis else (0, 0) for a in range(values.ndim)], mode="symmetric")
        parts = [np.take(wide, np.arange(i, i + n), axis=axis) for i in range(2 * distance + 1)]
        top = functools.reduce(np.maximum, parts)
    return (values == top) & (values > 0)


def largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k largest positive cells with all ties of the last one, others 0."""
    if k <= 0 or not (values > 0).any():
        return np.zeros_like(values)
    if k >= values.size:
        return np.where(values > 0, values, 0)
    least = np.partition(values, values.size - k, axis=None)[values.size - k]
    return np.where((values >= least) & (values > 0), values, 0)


def share_bits(heights: np.ndarray, budget: int) -> np.ndarray:
    """Bits for peaks sorted by height: in proportion, one at least; what is left goes to the highest, what is too much comes off the largest shares.

    Taking one bit off the first of the largest shares until the sum fits leaves a common level, and the first
    ones one below it. With fewer bits than peaks, the first peaks get none.
    """
    bits = np.maximum(1, (heights / heights.sum() * budget).astype(int))
    if bits.sum() <= budget:
        bits[0] += budget - bits.sum()
        return bits
    level = next(x for x in range(int(bits.max()), -1, -1) if np.minimum(bits, x).sum() <= budget)
    out = np.minimum(bits, level)
    spare = budget - out.sum()
    raised = np.flatnonzero(bits > level)
    out[raised[len(raised) - spare :]] += 1
    return out


def topological(values: np.ndarray, share: float = 0.10, distance: int = 2, sigma: float = 0.5) -> np.ndarray:
    """Contrast, smoothing, peaks; the budget of active cells is shared out by peak height, and each peak keeps the largest cells around it.

    A peak without a bit keeps nothing. Windows that overlap add up. Without a peak the largest cells are kept.
    """
    values = np.maximum(values - 0.5 * values.mean(), 0)
    soft = smooth(values, sigma)
    at = np.argwhere(peaks(soft, distance))
    if not len(at):
        return largest(values, int(values.size * share))
    heights = soft[tuple(at.T)]
    order = np.argsort(-heights, kind="stable")
    out = np.zeros_like(values)
    for (y, x), n in zip(at[order], share_bits(heights[order], round(share * values.size)), strict=True):
        r = max(2, int(np.sqrt(n)))
        window = (slice(max(0, y - r), y + r + 1), slice(max(0, x - r), x + r + 1))
        out[window] += largest(values[window], int(n))
    return out


def topological_all(values: np.ndarray, share: float = 0.10, distance: int = 2, sigma: float = 0.5) -> np.ndarray:
    """topological() of each of several grids (grid, y, x). Windows of one size are taken together, of all grids."""
    n, high, wide = values.shape
    values = np.maximum(values - 0.5 * values.reshape(n, -1).mean(1)[:, None, None], 0)
    soft = smooth(values, sigma)
    of, y, x = np.nonzero(peaks(soft, distance))
    heights = soft[of, y, x]
    order = np.lexsort((-heights, of))  # stable: of equal heights the first
    of, y, x, heights = of[order], y[order], x[order], heights[order]
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=n))
    bits = np.concatenate([share_bits(heights[a:b], round(share * high * wide)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]) if len(of) else np.zeros(0, int)
    out = np.zeros_like(values)
    reach = np.maximum(2, np.sqrt(bits).astype(int))
    for r in np.unique(reach):
        use = np.flatnonzero((reach == r) & (bits > 0))
        padded = np.pad(values, [(0, 0), (r, r), (r, r)])  # zeros, which no peak keeps
        for at in range(0, len(use), 4096):
            k = use[at : at + 4096]
            dy, dx = (d.ravel() for d in np.indices((2 * r + 1, 2 * r + 1)))
            rows, columns = y[k, None] + dy, x[k, None] + dx
            window = padded[of[k, None], rows, columns]
            least = np.take_along_axis(np.sort(window, axis=1), np.maximum(window.shape[1] - bits[k, None], 0), 1)
            at_, cell = np.nonzero((window > 0) & ((window >= least) | (bits[k, None] >= window.shape[1])))
            np.add.at(out, (of[k][at_], rows[at_, cell] - r, columns[at_, cell] - r), window[at_, cell])
    for i in np.flatnonzero(np.bincount(of, minlength=n) == 0):
        out[i] = largest(values[i], int(high * wide * share))
    return out


def per_grid(prints: DataFrame, entity: str, grid: int, change) -> DataFrame:
    """Apply a function of one dense grid [y, x] to every entity's fingerprint. A group is one grid: at most grid * grid rows."""
    kind = prints.schema[entity].dataType.simpleString()
    x, y = G.unmorton(F.col("cell"))
    rows = prints.select(entity, x.alias("x"), y.alias("y"), "value")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((grid, grid))
        np.add.at(dense, (b["y"].to_numpy(), b["x"].to_numpy()), b["value"].to_numpy())
        got = np.asarray(change(dense), float)
        ys, xs = np.nonzero(got)
        return pd.DataFrame({entity: b[entity].iloc[0], "x": xs, "y": ys, "value": got[ys, xs]})

    done = rows.groupBy(entity).applyInPandas(run, f"{entity} {kind}, x long, y long, value double")
    return done.select(entity, G.morton(F.col("x"), F.col("y")).alias("cell"), "value")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cell, a, b, both) of two fingerprints, cells that either has."""
    one, two = a.select("cell", F.col("value").alias("a")), b.select("cell", F.col("value").alias("b"))
    return one.join(two, "cell", "full").select("cell", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def diversity(prints: DataFrame, entity: str, sample: int = 200, seed: int = 5) -> DataFrame:
    """1 - mean cosine over pairs of neighbours in a random but fixed order of `sample` entities; fewer than two: mean 0, score 1."""
    ids = prints.select(entity).distinct().orderBy(F.xxhash64(entity, F.lit(seed)), entity).limit(sample)
    pairs = ids.withColumn("_k", F.row_number().over(W.orderBy(F.xxhash64(entity, F.lit(seed)), entity)))
    pairs = pairs.join(pairs.select((F.col("_k") - 1).alias("_k"), F.col(entity).alias("_other")), "_k").select(F.col(entity).alias("a"), F.col("_other").alias("b"))
    norm = prints.groupBy(entity).agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))
    dot = pairs.join(prints.select(F.col(entity).alias("a"), "cell", F.col("value").alias("va")), "a").join(prints.select(F.col(entity).alias("b"), "cell", F.col("value").alias("vb")), ["b", "cell"]).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    cos = pairs.join(dot, ["a", "b"], "left").join(norm.select(F.col(entity).alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col(entity).alias("b"), F.col("norm").alias("nb")), "b")
    return cos.agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.avg(F.coalesce(F.col("dot") / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0)), F.lit(0.0))), F.lit(0.0)).alias("mean_similarity")).withColumn("diversity", 1 - F.col("mean_similarity"))


def active(value: Column) -> Column:
    return F.count_if(value != 0)
