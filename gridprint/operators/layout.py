"""Two-dimensional layout of contexts: projection, scaling to a grid, collisions, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridprint.functions import grid as G


def hash_layout(ids: DataFrame, grid: int) -> DataFrame:
    """A fixed layout: (context_id, x, y) with x = id mod grid and y = id div grid mod grid."""
    i = F.col("context_id")
    return ids.select("context_id", F.pmod(i, F.lit(grid)).cast("int").alias("x"), F.pmod(F.floor(i / grid), F.lit(grid)).cast("int").alias("y"))


def transpose_normalise(tcm: DataFrame) -> DataFrame:
    """Context vectors of length 1: (context_id, phrase, value)."""
    norm = tcm.groupBy("context_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return tcm.join(norm, "context_id").select("context_id", "phrase", F.when(F.col("norm") > 0, F.col("weight") / F.col("norm")).otherwise(F.col("weight")).alias("value"))


def pca(vectors: DataFrame, dims: int = 2, width: int = 64, seed: int = 7) -> DataFrame:
    """(context_id, x, y) of sparse rows (context_id, phrase, value), without centring.

    Phrases are folded into `width` signed hash columns, whose Gram matrix is one distributed sum of
    width * width numbers; its leading eigenvectors, with a positive sum, project the rows.
    """
    h = F.xxhash64("phrase", F.lit(seed))
    folded = vectors.groupBy("context_id", F.pmod(h, F.lit(width)).cast("int").alias("j")).agg(F.sum(F.col("value") * F.when(h.bitwiseAND(F.lit(1 << 40)) > 0, 1.0).otherwise(-1.0)).alias("v"))
    cells = folded.groupBy("context_id").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    rows = cells.select("context_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("v"))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            if len(b):
                a = np.stack(b["v"].to_numpy())
                total += a.T @ a
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    got = rows.select("v").mapInPandas(gram, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    g = np.zeros((width, width))
    for r in got:
        g[r["i"], r["j"]] = r["g"]
    vectors_ = np.linalg.eigh(np.round(g, 9))[1][:, ::-1][:, :dims]
    vectors_ = vectors_ * np.where(vectors_.sum(0) < 0, -1, 1)

    def along(k: int) -> Column:
        axis = F.array(*[F.lit(float(x)) for x in vectors_[:, k]])
        return F.aggregate(F.zip_with("v", axis, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    return rows.select("context_id", along(0).alias("x"), along(1).alias("y"))


def scale_to_grid(coords: DataFrame, grid: int, padding: float = 0.0) -> DataFrame:
    """Percentiles 1 and 99 (minimum and maximum if they are equal) become the edges; half-even rounding, clipped."""
    bounds = coords.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", lambda c: F.percentile(c, F.lit(0.01))), ("hi", lambda c: F.percentile(c, F.lit(0.99))), ("min", F.min), ("max", F.max))])

    def scaled(c: str) -> Column:
        flat = F.col(f"lo_{c}") >= F.col(f"hi_{c}")
        lo, hi = F.when(flat, F.col(f"min_{c}")).otherwise(F.col(f"lo_{c}")), F.when(flat, F.col(f"max_{c}")).otherwise(F.col(f"hi_{c}"))
        pad = (hi - lo) * padding
        share = F.when(hi > lo, (F.col(c) - (lo - pad)) / F.nullif((hi + pad) - (lo - pad), F.lit(0.0))).otherwise(F.lit(0.5))
        return F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.rint(share * (grid - 1)).cast("int")))

    return coords.join(F.broadcast(bounds)).select("context_id", scaled("x").alias("x"), scaled("y").alias("y"))  # one row of bounds


def resolve_collisions(coords: DataFrame, grid: int, radius: int = 10) -> DataFrame:
    """In the order of ids, a context whose cell is taken moves to the nearest free one.

    Squares of growing radius are searched, dx before dy; without a free cell the context shares. The order
    makes this sequential, so it runs where the points are: one row per context, in one place.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = np.zeros((grid, grid), bool)
        for b in batches:
            xs, ys = b["x"].to_numpy().copy(), b["y"].to_numpy().copy()
            for i in range(len(b)):
                x, y = int(xs[i]), int(ys[i])
                for r in range(radius + 1):
                    lo_x, hi_x, lo_y, hi_y = max(0, x - r), min(grid - 1, x + r), max(0, y - r), min(grid - 1, y + r)
                    free = [(u, v) for u, v in zip(*np.nonzero(~taken[lo_x : hi_x + 1, lo_y : hi_y + 1]), strict=True) if max(abs(u + lo_x - x), abs(v + lo_y - y)) == r]
                    if free:
                        x, y = free[0][0] + lo_x, free[0][1] + lo_y
                        break
                taken[x, y] = True
                xs[i], ys[i] = x, y
            yield b.assign(x=xs, y=ys)

    one = coords.orderBy("context_id").coalesce(1)
    return one.mapInPandas(run, one.schema)


def spread_collisions(coords: DataFrame, grid: int) -> DataFrame:
    """R6 as a set operation, for layouts too large for one place: the k-th context of a cell moves to the k-th offset around it."""
    from pyspark.sql import Window as W

    ring = [(dx, dy) for dx, dy, _ in G.offsets(10)]
    table = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ring])
    k = F.row_number().over(W.partitionBy("x", "y").orderBy("context_id")) - 1
    at = F.get(table, F.pmod(F.col("k"), F.lit(len(ring))))
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(grid - 1), c)).cast("int")
    return coords.withColumn("k", k).select("context_id", clip(F.col("x") + at["dx"]).alias("x"), clip(F.col("y") + at["dy"]).alias("y"))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int, mode: str = "clip") -> Column:
    """`clip` puts the maximum in the last bin, `edges` makes it a bin of its own, `linear` rounds down on bins - 1."""
    share = (value - low) / F.nullif(high - low, F.lit(0.0))
    if mode == "clip":
        return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    return F.floor(share * (bins if mode == "edges" else bins - 1)).cast("int")


def coordinate_stats(coords: DataFrame) -> DataFrame:
    """Ranges, unique positions and the share of contexts that collide."""
    return coords.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count_distinct("x", "y").alias("n_unique")).withColumn("collision_rate", 1 - F.col("n_unique") / F.nullif(F.col("n"), F.lit(0).cast("long")))


def cell_histogram(coords: DataFrame) -> DataFrame:
    """Contexts per cell."""
    return coords.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def density_flags(coords: DataFrame, grid: int) -> DataFrame:
    """Cells in use, share of contexts in the middle quarter of the grid, and whether that is too much."""
    middle = F.col("x").between(grid // 4, 3 * grid // 4 - 1) & F.col("y").between(grid // 4, 3 * grid // 4 - 1)
    return coords.agg((F.count_distinct("x", "y") / float(grid * grid)).alias("utilisation"), F.avg(middle.cast("double")).alias("centre_share")).withColumn("centralised", F.col("centre_share") > 0.3)


def topic_clusters(coords: DataFrame) -> DataFrame:
    """(topic, x, y) to centroid, mean distance to it and spread."""
    centre = coords.groupBy("topic").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    far = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    return coords.join(centre, "topic").groupBy("topic", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.avg(far).alias("mean_distance"), F.stddev_pop("x").alias("spread_x"), F.stddev_pop("y").alias("spread_y"))


def kde(coords: DataFrame, bandwidth: float = 1.0) -> DataFrame:
    """Gaussian density at each context, from cell counts, so a cell's contexts are added up before they meet others."""
    cells = coords.groupBy(F.col("x").alias("u"), F.col("y").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    reach = int(4 * bandwidth + 0.5)
    near = cells.withColumn("o", F.explode(G.offset_array(reach, lambda d: 0.0))).select((F.col("u") + F.col("o.dx")).alias("x"), (F.col("v") + F.col("o.dy")).alias("y"), (F.col("k") * F.exp(-(F.col("o.dx") ** 2 + F.col("o.dy") ** 2) / (2 * bandwidth**2))).alias("w"))
    density = near.groupBy("x", "y").agg(F.sum("w").alias("density"))
    return coords.join(density, ["x", "y"], "left").select("context_id", "x", "y", "density")
