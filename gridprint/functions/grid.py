"""Cell addresses on a square grid, kernels and neighbourhoods, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bits of a byte at the even places of two, and the even bits of a byte side by side. Looked up, since a shift-and-mask
#: step repeats its argument, which makes generated code grow with the power of the steps.
SPREAD = [sum((b >> i & 1) << 2 * i for i in range(8)) for b in range(256)]
GATHER = [sum((b >> 2 * i & 1) << i for i in range(4)) for b in range(256)]


def _bytewise(table: list[int], v: Column, size: int, width: int) -> Column:
    """Entries for the lowest `size` bytes, each `width` bits further up."""
    entries = F.expr(f"array({', '.join(f'{x}L' for x in table)})")
    parts = [F.shiftleft(F.get(entries, F.shiftright(v, 8 * k).bitwiseAND(F.lit(255).cast("long")).cast("int")), width * k) for k in range(size)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def _spread(v: Column) -> Column:
    return _bytewise(SPREAD, v.cast("long"), 2, 16)


def _gather(v: Column) -> Column:
    return _bytewise(GATHER, v.cast("long"), 4, 4)


def morton(x: Column, y: Column) -> Column:
    """X in the even bits, y in the odd ones."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def unmorton(cell: Column) -> tuple[Column, Column]:
    """(x, y)."""
    return _gather(cell), _gather(F.shiftright(cell.cast("long"), 1))


def row_major(x: Column, y: Column, grid: int) -> Column:
    """V17."""
    return y.cast("long") * grid + x


def inside(x: Column, y: Column, grid: int) -> Column:
    return x.between(0, grid - 1) & y.between(0, grid - 1)


def offsets(radius: int) -> list[tuple[int, int, int]]:
    """(dx, dy, Chebyshev distance) within a radius, the centre first."""
    out = [(dx, dy, max(abs(dx), abs(dy))) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    return sorted(out, key=lambda o: o[2])


def offset_array(radius: int, weight, centre: bool = True) -> Column:
    """Array of {dx, dy, w} to explode: one row per offset, w = weight(distance)."""
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(weight(d))).alias("w")) for dx, dy, d in offsets(radius) if d or centre])


def mirror(v: Column, grid: int) -> Column:
    """A coordinate beyond an edge counts as its reflection, the edge cell repeated."""
    period = 2 * grid
    m = F.pmod(v, F.lit(period))
    return F.when(m < grid, m).otherwise(period - 1 - m)


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised one-dimensional kernel."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]
