"""Regular grids about points: free places, how buried they are, and pockets among them, in rows and joins; what lies ahead is looked up in blocks.

A grid point is a row only if some point reaches it, so a unit's empty space
costs nothing. Points make the grid rows around them axis by axis, each axis
dropping what is already too far; no distance is asked of other pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.spatial import XYZ, _dealt, radius_pairs
from tessera.session import stored

AXES = ("kx", "ky", "kz")


def directions(n: int) -> list[tuple[float, float, float]]:
    """n directions spread evenly over the sphere, along a spiral of golden turns."""
    out = []
    for k in range(n):
        z = 1 - 2 * (k + 0.5) / n
        turn = math.pi * (1 + math.sqrt(5)) * (k + 0.5)
        out.append((math.sqrt(1 - z * z) * math.cos(turn), math.sqrt(1 - z * z) * math.sin(turn), z))
    return out


def free_grid(points: DataFrame, step: float, clear: float, reach: float, margin: float = 3.0) -> DataFrame:
    """unit, i, px, py, pz of the grid points farther than `clear` from all points and nearer than `reach` to one.

    The grid starts `margin` below the unit's least coordinates and ends past
    `margin` above the greatest; i counts its places, the last axis fastest.
    """
    box = points.groupBy("unit").agg(*[(F.min(c) - margin).alias(f"lo_{c}") for c in XYZ], *[(F.max(c) + margin).alias(f"hi_{c}") for c in XYZ])
    for c, k in zip(XYZ, AXES, strict=True):
        box = box.withColumn(f"n_{k}", F.ceil((F.col(f"hi_{c}") + step - F.col(f"lo_{c}")) / step))
    rows = points.select("unit", *XYZ).join(box, "unit").withColumn("d2", F.lit(0.0))
    for c, k in zip(XYZ, AXES, strict=True):
        at = (F.col(c) - F.col(f"lo_{c}")) / step
        near = F.sequence(F.greatest(F.floor(at - reach / step), F.lit(0)), F.least(F.ceil(at + reach / step), F.col(f"n_{k}") - 1))
        off = F.col(f"lo_{c}") + F.col(k) * step - F.col(c)
        rows = rows.withColumn(k, F.explode(near)).withColumn("d2", F.col("d2") + off * off).filter(F.col("d2") < reach * reach)
    least = rows.groupBy("unit", *AXES).agg(F.min("d2").alias("d2")).filter(F.col("d2") > clear * clear)
    place = (F.col("kx") * F.col("n_ky") + F.col("ky")) * F.col("n_kz") + F.col("kz")
    return least.join(box, "unit").select("unit", place.alias("i"), *[(F.col(f"lo_{c}") + F.col(k) * step).alias(c) for c, k in zip(XYZ, AXES, strict=True)])


#: Points that look around, those that they may meet, and pairs of them that are tried at once.
OWN_BLOCK, AROUND_BLOCK, TRIED = 1 << 14, 1 << 16, 1 << 18


def ahead(own: np.ndarray, other: np.ndarray, way: Sequence[float], reach: float, width: float, sphere: bool = False, nearest: bool = True) -> np.ndarray:
    """Least distance along a direction, up to reach (with sphere: in all), to a point off it by width at most, of each own point; inf without any.

    Others are ordered by columns along the direction that are as wide as
    `width`, and within them by distance. An own point tries those ahead in
    nine columns, a few at a time, until it has met one: without `nearest`, any.
    """
    best = np.full(len(own), np.inf)
    if not len(own) or not len(other):
        return best
    v = np.array(way)
    axes, middle = np.vstack([np.linalg.svd(v[None])[2][1:], v]).T, own.mean(0)
    x, y = (own - middle) @ axes, (other - middle) @ axes
    least = np.minimum(x.min(0), y.min(0))
    x, y = x - least, y - least
    cx, cy = (np.floor(t[:, :2] / (width * (1 + 1e-6))).astype(np.int64) + 1 for t in (x, y))
    line = max(cx[:, 1].max(), cy[:, 1].max()) + 2
    length = max(x[:, 2].max(), y[:, 2].max()) + 1
    column = lambda c: (c[..., 0] * line + c[..., 1]) * (length + 1)
    place = column(cy) + y[:, 2]
    order = np.argsort(place)
    place, other, slack = place[order], other[order], 1e-6 * width + 4 * np.spacing(place.max())
    about = column(cx[:, None] + np.array(list(itertools.product((-1, 0, 1), repeat=2))))
    until = lambda k, far: np.searchsorted(place, about[k] + np.minimum(x[k, 2] + far + slack, length)[:, None], side="right")
    start, end = np.searchsorted(place, about + np.maximum(x[:, 2] - slack, 0)[:, None]), until(np.arange(len(x)), reach)
    left, few = np.flatnonzero((end > start).any(1)), 2
    while len(left):
        step, still = max(1, TRIED // (9 * few)), []
        for k in range(0, len(left), step):
            at = left[k : k + step]
            n = np.minimum(end[at] - start[at], few).clip(0)
            many = n.ravel()
            row, col = np.repeat(at, n.sum(1)), np.arange(many.sum()) + np.repeat(start[at].ravel() - np.cumsum(many) + many, many)
            o = [other[col, j] - own[row, j] for j in range(3)]
            along = o[0] * v[0] + o[1] * v[1] + o[2] * v[2]
            d2 = o[0] * o[0] + o[1] * o[1] + o[2] * o[2]
            hit = (along > 0) & (along <= reach) & (d2 - along * along <= width * width)
            if sphere:
                hit &= d2 <= reach * reach
            np.minimum.at(best, row[hit], along[hit])
            start[at] += n
            if nearest:
                met = at[np.isfinite(best[at])]
                end[met] = np.minimum(end[met], until(met, best[met]))
            else:
                at = at[np.isinf(best[at])]
            still.append(at[(end[at] > start[at]).any(1)])
        left, few = np.concatenate(still), min(4 * few, TRIED // 9)
    return best


def _looked(starts: DataFrame, points: DataFrame, ways: Sequence[Sequence[float]], reach: float, width: float, sphere: bool, nearest: bool, of: Callable, schema: str) -> DataFrame:
    """unit and what of(i, far) makes of each block's starts and of the matrix of `ahead`, a column for each direction."""
    kind = starts.schema["unit"].dataType.simpleString()

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        own, other = (np.column_stack([t.column(c).to_numpy() for c in XYZ]) for t in (a, b))
        sound = np.isfinite(own).all(1)
        own, other = own[sound], other[np.isfinite(other).all(1)]
        out = of(a.column("i").to_numpy()[sound], np.column_stack([ahead(own, other, w, reach, width, sphere, nearest) for w in ways]))
        n = len(next(iter(out.values())))
        return pa.table({"unit": pa.array([key[0].as_py()] * n, a.schema.field("unit").type), **{c: pa.array(x) for c, x in out.items()}})

    r = math.sqrt(reach * reach + width * width) * (1 + 1e-9)
    there = points.select("unit", F.xxhash64(*XYZ).alias("i"), *XYZ)
    return _dealt(starts.filter(F.col("i").isNotNull()).select("unit", "i", *XYZ), r, own_block=OWN_BLOCK, around_block=AROUND_BLOCK, others=there).applyInArrow(run, f"unit {kind}, {schema}")


def rays(starts: DataFrame, points: DataFrame, ways: list[tuple[float, float, float]], reach: float, width: float) -> DataFrame:
    """unit, i, k, far: for each start and direction k that has a point ahead, up to reach along it and up to width off it, how far the first is along it."""

    def of(i, far):
        row, k = np.nonzero(np.isfinite(far))
        return {"i": i[row], "k": k, "far": far[row, k]}

    return _looked(starts, points, ways, reach, width, False, True, of, "i bigint, k bigint, far double").groupBy("unit", "i", "k").agg(F.min("far").alias("far"))


def buried_share(grid: DataFrame, points: DataFrame, n: int = 30, reach: float = 11.0, width: float = 1.8, sphere: bool = True) -> DataFrame:
    """grid with buried: the share of n directions in which a point lies ahead, within reach along the ray (with sphere: in all), and within width of it.

    Marks are made in blocks of points, one number for a grid point of a block;
    pairs are never rows, and a point that has met another in a direction tries no more.
    """

    def of(i, far):
        bits = np.isfinite(far) @ (1 << np.arange(n, dtype=np.int64))
        return {"i": i[bits != 0], "bits": bits[bits != 0]}

    marks = _looked(grid, points, directions(n), reach, width, sphere, False, of, "i bigint, bits bigint").groupBy("unit", "i").agg(F.bit_or("bits").alias("bits"))
    return grid.join(marks, ["unit", "i"], "left").select(*grid.columns, (F.coalesce(F.bit_count("bits"), F.lit(0)) / n).alias("buried"))


def most_buried(grid: DataFrame, least: float, otherwise: int, salts: int = 32) -> DataFrame:
    """Grid points buried by at least `least`; in a unit without any, the `otherwise` most buried, ties by i.

    The second kind is found in two steps, first in parts of a unit, so that no
    unit is ordered whole.
    """
    top = grid.groupBy("unit").agg(F.max("buried").alias("top"))
    g = grid.join(top, "unit").withColumn("salt", F.when(F.col("top") < least, F.pmod(F.xxhash64("i"), F.lit(salts))))
    order = [F.desc("buried"), "i"]
    short = g.filter("salt is not null").withColumn("r", F.row_number().over(Window.partitionBy("unit", "salt").orderBy(*order))).filter(F.col("r") <= otherwise)
    few = short.withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy(*order))).filter(F.col("r") <= otherwise)
    return g.filter((F.col("salt").isNull()) & (F.col("buried") >= least)).select(*grid.columns).unionByName(few.select(*grid.columns))


def pocket_scores(points: DataFrame, step: float = 1.5, clear: float = 2.6, reach: float = 6.0, least: float = 0.55, near: float = 8.0) -> DataFrame:
    """unit, i, px, py, pz, buried, score of buried free places: buried * log1p(buried places within `near`, itself included)."""
    grid = stored(free_grid(points, step, clear, reach), "grid")
    deep = stored(most_buried(buried_share(grid, points), least, 50), "buried")
    pairs = radius_pairs(deep, near).select("unit", F.inline(F.array(F.struct(F.col("a_i").alias("i")), F.struct(F.col("b_i").alias("i")))))
    around = pairs.groupBy("unit", "i").agg(F.count(F.lit(1)).alias("n"))
    return deep.join(around, ["unit", "i"], "left").select(*deep.columns, (F.col("buried") * F.log1p(F.coalesce("n", F.lit(0)) + 1)).alias("score"))
