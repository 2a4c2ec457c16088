"""Row generators over points: deformations and rays in joins; grids and random baselines from each unit's box."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.grid import buried_share, rays
from tessera.operators.spatial import near_sums, radius_join

XYZ = ["px", "py", "pz"]


def _boxed(points: DataFrame, f, schema: str) -> DataFrame:
    """f(unit, low corner, high corner) of each unit's box, row by row."""
    box = points.groupBy("unit").agg(*[g(c).cast("double").alias(f"{n}_{c}") for n, g in (("lo", F.min), ("hi", F.max)) for c in XYZ])

    def of(batches):
        for p in batches:
            for r in p.itertuples(index=False):
                yield f(r.unit, np.array(r[1:4]), np.array(r[4:7]))

    return box.mapInPandas(of, schema)


def dilation_gain(points: DataFrame, factors=(1.1, 1.25), r: float = 8.0) -> DataFrame:
    """Company within r, times one plus the largest share of it that leaves when all but the point itself move off the centroid by a factor."""
    p = points.select("unit", "i", *XYZ)
    centre = p.groupBy("unit").agg(*[F.avg(c).alias(f"m_{c}") for c in XYZ])
    moved = lambda f: p.join(centre, "unit").select("unit", "i", *[(F.col(f"m_{c}") + f * (F.col(c) - F.col(f"m_{c}"))).alias(c) for c in XYZ])
    counts = [radius_join(p, other, r).groupBy("unit", F.col("a_i").alias("i")).agg(F.count(F.lit(1)).alias(f"n{k}")) for k, other in enumerate([p, *map(moved, factors)])]
    out = reduce(lambda x, y: x.join(y, ["unit", "i"], "left"), counts)
    gain = F.greatest(*[F.greatest(F.col("n0") - F.coalesce(f"n{k}", F.lit(0)), F.lit(0)) / F.col("n0") for k in range(1, len(counts))], F.lit(0.0))
    return out.select("unit", "i", (F.col("n0") * (1 + gain)).alias("score"))


def deformations(n: int, isochoric: bool = False, seed: int = 0) -> np.ndarray:
    """n small linear fields, the first of them none; isochoric ones keep the volume to first order."""
    fields = 0.08 * np.random.default_rng(seed).standard_normal((n, 3, 3))
    if isochoric:
        fields -= np.trace(fields, axis1=1, axis2=2)[:, None, None] / 3 * np.eye(3)
    fields[0] = 0
    return fields


def best_deformation(points: DataFrame, n: int, isochoric: bool = False, r: float = 8.0, seed: int = 0) -> DataFrame:
    """Largest share of the unit within r, times log1p of its number, over n linear deformations about each point.

    A field shrinks an offset by its least singular value at most, so blocks
    at the widest radius that any field can bring within r have all pairs.
    """
    fields = deformations(n, isochoric, seed)
    widest = r / min(np.linalg.svd(np.eye(3) + g, compute_uv=False)[-1] for g in fields) * (1 + 1e-9)
    p = points.select("unit", "i", *XYZ)

    def counts(a, b):
        own, other = (np.stack([t[c] for c in XYZ], 1) for t in (a, b))
        middle = own.mean(0) if len(own) else 0.0
        # |x - y|^2 of moved points as one product a field; within its rounding of the rim, offsets are moved themselves
        ends = [((own - middle) @ (np.eye(3) + g).T, (other - middle) @ (np.eye(3) + g).T) for g in fields]
        sides = [(np.column_stack([x, (x * x).sum(1), np.ones(len(x))]), np.column_stack([-2 * y, np.ones(len(y)), (y * y).sum(1)]).T) for x, y in ends]
        rim = 1e-9 * r * r

        def exact(k, g):
            o = [other[:, j] - own[k, j] for j in range(3)]
            m = [o[j] + (o[0] * g[j, 0] + o[1] * g[j, 1] + o[2] * g[j, 2]) for j in range(3)]
            return np.count_nonzero(m[0] * m[0] + m[1] * m[1] + m[2] * m[2] <= r * r)

        def of(at, d2, near):
            out = np.zeros((len(d2), len(fields)))
            for n, (x, y) in enumerate(sides):
                far = x[at] @ y
                sure, all_ = np.count_nonzero(far <= r * r - rim, axis=1), np.count_nonzero(far <= r * r + rim, axis=1)
                out[:, n] = sure
                for k in np.flatnonzero(sure != all_):
                    out[k, n] = exact(at.start + k, fields[n])
            return out

        return of

    names = [f"m{k}" for k in range(n)]
    best = near_sums(p, widest, names, counts, itself=True).select("unit", "i", F.greatest(*names).cast("long").alias("m"))
    size = p.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return best.join(size, "unit").select("unit", "i", (F.col("m") / F.col("n") * F.log1p("m")).alias("score"))


def jittered_candidates(points: DataFrame, step: float, seed: int) -> DataFrame:
    """A grid over each unit's box, each point moved by a fixed jitter: unit, i, px, py, pz."""

    def of(unit, low, high):
        axes = [np.arange(a, b + step, step) for a, b in zip(low, high, strict=True)]
        g = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
        g = g + np.random.default_rng(seed).uniform(-0.25 * step, 0.25 * step, g.shape)
        return pd.DataFrame({"unit": unit, "i": np.arange(len(g)), "px": g[:, 0], "py": g[:, 1], "pz": g[:, 2]})

    return _boxed(points, of, "unit int, i long, px double, py double, pz double")


def random_boxes(points: DataFrame, k: int, seed: int) -> DataFrame:
    """k uniform points in each unit's box."""

    def of(unit, low, high):
        g = np.random.default_rng([seed, int(unit)]).uniform(low, high, (k, 3))
        return pd.DataFrame({"unit": unit, "rank": np.arange(1, k + 1), "px": g[:, 0], "py": g[:, 1], "pz": g[:, 2]})

    return _boxed(points, of, "unit int, rank int, px double, py double, pz double")


def buriedness(points: DataFrame, directions: int = 30, reach: float = 11.0, width: float = 1.8) -> DataFrame:
    """Share of fixed directions in which some other point lies within a cylinder of the given reach."""
    p = points.select("unit", "i", *XYZ)
    return buried_share(p, p, directions, reach, width, sphere=False).select("unit", "i", "buried")


def free_runs(points: DataFrame, cap: float = 12.0, width: float = 2.0) -> DataFrame:
    """Distance free of other points along the 12 directions of an icosahedron, each up to the cap; the longest and the mean."""
    g = (1 + 5**0.5) / 2
    axes = np.array([v for a in (-1, 1) for b in (-g, g) for v in ((0, a, b), (a, b, 0), (b, 0, a))]) / np.sqrt(1 + g * g)
    p = points.select("unit", "i", *XYZ)
    met = rays(p, p, [tuple(map(float, a)) for a in axes], cap, width)
    found = met.groupBy("unit", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("far").alias("total"), F.max("far").alias("top"))
    n = F.coalesce("n", F.lit(0))
    longest = F.when(n < len(axes), cap).otherwise(F.col("top"))
    return p.select("unit", "i").join(found, ["unit", "i"], "left").select("unit", "i", longest.alias("longest"), ((F.coalesce("total", F.lit(0.0)) + (len(axes) - n) * cap) / len(axes)).alias("mean"))
