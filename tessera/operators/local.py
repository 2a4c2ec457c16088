"""Shapes of points' neighbourhoods from sums of products of offsets.

Sums of products of offsets up to the fourth order, 35 numbers for a point and
radius, are added up in blocks of near points before they are shuffled. Spread and
the quadric over the flattest plane follow from those sums by turning them into
the neighbourhood's own axes, so neither a unit nor a neighbourhood is ever held.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.spatial import XYZ, near_sums

POWERS = [p for p in itertools.product(range(5), repeat=3) if sum(p) <= 4]
#: The quadric's terms in the two wider axes, as powers of each.
TERMS = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)]
SHAPES = ("flat", "long", "gauss", "mean")


def tensors(sums: np.ndarray) -> list[np.ndarray]:
    """Sums of products as symmetric tensors of orders 0 to 4, a row each."""
    at = {p: k for k, p in enumerate(POWERS)}
    out = []
    for order in range(5):
        places = [at[tuple(axes.count(c) for c in range(3))] for axes in itertools.product(range(3), repeat=order)]
        out.append(sums[:, places].reshape(-1, *[3] * order))
    return out


def turned(t: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Tensors in the frame whose axes are the columns."""
    for place in range(1, t.ndim):
        t = np.moveaxis(np.einsum("n...i,nij->n...j", np.moveaxis(t, place, -1), axes), -1, place)
    return t


def shapes(sums: np.ndarray) -> np.ndarray:
    """flat, long, gauss, mean of each row of sums: shares of the least and largest spread, and the quadric's curvatures (0 below six neighbours)."""
    t = tensors(sums)
    n = t[0]
    mean = t[1] / n[:, None]
    w, v = np.linalg.eigh(t[2] / n[:, None, None] - mean[:, :, None] * mean[:, None, :])
    w, v = np.where(n[:, None] > 1, w, 0.0), v[:, :, ::-1]
    total = np.maximum(w.sum(1), 1e-12)
    own = [turned(x, v) for x in t]
    pick = lambda a, b, c: own[a + b + c][(slice(None), *[0] * a, *[1] * b, *[2] * c)]
    left = np.stack([np.stack([pick(p[0] + q[0], p[1] + q[1], 0) for q in TERMS], -1) for p in TERMS], -2)
    right = np.stack([pick(*p, 1) for p in TERMS], -1)
    # terms of one size each, so that the solution is not that of rounding
    size = np.sqrt(np.maximum(np.einsum("nii->ni", left), 1e-300))
    solved = np.einsum("nij,nj->ni", np.linalg.pinv(left / size[:, :, None] / size[:, None, :], rcond=1e-13, hermitian=True), right / size) / size
    bend = np.stack([np.stack([2 * solved[:, 0], solved[:, 1]], -1), np.stack([solved[:, 1], 2 * solved[:, 2]], -1)], -2)
    k = np.where(n[:, None] >= 6, np.linalg.eigvalsh(bend), 0.0)
    return np.column_stack([w[:, 0] / total, w[:, 2] / total, np.abs(k[:, 0] * k[:, 1]), np.abs(k.sum(1)) / 2])


def about(sums: np.ndarray, own: Sequence[np.ndarray]) -> np.ndarray:
    """Sums of products of places, in the order of POWERS, as those of offsets from each row's own place."""
    at = {p: k for k, p in enumerate(POWERS)}
    powers = [[(-x) ** k for k in range(5)] for x in own]
    out = np.zeros_like(sums)
    for p, k in at.items():
        for q in itertools.product(*(range(n + 1) for n in p)):
            out[:, k] += math.prod(math.comb(n, m) for n, m in zip(p, q, strict=True)) * sums[:, at[q]] * reduce(np.multiply, (powers[c][n - m] for c, (n, m) in enumerate(zip(p, q, strict=True))))
    return out


def local_shapes(points: DataFrame, radii: Sequence[float] = (10.0, 14.0)) -> DataFrame:
    """Per point and radius: spread ratios of its neighbourhood, itself included, and curvatures of the quadric fitted over its flattest plane."""
    wide = sorted(map(float, radii))

    def moments(a, b):
        middle = [a[c].mean() if len(a[c]) else 0.0 for c in XYZ]
        own, other = ([t[c] - m for c, m in zip(XYZ, middle, strict=True)] for t in (a, b))
        power = lambda x: [reduce(np.multiply, (x[k] for k in range(3) for _ in range(p[k])), np.ones(len(x[0]))) for p in POWERS]
        values = np.column_stack(power(other))

        def of(at, d2, near):
            return np.hstack([about((near & (d2 <= r * r)).astype(float) @ values, [x[at] for x in own]) for r in wide])

        return of

    names = [f"s{n}_{k}" for n in range(len(wide)) for k in range(len(POWERS))]
    rows = F.array(*[F.struct(F.lit(r).alias("r"), F.array(*[F.col(f"s{n}_{k}") for k in range(len(POWERS))]).alias("sums")) for n, r in enumerate(wide)])
    sums = near_sums(points, max(wide), names, moments, itself=True).select("unit", "i", F.inline(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = shapes(np.array(b["sums"].tolist(), float).reshape(-1, len(POWERS))) if len(b) else np.zeros((0, 4))
            yield pd.DataFrame({"unit": b["unit"], "i": b["i"], "r": b["r"], **dict(zip(SHAPES, found.T, strict=True))})

    kind = {f.name: f.dataType.simpleString() for f in sums.schema}
    rows = sums.mapInPandas(run, f"unit {kind['unit']}, i {kind['i']}, r double, " + ", ".join(f"{c} double" for c in SHAPES))
    return rows.groupBy("unit", "i").agg(*[F.max(F.when(F.col("r") == float(r), F.col(c))).alias(f"{c}{r:g}") for r in radii for c in SHAPES])
