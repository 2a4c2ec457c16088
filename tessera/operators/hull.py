"""Convex hulls of units of any size, and depths below them.

Points are dealt into groups of bounded size; each group's hull keeps its own
corners, which are dealt anew, until a unit's corners are one group: a corner
of the whole is a corner of every part it lies in. Then the planes of the last
hull, far fewer than points, come back to all points.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.spatial import XYZ
from tessera.session import stored

#: Doubles of the sizes met here are whole numbers of this unit, or differ from one by less than their own rounding.
UNIT = 2.0**-40
XYZ_LIST = list(XYZ)


class Hull:
    """Faces of the hull of distinct points, by insertion: what a point sees, its plane included, gives way to faces on the rim of that."""

    def __init__(self, points: np.ndarray):
        self.q = [tuple(int(v) for v in np.rint(p / UNIT)) for p in points]
        self.x = np.array(self.q, float)
        self.faces: list[tuple[int, int, int]] = []
        self.exact: list[tuple[int, int, int, int]] = []
        self.planes = np.zeros((0, 4))
        start = self.first()
        if start:
            self.inner = tuple(sum(self.q[k][j] for k in start) for j in range(3))  # four times a point within
            self.put(list(itertools.combinations(start, 3)))
            for p in range(len(self.q)):
                if p not in start:
                    self.insert(p)

    def plane(self, a: int, b: int, c: int) -> tuple[int, int, int, int]:
        """n and n.a of the plane through three points, the hull's inside on the negative side."""
        u, v = ([self.q[k][j] - self.q[a][j] for j in range(3)] for k in (b, c))
        n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        d = sum(e * f for e, f in zip(n, self.q[a], strict=True))
        sign = -1 if sum(e * f for e, f in zip(n, self.inner, strict=True)) > 4 * d else 1
        g = math.gcd(*n, d) or 1
        return *(sign * e // g for e in n), sign * d // g

    def first(self) -> tuple[int, ...] | None:
        """Four points that aren't in one plane."""
        x = self.x
        if len(x) < 4:
            return None
        a = int(np.lexsort(x.T[::-1])[0])
        b = int(((x - x[a]) ** 2).sum(1).argmax())
        u = x - x[a]
        c = int((np.cross(u, u[b]) ** 2).sum(1).argmax())
        side = u @ np.cross(u[b], u[c])
        for d in np.argsort(-np.abs(side)).tolist():
            if volume(*(self.q[k] for k in (a, b, c, d))):
                return a, b, c, d
            if abs(side[d]) < 1e-6 * np.abs(side).max() or not side[d]:
                break
        return next((t for t in ((a, b, c, d) for d in range(len(x))) if volume(*(self.q[k] for k in t))), None)

    def put(self, faces: list[tuple[int, int, int]]) -> None:
        new = [self.plane(*f) for f in faces]
        self.faces += faces
        self.exact += new
        self.planes = np.vstack([self.planes, np.array(new, float)])

    def insert(self, p: int) -> None:
        terms = self.planes * np.append(self.x[p], -1.0)
        value, rounding = terms.sum(1), 1e-14 * np.abs(terms).sum(1)
        seen = [int(k) for k in np.flatnonzero(value >= -rounding) if value[k] > rounding[k] or self.side(int(k), p) >= 0]
        if not seen:
            return
        edges: dict[tuple[int, int], int] = {}
        for k in seen:
            for e in itertools.combinations(sorted(self.faces[k]), 2):
                edges[e] = edges.get(e, 0) + 1
        left = np.ones(len(self.faces), bool)
        left[seen] = False
        keep = np.flatnonzero(left).tolist()
        self.faces, self.exact, self.planes = [self.faces[k] for k in keep], [self.exact[k] for k in keep], self.planes[left]
        self.put([(*e, p) for e, times in edges.items() if times == 1])

    def side(self, k: int, p: int) -> int:
        return sum(e * f for e, f in zip(self.exact[k], (*self.q[p], -1), strict=True))

    def corners(self) -> list[int]:
        """Points where at least three planes meet; all points where there is no hull."""
        if not self.faces:
            return list(range(len(self.q)))
        met: dict[int, set] = {}
        for f, e in zip(self.faces, self.exact, strict=True):
            for k in f:
                met.setdefault(k, set()).add(e)
        return sorted(k for k, planes in met.items() if len(planes) > 2)

    def equations(self) -> np.ndarray:
        """Outward normals of length one and offsets, one row a plane: n.x + d is 0 on it and negative inside."""
        found = np.array(sorted(set(self.exact)), float).reshape(-1, 4)
        size = np.sqrt((found[:, :3] ** 2).sum(1))
        return np.column_stack([found[:, :3], -found[:, 3] * UNIT]) / size[:, None]


def volume(a, b, c, d) -> int:
    u, v, w = ([e - f for e, f in zip(x, a, strict=True)] for x in (b, c, d))
    return u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])


def hull_corners(points: DataFrame, size: int = 2048) -> DataFrame:
    """unit, i, px, py, pz of the corners of each unit's hull; all points of a unit that has no volume.

    Points at one place count once, by the smallest index. A round deals each
    unit into groups of about `size`; rounds end when a unit is one group, or
    when dealing no longer helps because nearly all points are corners.
    """

    def of(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        return p.iloc[Hull(p[XYZ_LIST].to_numpy(float)).corners()][["unit", "i", *XYZ]]

    left = stored(points.dropna(subset=[*XYZ]).groupBy("unit", *XYZ).agg(F.min("i").alias("i")).select("unit", "i", *XYZ), "hull")
    before = None
    while True:
        sizes = left.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
        most, total = sizes.agg(F.max("n"), F.sum("n")).first()
        last = most is None or most <= size or before is not None and total > 0.9 * before
        groups = F.lit(1) if last else F.ceil(F.col("n") / size)
        dealt = left.join(sizes, "unit").withColumn("group", F.pmod(F.xxhash64("i"), groups).cast("int"))
        left = stored(dealt.groupBy("unit", "group").applyInPandas(of, "unit int, i long, px double, py double, pz double"), "hull")
        if last:
            return left
        before = total


def hull_planes(corners: DataFrame) -> DataFrame:
    """unit, planes: each hull's planes (x, y, z, d), the outward normal and the offset; none for a unit without volume."""

    def of(key, p: pd.DataFrame) -> pd.DataFrame:
        found = Hull(p.sort_values("i")[XYZ_LIST].to_numpy(float)).equations() if len(p) > 3 else np.zeros((0, 4))
        return pd.DataFrame({"unit": [key[0]], "planes": [[dict(zip("xyzd", map(float, e), strict=True)) for e in found]]})

    return corners.groupBy("unit").applyInPandas(of, "unit int, planes array<struct<x: double, y: double, z: double, d: double>>")


def hull_depth(points: DataFrame, planes: DataFrame) -> DataFrame:
    """unit, i, depth: the distance of each point to the nearest plane of its unit's hull; null without a hull."""
    below = lambda e: -(e["x"] * F.col("px") + e["y"] * F.col("py") + e["z"] * F.col("pz") + e["d"])
    return points.select("unit", "i", *XYZ).join(planes, "unit", "left").select("unit", "i", F.array_min(F.transform("planes", below)).alias("depth"))
