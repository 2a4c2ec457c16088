"""Graphs about each point as rows of bit masks, and their invariants.

A point's lining is the point itself (bit 0) and its nearest neighbours, at most
62; one 64-bit mask a member says whom it touches. Linings are built from blocks of
near points, of which only the nearest leave a task, and are rows of their own, so
neither a unit nor a neighbourhood is ever held whole.
Counts of triangles, squares and the like are expressions on the masks; what
needs a search (cores, cliques, girth, cut points) is Python on one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import cut_parts
from tessera.operators.spatial import XYZ, nearest_within

#: Cycles longer than this count as none.
LONGEST = 12
INVARIANTS = ("tri_centre", "c4_centre", "kcore", "ecc_centre", "maxclique", "p4_centre", "expansion", "tri_wall", "girth_wall", "diam_wall", "wiener_wall", "bridges_wall", "artic_wall", "leaves_wall", "bipartite_wall")


def linings(points: DataFrame, near: float = 10.0, touch: float = 7.0, most: int = 48) -> DataFrame:
    """unit, i, masks, wide: for each point with neighbours within `near`, who touches whom among it and its `most` nearest.

    masks says who lies within `touch`, wide who lies within `near`. Members are
    in order of their indices, or of distance where some were left out.
    """
    rows = nearest_within(points, near, most)
    cut = F.col("n") > most
    members = F.transform("near", lambda m, k: F.struct(F.when(cut, k.cast("long")).otherwise(m["dst"]).alias("at"), *[m[c].alias(c) for c in XYZ]))
    own = F.struct(F.lit(None).cast("long").alias("at"), *[F.col(f"s_{c}").alias(c) for c in XYZ])
    found = rows.select("unit", "i", F.array_sort(members).alias("others"), own.alias("own"))
    d2 = lambda x, y: sum(((x[c] - y[c]) * (x[c] - y[c]) for c in XYZ[1:]), (x[XYZ[0]] - y[XYZ[0]]) * (x[XYZ[0]] - y[XYZ[0]]))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    touches = lambda r: lambda x, j: F.aggregate(F.transform("m", lambda y, k: F.when((j != k) & (d2(x, y) <= r * r), bit(k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return found.select("unit", "i", F.concat(F.array("own"), "others").alias("m")).select("unit", "i", F.transform("m", touches(touch)).alias("masks"), F.transform("m", touches(near)).alias("wide"))


def _summed(f) -> Column:
    """Sum of f(mask, place) over the members."""
    return F.aggregate(F.transform("masks", f), F.lit(0).cast("long"), lambda a, b: a + b)


def lining_counts(rows: DataFrame) -> DataFrame:
    """unit, i and the counts that are sums over masks: triangles and squares with the point, paths of four from it, points two steps away, triangles and leaves of the wall."""
    own, zero, one = F.get("masks", F.lit(0)), F.lit(0).cast("long"), F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, k)
    meets = lambda m, k: m.bitwiseAND(bit(k)) != 0
    size = lambda m: F.bit_count(m).cast("long")
    wall = lambda m: F.shiftright(m, 1)
    common = lambda m: size(m.bitwiseAND(own))
    triangles = _summed(lambda m, k: F.when(meets(own, k), common(m)).otherwise(zero))
    squares = _summed(lambda m, k: F.when((k > 0) & ~meets(own, k), common(m) * (common(m) - 1)).otherwise(zero))
    two = F.aggregate(F.transform("masks", lambda m, k: F.when(meets(own, k), m).otherwise(zero)), zero, lambda a, b: a.bitwiseOR(b))
    ends = lambda a, i, b, j: size(b.bitwiseAND(F.bitwise_not(own.bitwiseOR(a).bitwiseOR(bit(i)).bitwiseOR(one))))
    paths = _summed(lambda a, i: F.when(meets(own, i), _summed(lambda b, j: F.when((j > 0) & meets(a, j) & ~meets(own, j), ends(a, i, b, j)).otherwise(zero))).otherwise(zero))
    walls = _summed(lambda a, i: F.when(i > 0, _summed(lambda b, j: F.when((j > 0) & meets(a, j), size(wall(a).bitwiseAND(wall(b)))).otherwise(zero))).otherwise(zero))
    leaves = _summed(lambda m, k: F.when((k > 0) & (F.bit_count(wall(m)) == 1), one).otherwise(zero))
    return rows.select("unit", "i", (triangles / 2).cast("long").alias("tri_centre"), (squares / 2).cast("long").alias("c4_centre"), paths.alias("p4_centre"), size(two.bitwiseAND(F.bitwise_not(own.bitwiseOR(one)))).alias("expansion"), (walls / 6).cast("long").alias("tri_wall"), leaves.alias("leaves_wall"))


def bits(m: int) -> Iterator[int]:
    while m:
        low = m & -m
        yield low.bit_length() - 1
        m ^= low


def layers(near: list[int], start: int) -> Iterator[int]:
    """Masks of the nodes at 0, 1, 2 ... steps from start."""
    seen = front = 1 << start
    while front:
        yield front
        reach = 0
        for k in bits(front):
            reach |= near[k]
        front = reach & ~seen
        seen |= front


def core_number(near: list[int], node: int) -> int:
    left, k = (1 << len(near)) - 1, 0
    while True:
        low = [j for j in bits(left) if (near[j] & left).bit_count() < k + 1]
        if not low:
            k += 1
        elif node in low:
            return k
        else:
            left &= ~sum(1 << j for j in low)


def largest_clique(near: list[int], among: int, size: int = 0, best: int = 0) -> int:
    """The most members of `among` that all touch each other, on top of size; branches that can't beat best end."""
    if not among:
        return max(size, best)
    pivot = max(bits(among), key=lambda k: (near[k] & among).bit_count())
    for k in bits(among & ~near[pivot]):
        if size + among.bit_count() <= best:
            break
        best = largest_clique(near, among & near[k], size + 1, best)
        among &= ~(1 << k)
    return best


def girth(near: list[int]) -> int:
    """Length of the shortest cycle, 0 if none is at most LONGEST long."""
    best = LONGEST + 1
    for s in range(len(near)):
        last = 0
        for d, front in enumerate(layers(near, s)):
            if 2 * d + 1 >= best:
                break
            if any(near[k] & front for k in bits(front)):
                best = 2 * d + 1
                break
            once = twice = 0
            for k in bits(front):
                twice |= once & near[k]
                once |= near[k]
            if twice & ~last & ~front and 2 * d + 2 < best:
                best = 2 * d + 2
                break
            last = front
    return best if best <= LONGEST else 0


def invariants(masks: list[int]) -> tuple[int, ...]:
    """The fifteen numbers of one lining, in the order of INVARIANTS."""
    own = masks[0]
    near0 = list(bits(own))
    around = list(layers(masks, 0))
    squares = [(masks[k] & own).bit_count() for k in range(1, len(masks)) if not own >> k & 1]
    paths = sum((masks[b] & ~own & ~masks[a] & ~(1 << a) & ~1).bit_count() for a in near0 for b in bits(masks[a] & ~own & ~1))
    wall = [m >> 1 for m in masks[1:]]
    steps = [list(layers(wall, s)) for s in range(len(wall))]
    parts: dict[int, int] = {}
    for s, x in enumerate(steps):
        parts.setdefault(sum(x), s)
    biggest = max(parts, key=lambda m: (m.bit_count(), -parts[m]))
    inside = [steps[s] for s in bits(biggest)]
    bridges, cuts = cut_parts(matrix(wall))
    return (
        sum((masks[k] & own).bit_count() for k in near0) // 2,
        sum(c * (c - 1) // 2 for c in squares),
        core_number(masks, 0),
        len(around) - 1,
        1 + largest_clique(masks, own),
        paths,
        around[2].bit_count() if len(around) > 2 else 0,
        sum((wall[a] & wall[b]).bit_count() for a in range(len(wall)) for b in bits(wall[a])) // 6,
        girth(wall),
        max(len(x) - 1 for x in inside),
        sum(d * front.bit_count() for x in inside for d, front in enumerate(x)) // 2,
        int(bridges),
        cuts,
        sum(m.bit_count() == 1 for m in wall),
        int(not any(wall[k] & front for x in steps for front in x for k in bits(front))),
    )


def matrix(masks: list[int]) -> np.ndarray:
    return np.array([[m >> k & 1 for k in range(len(masks))] for m in masks], float).reshape(len(masks), -1)


def spectrum(wide: list[int], masks: list[int]) -> tuple[float, float, float, int, int]:
    """Second and largest eigenvalue of the lining's Laplacian, its mean degree, and of the wall, by touch, the parts and the independent cycles."""
    a = matrix(wide)
    w = np.linalg.eigvalsh(np.diag(a.sum(1)) - a)
    wall = [m >> 1 for m in masks[1:]]
    parts = len({sum(layers(wall, s)) for s in range(len(wall))})
    return float(w[1]), float(w[-1]), float(a.sum() / len(a)), parts, sum(m.bit_count() for m in wall) // 2 - len(wall) + parts


def _by_row(points: DataFrame, rows: DataFrame, f, columns: dict[str, str]) -> DataFrame:
    """unit, i and f(row) for each lining; zeros for points without neighbours."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [f([int(m) for m in x], [int(m) for m in y]) for x, y in zip(b["wide"], b["masks"], strict=True)]
            yield pd.DataFrame({"unit": b["unit"], "i": b["i"], **{c: pd.Series([r[k] for r in found], dtype="float64" if t == "double" else "int64") for k, (c, t) in enumerate(columns.items())}})

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.mapInPandas(run, f"unit {kind['unit']}, i {kind['i']}, " + ", ".join(f"{c} {t}" for c, t in columns.items()))
    return points.select("unit", "i").join(found, ["unit", "i"], "left").select("unit", "i", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in columns.items()])


def lining_invariants(points: DataFrame, near: float = 10.0, touch: float = 7.0, most: int = 48) -> DataFrame:
    """unit, i and the fifteen invariants of each point's lining; all 0 for a point without neighbours."""
    return _by_row(points, linings(points, near, touch, most), lambda wide, masks: invariants(masks), dict.fromkeys(INVARIANTS, "long"))


def lining_spectra(points: DataFrame, near: float = 10.0, touch: float = 7.0, most: int = 48) -> DataFrame:
    """unit, i, fiedler, lap_max, mean_degree, betti0, betti1 of each point's lining, each a matrix of its own."""
    return _by_row(points, linings(points, near, touch, most), spectrum, {"fiedler": "double", "lap_max": "double", "mean_degree": "double", "betti0": "long", "betti1": "long"})
