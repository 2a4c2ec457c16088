"""Small dense linear algebra per unit: axes, superposition, local fits, elastic modes, tetrahedra."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import SPARE, connected_parts
from tessera.operators.solvers import CORNER, corner, largest, lowest
from tessera.session import dealt

XYZ = ["px", "py", "pz"]
#: Points of a unit whose elastic network is solved as one matrix.
WHOLE = 1500
#: Cells of a grid that is held at once.
MOST_CELLS = 1 << 25


def fixed_sign(v: np.ndarray) -> np.ndarray:
    """The sign that makes the first largest entry positive."""
    return v * (np.sign(v[np.argmax(np.abs(v) > np.abs(v).max() * (1 - 1e-9))]) or 1)


def smallest_axis(moments: DataFrame, unit: str) -> DataFrame:
    """Axis of least spread from six moments xx, yx, yy, zx, zy, zz per unit."""

    def of(batches):
        for p in batches:
            rows = []
            for r in p.itertuples():
                m = np.array([[r.xx, r.yx, r.zx], [r.yx, r.yy, r.zy], [r.zx, r.zy, r.zz]])
                w, v = np.linalg.eigh(m)
                rows.append((r[1], *(float(x) for x in fixed_sign(v[:, 0])), float(w[0])))
            yield pd.DataFrame(rows, columns=[unit, "ax", "ay", "az", "spread"])

    return moments.select(unit, "xx", "yx", "yy", "zx", "zy", "zz").mapInPandas(of, f"{unit} int, ax double, ay double, az double, spread double")


def superposed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """a moved onto b by the best rotation, and the root mean square deviation."""
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    d = np.sign(np.linalg.det(u @ vt))
    moved = (a - ca) @ (u @ np.diag([1, 1, d]) @ vt) + cb
    return moved, float(np.sqrt(((moved - b) ** 2).sum(1).mean()))


def pair_rmsd(pairs: DataFrame, least: int = 3) -> DataFrame:
    """RMSD per unit after superposition of ax, ay, az on bx, by, bz; null below `least` pairs.

    The best rotation needs a unit's sums of products only: they are added up in
    each task, twice over rows, the second time about the centres; what is left
    is one 3 x 3 matrix a unit.
    """
    ends = [f"{s}{c}" for s in "ab" for c in "xyz"]
    centre = pairs.groupBy("unit").agg(*[F.avg(c).alias(f"m{c}") for c in ends])
    off = {c: F.col(c) - F.col(f"m{c}") for c in ends}
    products = [F.sum(off[f"a{p}"] * off[f"b{q}"]).alias(f"h{p}{q}") for p in "xyz" for q in "xyz"]
    sums = pairs.join(centre, "unit").groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum(sum((o * o for o in off.values()), F.lit(0.0))).alias("spread"), *products)

    def of(batches):
        for p in batches:
            rows = []
            for r in p.itertuples(index=False):
                u, s, vt = np.linalg.svd(np.array(r[3:], float).reshape(3, 3))
                left = r.spread - 2 * (s[0] + s[1] + np.sign(np.linalg.det(u @ vt)) * s[2])
                rows.append((r.unit, r.n, float(np.sqrt(max(left, 0.0) / r.n)) if r.n >= least else None))
            yield pd.DataFrame(rows, columns=["unit", "n", "rmsd"])

    return sums.mapInPandas(of, "unit int, n long, rmsd double")


def elastic_hessian(x: np.ndarray, cutoff: float) -> np.ndarray:
    n = len(x)
    h = np.zeros((n, 3, n, 3))
    for a in range(n):
        for b in range(a + 1, n):
            off = x[b] - x[a]
            d2 = float(off @ off)
            if 0 < d2 <= cutoff * cutoff:
                block = np.outer(off, off) / d2 / d2
                h[a, :, b, :] -= block
                h[b, :, a, :] -= block
                h[a, :, a, :] += block
                h[b, :, b, :] += block
    return h.reshape(3 * n, 3 * n)


#: Pairs in a tile of a network's matrix.
STRIP = 1 << 15


def _springs(x: np.ndarray, cutoff: float):
    """Tiles on and above the diagonal of the network's matrix, without the points' own parts: both sides' points, and the tile, by (axis, point); made anew each time."""
    n, side = len(x), max(1, int(STRIP**0.5))
    places = np.ascontiguousarray(x.T)
    held = np.empty((13, side * side))  # one place for all tiles: a tile is good until the next one
    for i in range(0, n, side):
        a = slice(i, min(i + side, n))
        for j in range(i, n, side):
            b = slice(j, min(j + side, n))
            shape = a.stop - a.start, b.stop - b.start
            size = shape[0] * shape[1]
            *off, d2 = (held[c, :size].reshape(shape) for c in range(4))
            tile = held[4:].reshape(-1)[: 9 * size].reshape(3, shape[0], 3, shape[1])
            square = tile.reshape(-1)[:size].reshape(shape)
            for c in range(3):
                np.subtract(places[c, None, b], places[c, a, None], out=off[c])
                np.multiply(off[c], off[c], out=square if c else d2)
                if c:
                    d2 += square
            if not (0 < d2.min() and d2.max() <= cutoff * cutoff):
                d2[(d2 == 0) | ~(d2 <= cutoff * cutoff)] = np.inf
                if not (d2 < np.inf).any():
                    continue
            for o in off:
                o /= d2
            for p in range(3):
                for q in range(p, 3):
                    np.multiply(off[p], off[q], out=tile[p, :, q])
                    if p != q:
                        tile[q, :, p] = tile[p, :, q]
            yield a, b, tile


def soft_modes(x: np.ndarray, k: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """The k least eigenvalues above a millionth of the largest, and their vectors (point, axis, mode), from products with tiles of the matrix."""
    n = len(x)
    total = np.zeros((3, n, 3))
    for a, b, tile in _springs(x, cutoff):
        total[:, a] += tile.sum(3)
        if a != b:
            total[:, b] += tile.sum(1).transpose(0, 2, 1)
    own = np.ascontiguousarray(total.transpose(1, 0, 2))

    def times(v: np.ndarray) -> np.ndarray:
        v = v.reshape(n, 3, -1)
        m = v.shape[2]
        by, out = np.ascontiguousarray(v.transpose(1, 0, 2)), np.zeros((3, n, m))
        for a, b, tile in _springs(x, cutoff):
            t = tile.reshape(3 * tile.shape[1], -1)
            out[:, a] -= (t @ by[:, b].reshape(-1, m)).reshape(3, -1, m)
            if a != b:
                out[:, b] -= (t.T @ by[:, a].reshape(-1, m)).reshape(3, -1, m)
        return (np.einsum("nab,nbm->nam", own, v) + out.transpose(1, 0, 2)).reshape(3 * n, -1)

    size, axes = np.linalg.eigh(own)

    few = np.sort(np.argsort(size[:, 0], kind="stable")[: CORNER // 3])
    rows = (3 * few[:, None] + np.arange(3)).ravel()
    part = np.zeros((len(few), 3, len(few), 3))
    for a, b, tile in _springs(x[few], cutoff):
        part[a, :, b] = -tile.transpose(1, 0, 3, 2)
        part[b, :, a] = -tile.transpose(3, 2, 1, 0)
    part[np.arange(len(few)), :, np.arange(len(few))] = own[few]
    part = part.reshape(3 * len(few), -1)

    def divided(left: np.ndarray, w: np.ndarray) -> np.ndarray:
        least = 0.02 * np.maximum(np.abs(w), 1e-6 * size.max())

        def gap_of(s: np.ndarray) -> np.ndarray:
            gap = s - w
            return np.where(np.abs(gap) < least, np.where(gap < 0, -least, least), gap)

        turned = np.einsum("nab,nam->nbm", axes, left.reshape(n, 3, -1))
        return mend(np.einsum("nab,nbm->nam", axes, turned / gap_of(size[:, :, None])).reshape(3 * n, -1), left, gap_of)

    # rigid motions of each part of the network cost nothing
    label = connected_parts(x, cutoff)
    motions = []
    for one in range(label.max() + 1):
        m = label == one
        y = np.where(m[:, None], x - x[m].mean(0), 0.0)
        motion = np.zeros((n, 3, 6))
        for c in range(3):
            motion[m, c, c] = 1
            motion[:, (c + 1) % 3, 3 + c], motion[:, (c + 2) % 3, 3 + c] = -y[:, (c + 2) % 3], y[:, (c + 1) % 3]
        u, s, _ = np.linalg.svd(motion.reshape(3 * n, 6), full_matrices=False)
        motions.append(u[:, s > 1e-9 * max(s[0], 1)])
    null = np.hstack(motions)
    top, more = float(size.max(initial=0.0)), 0
    while True:
        wide = min(k + more + SPARE, 3 * n - null.shape[1])
        if wide < 1:
            return np.zeros(0), np.zeros((n, 3, 0))
        start, mend = corner(rows, part, null, wide)
        w, v = lowest(times, divided, null, start, min(k + more, wide), 1e-14 * top * np.sqrt(3 * n) + 1e-10)
        least = 1e-6 * max(top, 1e-12)
        if ((w > least * (1 - 1e-6)) & (w <= 2 * least)).any():  # the largest eigenvalue lies between the largest own one and twice that
            least = 1e-6 * largest(times, 3 * n)
        use = w > least
        if use.sum() >= k or len(w) == 3 * n - null.shape[1]:
            return w[use][:k], v[:, use][:, :k].reshape(n, 3, -1)
        more += k - int(use.sum())


def elastic_modes(points: DataFrame, k: int = 6, cutoff: float = 12.0) -> DataFrame:
    """Per point: its share in the k softest non-rigid modes, and amplitude over eigenvalue summed.

    A unit above WHOLE points is solved by products with strips of its matrix,
    which no task ever holds: memory grows with points, time with pairs.
    """

    def of(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        x = p[XYZ].to_numpy(float)
        if len(p) <= WHOLE:
            w, v = np.linalg.eigh(elastic_hessian(x, cutoff))
            use = np.flatnonzero(w > 1e-6 * max(w.max(), 1e-12))[:k]
            w, v = w[use], v[:, use].reshape(len(p), 3, len(use))
        else:
            w, v = soft_modes(x, k, cutoff)
        m = (v**2).sum(1)
        return pd.DataFrame({"unit": key[0], "i": p.i, "share": m.sum(1) / max(len(w), 1), "thermal": (m / w).sum(1) if len(w) else 0.0})

    return dealt(points.select("unit", "i", *XYZ), "unit").groupBy("unit").applyInPandas(of, "unit int, i long, share double, thermal double")


def delaunay(points: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Tetrahedra by incremental insertion (Bowyer and Watson), in exact integers of 2**-40.

    Whether a point lies in a sphere is first asked of all spheres at once in
    floats; where the sign is within their rounding, of integers.
    """
    q = [tuple(int(v) for v in np.rint(p * 2.0**40)) for p in points]
    far = 64 * (max((abs(v) for p in q for v in p), default=1) + 1)
    n = len(q)
    q += [(-far, -far, -far), (4 * far, -far, -far), (-far, 4 * far, -far), (-far, -far, 4 * far)]

    def cross(u, v) -> tuple[int, int, int]:
        return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]

    def form(t) -> tuple[int, int, int, int]:
        """Of x, the offset from the first corner: m.x + v |x|^2 is negative inside the sphere. v is six volumes, 0 if flat."""
        u = [tuple(e - f for e, f in zip(q[k], q[t[0]], strict=True)) for k in t[1:]]
        w = [sum(e * e for e in x) for x in u]
        c = [cross(u[1], u[2]), cross(u[2], u[0]), cross(u[0], u[1])]
        v = sum(e * f for e, f in zip(u[0], c[0], strict=True))
        sign = -1 if v < 0 else 1
        return *(-sign * sum(w[j] * c[j][k] for j in range(3)) for k in range(3)), sign * v

    tets: list = []
    exact: list = []
    free: list[int] = []
    corner, forms = np.zeros((64, 3)), np.zeros((64, 4))

    def add(t, f) -> None:
        nonlocal corner, forms
        if free:
            k = free.pop()
            tets[k], exact[k] = t, f
        else:
            k = len(tets)
            tets.append(t)
            exact.append(f)
            if k == len(forms):
                corner, forms = np.vstack([corner, 0 * corner]), np.vstack([forms, 0 * forms])
        corner[k], forms[k] = q[t[0]], f

    def inside(k: int, p: int) -> bool:
        x = [e - f for e, f in zip(q[p], q[tets[k][0]], strict=True)]
        return sum(e * f for e, f in zip(exact[k], (*x, sum(e * e for e in x)), strict=True)) < 0

    add((n, n + 1, n + 2, n + 3), form((n, n + 1, n + 2, n + 3)))
    seen = set()
    for p in range(n):
        if q[p] in seen:
            continue
        seen.add(q[p])
        x = np.array(q[p], float) - corner[: len(tets)]
        terms = forms[: len(tets)] * np.column_stack([x, (x * x).sum(1)])
        value, rounding = terms.sum(1), 1e-14 * np.abs(terms).sum(1)
        bad = [int(k) for k in np.flatnonzero(value <= rounding) if tets[k] and (value[k] < -rounding[k] or inside(k, p))]
        faces: dict = {}
        for k in bad:
            for f in itertools.combinations(sorted(tets[k]), 3):
                faces[f] = faces.get(f, 0) + 1
            tets[k], forms[k] = None, 0.0
        free += bad
        for f, times in faces.items():
            if times == 1 and (new := form((*f, p)))[3]:
                add((*f, p), new)
    return sorted(tuple(sorted(t)) for t in tets if t and max(t) < n)


def sphere(a, b, c, d) -> tuple[np.ndarray, float]:
    m = 2 * np.array([b - a, c - a, d - a])
    if abs(np.linalg.det(m)) < 1e-9:
        return np.full(3, np.nan), np.inf
    centre = np.linalg.solve(m, [(b @ b - a @ a), (c @ c - a @ a), (d @ d - a @ a)])
    return centre, float(np.linalg.norm(centre - a))


def near_voids(x: np.ndarray, low: float) -> np.ndarray:
    """Which points may lie on an empty sphere of radius `low` or more; those in dense parts can't.

    Such a point also lies on an empty ball of radius `low`. The box is cut into
    cells of a quarter of it: the cell of the ball's centre is empty, with all
    that lie within the ball wherever in its cell the centre is, and the point is
    within `low` of that cell.
    """
    side, pad, reach = low / 4, 7, range(-5, 6)
    at = np.floor((x - x.min(0)) / side).astype(np.int64) + pad
    shape = at.max(0) + pad + 1
    if shape.prod() > MOST_CELLS:
        return np.ones(len(x), bool)
    full = np.zeros(shape, bool)
    full[tuple(at.T)] = True
    steps = list(itertools.product(reach, repeat=3))
    within = [d for d in steps if sum((abs(k) + 1) ** 2 for k in d) <= 16]
    about = [d for d in steps if sum(max(abs(k) - 1, 0) ** 2 for k in d) <= 17]
    moved = lambda m, d: m[tuple(slice(5 + k, n - 5 + k) for k, n in zip(d, m.shape, strict=True))]
    deep = np.ones(shape, bool)  # beyond the box all is empty
    deep[5:-5, 5:-5, 5:-5] = ~np.logical_or.reduce([moved(full, d) for d in within])
    found = np.zeros(shape, bool)
    for d in about:
        found[5:-5, 5:-5, 5:-5] |= moved(deep, d)
    return found[tuple(at.T)]


def void_spheres(points: DataFrame, low: float, high: float, cell: float | None = None) -> DataFrame:
    """Delaunay tetrahedra of each unit's points whose spheres have a radius in the band.

    A unit's box is cut into cells at least `cell` wide (by default twice the
    largest radius). A cell's task gets the points within the largest radius of
    it, and keeps the spheres whose centres lie in it; outer cells reach to
    infinity. A sphere's corners and all that could lie in it are within its
    radius of its centre, so each sphere comes out of one cell, and is empty
    there where it is empty in the unit. Points in dense parts, which no such sphere
    can touch, are left out of the triangulation, and its spheres held against them
    afterwards. At a fixed density a cell holds a bounded
    number of points, whatever the unit's size; a box less than two cells wide
    stays whole.
    """
    wide, halo = cell or 2 * high, high * (1 + 1e-9)
    box = points.groupBy("unit").agg(*[f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))])
    placed = points.select("unit", "i", *XYZ).join(box, "unit")
    for c in XYZ:
        lo, span = F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")
        n = F.greatest(F.floor(span / wide), F.lit(1)).cast("int")
        side = span / n
        # a box without extent is one cell
        at = lambda x, n=n, side=side: F.when(side > 0, F.least(F.greatest(F.floor(x / side), F.lit(0)), n - 1)).otherwise(0).cast("int")
        own = F.explode(F.sequence(at(F.col(c) - lo - halo), at(F.col(c) - lo + halo)))
        placed = placed.withColumn(f"n_{c}", n).withColumn(f"side_{c}", side).withColumn(f"at_{c}", own)

    def of(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        x, first = p[XYZ].to_numpy(float), p.iloc[0]
        lo, side, n = (first[[f"{k}_{c}" for c in XYZ]].to_numpy(float) for k in ("lo", "side", "n"))
        rows = []
        keep = near_voids(x, low) if low > 0 and len(p) > 3 else np.ones(len(p), bool)
        dropped, p, x = x[~keep], p[keep], x[keep]
        for t in delaunay(x) if len(p) > 3 else []:
            centre, r = sphere(*x[list(t)])
            if low <= r <= high:
                at = np.clip(np.floor((centre - lo) / np.where(side > 0, side, 1)), 0, n - 1)
                if (at == key[1:]).all() and not (((dropped - centre) ** 2).sum(1) < r * r).any():
                    rows.append((key[0], *[int(p.i.iloc[m]) for m in t], *[float(v) for v in centre], r))
        return pd.DataFrame(rows, columns=["unit", "a", "b", "c", "d", "cx", "cy", "cz", "radius"])

    cells = ["unit", *[f"at_{c}" for c in XYZ]]
    return dealt(placed, *cells).groupBy(*cells).applyInPandas(of, "unit int, a long, b long, c long, d long, cx double, cy double, cz double, radius double")


def peel_depth(points: DataFrame, directions: int = 32) -> DataFrame:
    """How many rounds of taking away extreme points (along fixed directions) reach each point."""
    axes = np.random.default_rng(0).standard_normal((directions, 3))

    def of(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        x = p[XYZ].to_numpy(float) @ axes.T
        depth, left, k = np.full(len(p), -1), np.ones(len(p), bool), 0
        while left.any():
            own = np.flatnonzero(left)
            out = np.unique(own[x[own].argmax(0)])
            depth[out], left[out] = k, False
            k += 1
        return pd.DataFrame({"unit": key[0], "i": p.i, "depth": depth})

    return dealt(points.select("unit", "i", *XYZ), "unit").groupBy("unit").applyInPandas(of, "unit int, i long, depth int")


def hull_fallback(points: DataFrame) -> DataFrame:
    """Points at or beyond the 85th percentile of the radius about the centre: the form of the hull used where none is built."""
    from pyspark.sql import Window

    u = Window.partitionBy("unit")
    r = points.withColumn("r", F.sqrt(sum(((F.col(c) - F.avg(c).over(u)) ** 2 for c in XYZ), F.lit(0.0))))
    return r.select("unit", "i", (F.col("r") >= F.percentile("r", F.lit(0.85)).over(u)).alias("outer"))
