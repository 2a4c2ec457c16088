"""Queries on contact graphs, spectra, voxels and the feature families built from them (GRA, FEA)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import contacts as C
from tessera.operators import detectors as D
from tessera.operators import ego as E
from tessera.operators import graph as G
from tessera.operators import hull as H
from tessera.operators import linear as L
from tessera.operators import spatial as S
from tessera.operators import voids as V
from tessera.operators import windows as W
from tessera.operators.local import local_shapes
from tessera.plans.bindings import EV, PTS, ev, pts
from tessera.plans.registry import query
from tessera.plans.shapes import NB, TORSION, torsions
from tessera.plans.spatial import COUNT8, D2, _counts, edge_sql
from tessera.session import table


def edge8(spark, d):
    return S.edges(pts(spark, d), 8.0)


@query("GRA01_deflated_edges", f"WITH {PTS}, {COUNT8}, m AS (SELECT unit, greatest(max(n), 1) AS top FROM n GROUP BY unit), {edge_sql(8)} SELECT e.unit, src, dst, round(d * (top / least(greatest(a.n, 1), greatest(b.n, 1))::DOUBLE) ** 2, 6) AS d FROM e JOIN n a ON e.unit = a.unit AND e.src = a.i JOIN n b ON e.unit = b.unit AND e.dst = b.i JOIN m ON m.unit = e.unit")
def gra01(spark, d):
    return deflated(spark, d).select("unit", "src", "dst", S.rounded(F.col("d"), 6).alias("d"))


def crowded(spark, d):
    """Points with their number within 8 (rho) and the unit's largest (top)."""
    p = pts(spark, d)
    n = _counts(p, 8.0).select("unit", "i", F.greatest("n", F.lit(1)).alias("rho")).withColumn("top", F.max("rho").over(Window.partitionBy("unit")))
    return p.join(n, ["unit", "i"])


def deflated(spark, d):
    e = S.edges(crowded(spark, d), 8.0, ["rho", "top"])
    return e.select("unit", "src", "dst", (F.col("d") * F.pow(F.col("s_top") / F.least("s_rho", "t_rho"), F.lit(2.0))).alias("d"))


def _bottlenecks(doublings=7):
    """Ranks of undirected deflated edges (rk), and the least possible largest rank on a path between two nodes (bt); paths double in length."""
    steps = [f"b{k + 1} AS MATERIALIZED (SELECT unit, i, j, min(r) AS r FROM (SELECT * FROM b{k} UNION ALL SELECT x.unit, x.i, y.j, greatest(x.r, y.r) FROM b{k} x JOIN b{k} y ON x.unit = y.unit AND x.j = y.i) GROUP BY ALL)" for k in range(doublings)]
    return f"""{PTS}, {COUNT8}, m AS (SELECT unit, greatest(max(n), 1) AS top FROM n GROUP BY unit), {edge_sql(8)},
    rk AS MATERIALIZED (SELECT e.unit, src, dst, d * (top / least(greatest(a.n, 1), greatest(b.n, 1))::DOUBLE) ** 2 AS d, row_number() OVER (PARTITION BY e.unit ORDER BY d * (top / least(greatest(a.n, 1), greatest(b.n, 1))::DOUBLE) ** 2, src, dst) AS r
           FROM e JOIN n a ON e.unit = a.unit AND e.src = a.i JOIN n b ON e.unit = b.unit AND e.dst = b.i JOIN m ON m.unit = e.unit WHERE src < dst),
    b0 AS (SELECT unit, src AS i, dst AS j, r FROM rk UNION ALL SELECT unit, dst, src, r FROM rk), {", ".join(steps)}, bt AS (SELECT * FROM b{doublings}),
    fo AS MATERIALIZED (SELECT rk.* FROM rk JOIN bt ON rk.unit = bt.unit AND src = i AND dst = j AND rk.r = bt.r)"""


BOTTLENECKS = _bottlenecks()
#: Of each forest edge: the nodes that its merge and those before it leave in one component with each node; then the best edge before one component holds nine tenths.
MERGES = f"""{BOTTLENECKS}, nd AS (SELECT DISTINCT unit, src AS i FROM e),
    co AS (SELECT fo.unit, fo.r, fo.d, nd.i, least(nd.i, coalesce(min(bt.j), nd.i)) AS root FROM fo JOIN nd ON nd.unit = fo.unit LEFT JOIN bt ON bt.unit = fo.unit AND bt.i = nd.i AND bt.r <= fo.r GROUP BY fo.unit, fo.r, fo.d, nd.i),
    sz AS (SELECT unit, r, d, root, count(*) AS size FROM co GROUP BY ALL), ct AS (SELECT unit, r, d, max(size) AS top, count(*) FILTER (WHERE size >= 4) AS n, sum(size) AS total FROM sz GROUP BY ALL),
    ok AS (SELECT *, bool_or(top > 0.9 * total) OVER (PARTITION BY unit ORDER BY r) AS late FROM ct),
    th AS (SELECT unit, coalesce(arg_min(d, (-n, r)) FILTER (WHERE NOT late), 0) AS tau, coalesce(max(n) FILTER (WHERE NOT late), 0) AS n_components FROM ok GROUP BY unit)"""


@query("GRA02_minimum_forest", f"WITH {BOTTLENECKS} SELECT unit, src, dst, round(d, 6) AS d FROM fo")
def gra02(spark, d):
    return forest8(spark, d).withColumn("d", F.round("d", 6))


def forest8(spark, d):
    """The forest of deflated edges, from points: no edge outside of it is ever a row."""
    return C.near_forest(crowded(spark, d), 8.0, lambda d, one, others: d * np.square(one[1] / np.minimum(one[0], others[0])), ["rho", "top"])


@query("GRA03_merge_threshold", f"WITH {MERGES} SELECT unit, round(tau, 6) AS tau, CAST(n_components AS INTEGER) AS n_components FROM th")
def gra03(spark, d):
    return G.merge_threshold(forest8(spark, d)).withColumn("tau", F.round("tau", 6))


@query("GRA04_ball_partition", f"WITH {MERGES} SELECT p.unit, p.i, least(p.i, coalesce(min(bt.j), p.i)) AS root FROM pts p LEFT JOIN th ON th.unit = p.unit LEFT JOIN bt ON bt.unit = p.unit AND bt.i = p.i AND EXISTS (SELECT 1 FROM rk WHERE rk.unit = bt.unit AND rk.r = bt.r AND rk.d <= tau) GROUP BY p.unit, p.i")
def gra04(spark, d):
    from tessera.session import stored

    f = forest8(spark, d)
    f = stored(f.join(G.merge_threshold(f), "unit").filter("d <= tau"), "links")
    return G.connected(f.select("unit", F.col("src").alias("a"), F.col("dst").alias("b")), pts(spark, d).select("unit", "i"))


@query("GRA05_local_spectra")
def gra05(spark, d):
    """Spectrum and cycles of each point's lining: its 48 nearest within 10."""
    return E.lining_spectra(pts(spark, d))


@query("GRA06_density_gradient", f"""WITH {PTS}, {COUNT8}, q AS (SELECT a.unit, a.i, b.px - a.px AS x, b.py - a.py AS y, b.pz - a.pz AS z, nb.n - na.n AS r FROM pts a JOIN pts b ON a.unit = b.unit AND a.i <> b.i AND {D2} <= 100 JOIN n na ON na.unit = a.unit AND na.i = a.i JOIN n nb ON nb.unit = b.unit AND nb.i = b.i),
    s AS (SELECT unit, i, sum(x * x) + 1 AS a, sum(x * y) AS b, sum(x * z) AS c, sum(y * y) + 1 AS e, sum(y * z) AS f, sum(z * z) + 1 AS g, sum(x * r) AS u, sum(y * r) AS v, sum(z * r) AS w FROM q GROUP BY ALL),
    t AS (SELECT *, a * (e * g - f * f) - b * (b * g - f * c) + c * (b * f - e * c) AS det FROM s) SELECT unit, i, round((u * (e * g - f * f) - b * (v * g - f * w) + c * (v * f - e * w)) / det, 6) AS gx FROM t""")
def gra06(spark, d):
    """Ridge least-squares gradient of the neighbour count: nine sums and Cramer's rule."""
    p = pts(spark, d).join(_counts(pts(spark, d), 8.0), ["unit", "i"])
    names = ["x", "y", "z", "m", "xx", "xy", "xz", "yy", "yz", "zz", "xm", "ym", "zm"]

    def moments(a, b):
        middle = {c: t.mean() if len(t) else 0.0 for c, t in a.items()}
        x, y, z, m = (b[c] - middle[c] for c in (*S.XYZ, "n"))
        values = np.column_stack([np.ones(len(x)), x, y, z, m, x * x, x * y, x * z, y * y, y * z, z * z, x * m, y * m, z * m])

        def of(at, d2, near):
            t = near.astype(float) @ values
            o = dict(zip("xyzm", (a[c][at] - middle[c] for c in (*S.XYZ, "n")), strict=True))
            one = dict(zip("xyzm", t[:, 1:5].T, strict=True))
            n = t[:, 0]
            second = [t[:, k] - o[p] * one[q] - o[q] * one[p] + n * o[p] * o[q] for k, (p, q) in enumerate(names[4:], 5)]
            return np.column_stack([*(one[c] - n * o[c] for c in "xyzm"), *second])

        return of

    t = S.near_sums(p, 10.0, names, moments, ["n"])
    s = t.select("unit", "i", (F.col("xx") + 1).alias("a"), F.col("xy").alias("b"), F.col("xz").alias("c"), (F.col("yy") + 1).alias("e"), F.col("yz").alias("f"), (F.col("zz") + 1).alias("g"), F.col("xm").alias("u"), F.col("ym").alias("v"), F.col("zm").alias("w"))
    a, b, c, e_, f, g, u, v, w = map(F.col, "abcefguvw")
    det = a * (e_ * g - f * f) - b * (b * g - f * c) + c * (b * f - e_ * c)
    return s.select("unit", "i", F.round((u * (e_ * g - f * f) - b * (v * g - f * w) + c * (v * f - e_ * w)) / det, 6).alias("gx"))


@query("GRA07_shape_descriptors")
def gra07(spark, d):
    return local_shapes(pts(spark, d), (8.0, 12.0, 16.0))


LG = f"{PTS}, {edge_sql(10)}, lg AS (SELECT unit, src AS i, dst - src AS k FROM e)"


@query("GRA08_lag_profile", f"WITH {LG} SELECT unit, i, round(avg(abs(k)), 8) AS mean, max(abs(k)) AS far, round(avg(CAST(abs(k) > 100 AS DOUBLE)), 8) AS far_share, round(avg(CAST(abs(k) <= 30 AS DOUBLE)), 8) AS near_share, round(avg(cos(2 * pi() * k / 36)), 7) AS wave FROM lg GROUP BY ALL")
def gra08(spark, d):
    k = F.col("dst") - F.col("src")
    share = lambda c: F.round(F.avg(c.cast("double")), 8)
    e = S.edges(pts(spark, d), 10.0)
    return e.groupBy("unit", F.col("src").alias("i")).agg(F.round(F.avg(F.abs(k)), 8).alias("mean"), F.max(F.abs(k)).alias("far"), share(F.abs(k) > 100).alias("far_share"), share(F.abs(k) <= 30).alias("near_share"), F.round(F.avg(F.cos(2 * F.pi() * k / 36)), 7).alias("wave"))


@query("GRA09_quadric_fit")
def gra09(spark, d):
    return local_shapes(pts(spark, d), (14.0,)).select("unit", "i", "gauss14", "mean14")


@query("GRA10_linkage_levels", f"WITH {BOTTLENECKS}, lv AS (SELECT unnest([4.0::DOUBLE, 8, 16, 32]) AS level) SELECT p.unit, p.i, level, 1 + count(DISTINCT bt.j) FILTER (WHERE rk.d <= level AND bt.j <> p.i) AS size FROM pts p CROSS JOIN lv LEFT JOIN bt ON bt.unit = p.unit AND bt.i = p.i LEFT JOIN rk ON rk.unit = bt.unit AND rk.r = bt.r GROUP BY p.unit, p.i, level")
def gra10(spark, d):
    """Sizes of single-linkage balls at four levels, from the forest's edges below each level."""
    from tessera.session import stored

    level = F.explode(F.array(*[F.lit(k) for k in (4.0, 8.0, 16.0, 32.0)])).alias("level")
    # a unit at a level is a graph of its own
    of = lambda t, *columns: t.select(F.struct("unit", "level").alias("unit"), *columns)
    links = stored(forest8(spark, d).select("src", "dst", "d", "unit", level).filter("d <= level"), "links")
    c = G.connected(of(links, F.col("src").alias("a"), F.col("dst").alias("b")), of(pts(spark, d).select("i", "unit", level), "i"))
    return c.join(c.groupBy("unit", "root").agg(F.count(F.lit(1)).alias("size")), ["unit", "root"]).select("unit.unit", "i", "unit.level", "size")


@query("GRA11_elastic_summary")
def gra11(spark, d):
    m = L.elastic_modes(pts(spark, d), 4, 14.0)
    u = Window.partitionBy("unit")
    return m.select("unit", "i", "share", "thermal", F.rank().over(u.orderBy(F.desc("thermal"))).alias("hinge_rank"))


@query("GRA12_elastic_network", f"WITH {PTS}, {edge_sql(12)} SELECT unit, src AS i, round(sum(1 / (d * d)), 7) AS stiffness, count(*) AS degree FROM e WHERE d > 0 GROUP BY ALL")
def gra12(spark, d):
    return S.edges(pts(spark, d), 12.0).filter("d > 0").groupBy("unit", F.col("src").alias("i")).agg(F.round(F.sum(1 / (F.col("d") * F.col("d"))), 7).alias("stiffness"), F.count(F.lit(1)).alias("degree"))


@query("GRA13_soft_modes")
def gra13(spark, d):
    return L.elastic_modes(pts(spark, d), 6, 14.0)


@query("GRA14_mode_amplitudes", f"WITH {EV} SELECT unit, i, round(x * 1.5 * sqrt(2.0 / (2.0 + k)), 8) AS moved FROM ev")
def gra14(spark, d):
    """Each value moved by the amplitude of its mode."""
    return ev(spark, d).select("unit", "i", F.round(F.col("x") * 1.5 * F.sqrt(2.0 / (2.0 + F.col("k"))), 8).alias("moved"))


@query("GRA15_rigid_projection")
def gra15(spark, d):
    """Residual after the best rigid motion between a point set and itself moved along a shear."""
    p = pts(spark, d)
    pairs = p.select("unit", "i", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("pz").alias("az"), (F.col("px") + 0.1 * F.col("py")).alias("bx"), F.col("py").alias("by"), F.col("pz").alias("bz"))
    return L.pair_rmsd(pairs)


VOX = "vx AS (SELECT DISTINCT unit, CAST(floor(px / 3) AS BIGINT) + dx AS x, CAST(floor(py / 3) AS BIGINT) + dy AS y, CAST(floor(pz / 3) AS BIGINT) + dz AS z FROM pts, range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz))"


def occupied(p, scale=1.0):
    """Voxels that some point's stencil of 27 covers."""
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    v = p.select("unit", *[F.floor(F.col(c) * scale / 3).cast("long").alias(c) for c in S.XYZ])
    for c in S.XYZ:
        v = v.withColumn("_s", F.explode(step)).withColumn(c, F.col(c) + F.col("_s")).drop("_s")
    return v.distinct().select("unit", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))


@query("GRA18_occupied_voxels", f"WITH {PTS}, {VOX} SELECT unit, x, y, z FROM vx")
def gra18(spark, d):
    return occupied(pts(spark, d))


def _free_union(spark, d, scales):
    """Voxels of the unit's occupied box that some scaled state leaves free, by a left anti join per state."""
    p = pts(spark, d)
    base = occupied(p)
    return base, reduce(lambda a, b: a.union(b), [base.join(occupied(p, s), ["unit", "x", "y", "z"], "left_anti") for s in scales]).distinct()


FREE = f"{VOX}, v2 AS (SELECT DISTINCT unit, CAST(floor(px * 1.25 / 3) AS BIGINT) + dx AS x, CAST(floor(py * 1.25 / 3) AS BIGINT) + dy AS y, CAST(floor(pz * 1.25 / 3) AS BIGINT) + dz AS z FROM pts, range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz)), v3 AS (SELECT DISTINCT unit, CAST(floor(px * 1.5 / 3) AS BIGINT) + dx AS x, CAST(floor(py * 1.5 / 3) AS BIGINT) + dy AS y, CAST(floor(pz * 1.5 / 3) AS BIGINT) + dz AS z FROM pts, range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz))"


@query("GRA16_free_union", f"WITH {PTS}, {FREE} SELECT unit, count(*) AS n FROM ((SELECT * FROM vx EXCEPT SELECT * FROM v2) UNION (SELECT * FROM vx EXCEPT SELECT * FROM v3)) GROUP BY unit")
def gra16(spark, d):
    return _free_union(spark, d, (1.25, 1.5))[1].groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query("GRA17_radial_union", f"WITH {PTS}, {FREE} SELECT unit, x, y, z FROM (SELECT * FROM vx EXCEPT SELECT * FROM v2)")
def gra17(spark, d):
    return _free_union(spark, d, (1.25,))[1]


DIRS = "dr AS (SELECT k, sin(acos(1 - 2 * (k + 0.5) / 30)) * cos(pi() * (1 + sqrt(5)) * (k + 0.5)) AS x, sin(acos(1 - 2 * (k + 0.5) / 30)) * sin(pi() * (1 + sqrt(5)) * (k + 0.5)) AS y, 1 - 2 * (k + 0.5) / 30 AS z FROM range(30) t(k))"


@query("GRA19_buriedness", f"""WITH {PTS}, {DIRS}, al AS (SELECT a.unit, a.i, k, (b.px - a.px) * x + (b.py - a.py) * y + (b.pz - a.pz) * z AS along, {D2} AS d2 FROM pts a JOIN pts b ON a.unit = b.unit AND a.i <> b.i, dr),
    h AS (SELECT unit, i, count(DISTINCT k) AS n FROM al WHERE along > 0 AND along <= 11 AND d2 - along * along <= 3.24 GROUP BY ALL) SELECT p.unit, p.i, coalesce(n, 0) / 30.0::DOUBLE AS buried FROM pts p LEFT JOIN h ON p.unit = h.unit AND p.i = h.i""")
def gra19(spark, d):
    return D.buriedness(pts(spark, d))


@query("GRA20_free_and_enclosed", f"WITH {PTS}, g AS (SELECT unit, i, px + 4 AS px, py AS py, pz AS pz FROM pts), m AS (SELECT a.unit, a.i, count(*) AS n, min({D2}) AS d2 FROM g a JOIN pts b ON a.unit = b.unit AND {D2} <= 100 GROUP BY a.unit, a.i) SELECT unit, i FROM m WHERE d2 > 4 AND n >= 14")
def gra20(spark, d):
    p = pts(spark, d)
    j = S.radius_join(p.withColumn("px", F.col("px") + 4), p, 10.0)
    return j.groupBy("unit", F.col("a_i").alias("i")).agg(F.count(F.lit(1)).alias("n"), F.min("d2").alias("d2")).filter("d2 > 4 and n >= 14").select("unit", "i")


@query("GRA21_complete_linkage")
def gra21(spark, d):
    return G.linked_branches(pts(spark, d), 12.0)


def deformed(n, isochoric=False):
    """bd: the score of each point over the fields of the operator of that name."""
    rows = ", ".join("(" + ", ".join([str(k), *(f"{float(v)!r}::DOUBLE" for v in g.ravel())]) + ")" for k, g in enumerate(D.deformations(n, isochoric)))
    move = [f"o{j} + (o0 * g{3 * j} + o1 * g{3 * j + 1} + o2 * g{3 * j + 2})" for j in range(3)]
    return f"""gf AS (SELECT * FROM (VALUES {rows}) t(k, g0, g1, g2, g3, g4, g5, g6, g7, g8)), of AS (SELECT a.unit, a.i, b.px - a.px AS o0, b.py - a.py AS o1, b.pz - a.pz AS o2 FROM pts a JOIN pts b ON a.unit = b.unit),
    mo AS (SELECT unit, i, k, {move[0]} AS m0, {move[1]} AS m1, {move[2]} AS m2 FROM of, gf), cn AS (SELECT unit, i, k, count(*) AS m FROM mo WHERE m0 * m0 + m1 * m1 + m2 * m2 <= 64 GROUP BY ALL),
    bd AS (SELECT c.unit, c.i, round(max(m) / any_value(s.n)::DOUBLE * ln(1.0::DOUBLE + max(m)), 9) AS score FROM cn c JOIN (SELECT unit, count(*) AS n FROM pts GROUP BY unit) s ON c.unit = s.unit GROUP BY c.unit, c.i)"""


@query("GRA22_isochoric", f"WITH {PTS}, {deformed(8, True)} SELECT unit, i, score FROM bd")
def gra22(spark, d):
    return D.best_deformation(pts(spark, d), 8, isochoric=True).withColumn("score", F.round("score", 9))


@query("GRA23_peel_depth")
def gra23(spark, d):
    return L.peel_depth(pts(spark, d))


@query("GRA24_hull_points", f"WITH {PTS}, c AS (SELECT unit, i, sqrt((px - avg(px) OVER u) ** 2 + (py - avg(py) OVER u) ** 2 + (pz - avg(pz) OVER u) ** 2) AS r FROM pts WINDOW u AS (PARTITION BY unit)) SELECT unit, i, r >= quantile_cont(r, 0.85) OVER (PARTITION BY unit) AS outer_ FROM c")
def gra24(spark, d):
    return L.hull_fallback(pts(spark, d)).withColumnRenamed("outer", "outer_")


#: Planes through three points that leave all others on one side.
FACETS = """tr AS (SELECT unit, (uy * vz - uz * vy) AS nx, (uz * vx - ux * vz) AS ny, (ux * vy - uy * vx) AS nz, ax, ay, az, ai, bi, ci
           FROM (SELECT a.unit, a.i AS ai, b.i AS bi, c.i AS ci, a.px AS ax, a.py AS ay, a.pz AS az, b.px - a.px AS ux, b.py - a.py AS uy, b.pz - a.pz AS uz, c.px - a.px AS vx, c.py - a.py AS vy, c.pz - a.pz AS vz
                 FROM pts a JOIN pts b ON a.unit = b.unit AND a.i < b.i JOIN pts c ON c.unit = a.unit AND c.i > b.i)),
    fa AS MATERIALIZED (SELECT tr.unit, ai, bi, ci, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz, any_value(ax) AS ax, any_value(ay) AS ay, any_value(az) AS az FROM tr JOIN pts p ON p.unit = tr.unit
           GROUP BY tr.unit, ai, bi, ci HAVING min((px - ax) * nx + (py - ay) * ny + (pz - az) * nz) > -1e-9 OR max((px - ax) * nx + (py - ay) * ny + (pz - az) * nz) < 1e-9)"""


@query("GRA24b_hull_corners", f"WITH {PTS}, {FACETS} SELECT DISTINCT unit, unnest([ai, bi, ci]) AS i FROM fa")
def gra24b(spark, d):
    return H.hull_corners(pts(spark, d)).select("unit", "i")


@query("GRA24c_hull_depth", f"WITH {PTS}, {FACETS} SELECT p.unit, p.i, round(min(abs((px - ax) * nx + (py - ay) * ny + (pz - az) * nz) / sqrt(nx * nx + ny * ny + nz * nz)), 6) + 0 AS depth FROM pts p JOIN fa ON fa.unit = p.unit GROUP BY p.unit, p.i")
def gra24c(spark, d):
    p = pts(spark, d)
    return H.hull_depth(p, H.hull_planes(H.hull_corners(p))).select("unit", "i", F.abs(F.round("depth", 6)).alias("depth"))


def _components_sql(r):
    return f"""WITH RECURSIVE {PTS}, f AS (SELECT * FROM pts WHERE v > 0), {edge_sql(r).replace('pts a JOIN pts b', 'f a JOIN f b')},
    w AS (SELECT unit, i, i AS root FROM f UNION SELECT e.unit, e.dst, w.root FROM w JOIN e ON e.unit = w.unit AND e.src = w.i),
    m AS (SELECT unit, i, min(root) AS root FROM w GROUP BY ALL) SELECT unit, root, count(*) AS size FROM m GROUP BY ALL"""


@query("GRA25_flagged_components", _components_sql(6))
def gra25(spark, d):
    p = pts(spark, d).filter("v > 0")
    c = G.near_components(p, 6.0)
    return c.groupBy("unit", "root").agg(F.count(F.lit(1)).alias("size"))


@query("GRA26_hops", f"""WITH RECURSIVE {PTS}, {edge_sql(8)}, h AS (SELECT DISTINCT unit, src AS source, src AS i, 0 AS hop FROM e UNION SELECT e.unit, h.source, e.dst, hop + 1 FROM h JOIN e ON e.unit = h.unit AND e.src = h.i WHERE hop < 6),
    m AS (SELECT unit, source, i, min(hop) AS hop FROM h GROUP BY ALL) SELECT unit, source AS i, round(avg(hop) FILTER (WHERE hop > 0), 9) AS mean_path, max(hop) AS eccentricity FROM m GROUP BY ALL""")
def gra26(spark, d):
    """Mean and largest number of hops to the nodes within six hops."""
    return C.hops(pts(spark, d), 8.0, 6).withColumn("mean_path", F.round("mean_path", 9))


@query("GRA26b_local_energy", f"WITH {PTS}, {edge_sql(8)} SELECT unit, src AS i, 2 * count(*) AS energy FROM e GROUP BY ALL")
def gra26b(spark, d):
    """The eigenvalues of a node's star Laplacian sum to twice its edges."""
    return edge8(spark, d).groupBy("unit", F.col("src").alias("i")).agg((2 * F.count(F.lit(1))).alias("energy"))


@query("GRA27_hops_to_rim", f"""WITH RECURSIVE {PTS}, {edge_sql(8)}, dg AS (SELECT unit, src AS i, count(*) AS n FROM e GROUP BY ALL), h AS (SELECT unit, i, 0 AS hop FROM dg WHERE n <= 5 UNION SELECT e.unit, e.dst, hop + 1 FROM h JOIN e ON e.unit = h.unit AND e.src = h.i WHERE hop < 6) SELECT unit, i, min(hop) AS hop FROM h GROUP BY ALL""")
def gra27(spark, d):
    """Hops to the nearest sparse node, up to six, level by level."""
    from tessera.session import stored

    e = stored(edge8(spark, d).select("unit", "src", "dst"), "edges")
    seen = stored(e.groupBy("unit", F.col("src").alias("i")).agg(F.count(F.lit(1)).alias("n")).filter("n <= 5").select("unit", "i", F.lit(0).alias("hop")), "hops")
    for k in range(1, 7):
        front = seen.filter(F.col("hop") == k - 1).select("unit", F.col("i").alias("src"))
        new = e.join(front, ["unit", "src"]).select("unit", F.col("dst").alias("i")).distinct().join(seen, ["unit", "i"], "left_anti")
        seen = stored(seen.unionByName(new.select("unit", "i", F.lit(k).alias("hop"))), "hops")
    return seen


@query("GRA28_global_spectrum")
def gra28(spark, d):
    return G.point_spectra(pts(spark, d), 10.0)


@query("GRA29_node_invariants")
def gra29(spark, d):
    return C.node_invariants(pts(spark, d), 8.0)


@query("GRA29b_graph_invariants")
def gra29b(spark, d):
    return C.whole_invariants(pts(spark, d), 8.0)


@query("GRA29c_triangles", f"WITH {PTS}, {edge_sql(8)} SELECT a.unit, a.src AS i, count(*) // 2 AS triangles FROM e a JOIN e b ON a.unit = b.unit AND a.dst = b.src JOIN e c ON c.unit = a.unit AND c.src = b.dst AND c.dst = a.src GROUP BY ALL")
def gra29c(spark, d):
    """Common neighbours along each edge, counted in strips."""
    return C.triangles(pts(spark, d), 8.0)


#: Members of each point's lining (itself included), and who touches whom among them.
LINING = """nb AS (SELECT a.unit, a.i AS c, b.i, row_number() OVER (PARTITION BY a.unit, a.i ORDER BY sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2), b.i) AS r FROM pts a JOIN pts b ON a.unit = b.unit AND a.i <> b.i AND (a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2 <= 100),
    mb AS (SELECT unit, c, i FROM nb WHERE r <= 48 UNION ALL SELECT DISTINCT unit, c, c FROM nb), mp AS (SELECT mb.unit, mb.c, mb.i, px, py, pz FROM mb JOIN pts ON mb.unit = pts.unit AND mb.i = pts.i),
    ad AS MATERIALIZED (SELECT a.unit, a.c, a.i AS x, b.i AS y FROM mp a JOIN mp b ON a.unit = b.unit AND a.c = b.c AND a.i <> b.i AND (a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2 <= 49),
    t1 AS (SELECT a.unit, a.c, count(*) // 2 AS v FROM ad a JOIN ad b ON a.unit = b.unit AND a.c = b.c AND a.y = b.x JOIN ad z ON z.unit = a.unit AND z.c = a.c AND z.x = b.y AND z.y = a.c WHERE a.x = a.c GROUP BY ALL),
    pa AS (SELECT a.unit, a.c, b.y AS far, count(*) AS n FROM ad a JOIN ad b ON a.unit = b.unit AND a.c = b.c AND a.y = b.x WHERE a.x = a.c AND b.y <> a.c GROUP BY ALL),
    fa AS (SELECT * FROM pa WHERE NOT EXISTS (SELECT 1 FROM ad WHERE ad.unit = pa.unit AND ad.c = pa.c AND ad.x = pa.c AND ad.y = pa.far)),
    t2 AS (SELECT unit, c, sum(n * (n - 1) // 2) AS v, count(*) AS two FROM fa GROUP BY ALL),
    wa AS MATERIALIZED (SELECT * FROM ad WHERE x <> c AND y <> c),
    t3 AS (SELECT a.unit, a.c, count(*) // 6 AS v FROM wa a JOIN wa b ON a.unit = b.unit AND a.c = b.c AND a.y = b.x JOIN wa z ON z.unit = a.unit AND z.c = a.c AND z.x = b.y AND z.y = a.x GROUP BY ALL),
    t4 AS (SELECT unit, c, count(*) AS v FROM (SELECT unit, c, x FROM wa GROUP BY ALL HAVING count(*) = 1) GROUP BY ALL),
    t5 AS (SELECT a.unit, a.c, count(*) AS v FROM ad a JOIN ad b ON a.unit = b.unit AND a.c = b.c AND a.y = b.x AND b.y <> a.c JOIN wa z ON z.unit = a.unit AND z.c = a.c AND z.x = b.y AND z.y <> a.y
           WHERE a.x = a.c AND NOT EXISTS (SELECT 1 FROM ad q WHERE q.unit = a.unit AND q.c = a.c AND q.x = a.c AND q.y IN (b.y, z.y)) AND NOT EXISTS (SELECT 1 FROM ad q WHERE q.unit = a.unit AND q.c = a.c AND q.x = a.y AND q.y = z.y) GROUP BY ALL)"""


@query("GRA29e_lining_counts", f"""WITH {PTS}, {LINING} SELECT m.unit, m.c AS i, coalesce(t1.v, 0) AS tri_centre, CAST(coalesce(t2.v, 0) AS BIGINT) AS c4_centre, coalesce(t5.v, 0) AS p4_centre, coalesce(t2.two, 0) AS expansion, coalesce(t3.v, 0) AS tri_wall, coalesce(t4.v, 0) AS leaves_wall
    FROM (SELECT DISTINCT unit, c FROM nb) m LEFT JOIN t1 USING (unit, c) LEFT JOIN t2 USING (unit, c) LEFT JOIN t3 USING (unit, c) LEFT JOIN t4 USING (unit, c) LEFT JOIN t5 USING (unit, c)""")
def gra29e(spark, d):
    """Counts of each point's lining: its 48 nearest within 10, touching at 7."""
    return E.lining_counts(E.linings(pts(spark, d)))


@query("GRA29d_lining_invariants")
def gra29d(spark, d):
    """Fifteen invariants of each point's lining."""
    return E.lining_invariants(pts(spark, d))


@query("GRA30_superposition")
def gra30(spark, d):
    p = pts(spark, d)
    pairs = p.select("unit", "i", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("pz").alias("az"), (-F.col("py")).alias("bx"), F.col("px").alias("by"), (F.col("pz") + 5).alias("bz"))
    return L.pair_rmsd(pairs)


@query("GRA31_pocket_frame")
def gra31(spark, d):
    p = pts(spark, d).filter("v > 0")
    pairs = p.select("unit", "i", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("pz").alias("az"), F.col("px").alias("bx"), F.col("py").alias("by"), (F.col("pz") * 1.1).alias("bz"))
    return L.pair_rmsd(pairs)


AXES = "ax AS (SELECT (CASE c WHEN 0 THEN 0 WHEN 1 THEN a ELSE b END) / s AS x, (CASE c WHEN 0 THEN a WHEN 1 THEN b ELSE 0 END) / s AS y, (CASE c WHEN 0 THEN b WHEN 1 THEN 0 ELSE a END) / s AS z, 4 * c + CAST(a > 0 AS INTEGER) * 2 + CAST(b > 0 AS INTEGER) AS k FROM (SELECT a, g * h AS b, sqrt(1 + g * g) AS s FROM (SELECT (1 + sqrt(5)) / 2 AS g), (VALUES (-1.0::DOUBLE), (1.0)) u(a), (VALUES (-1.0::DOUBLE), (1.0)) w(h)), range(3) t(c))"


@query("GRA32_free_runs", f"""WITH {PTS}, {AXES}, al AS (SELECT a.unit, a.i, k, (b.px - a.px) * x + (b.py - a.py) * y + (b.pz - a.pz) * z AS along, {D2} AS d2 FROM pts a JOIN pts b ON a.unit = b.unit AND a.i <> b.i, ax),
    f AS (SELECT unit, i, k, least(coalesce(min(CASE WHEN along > 0 AND d2 - along * along <= 4 THEN along END), 12), 12) AS far FROM al GROUP BY ALL) SELECT unit, i, round(max(far), 7) AS longest, round(avg(far), 7) AS mean FROM f GROUP BY ALL""")
def gra32(spark, d):
    return D.free_runs(pts(spark, d)).select("unit", "i", F.round("longest", 7).alias("longest"), F.round("mean", 7).alias("mean"))


#: Spheres through four points, by Cramer's rule, that hold no fifth one.
SPHERES = """qu AS (SELECT a.unit, a.i AS a, b.i AS b, c.i AS c, d.i AS d, a.px AS ox, a.py AS oy, a.pz AS oz, b.px - a.px AS bx, b.py - a.py AS by_, b.pz - a.pz AS bz, c.px - a.px AS cx, c.py - a.py AS cy, c.pz - a.pz AS cz, d.px - a.px AS dx, d.py - a.py AS dy, d.pz - a.pz AS dz
           FROM pts a JOIN pts b ON a.unit = b.unit AND a.i < b.i JOIN pts c ON c.unit = a.unit AND c.i > b.i JOIN pts d ON d.unit = a.unit AND d.i > c.i),
    de AS (SELECT *, 2 * (bx * (cy * dz - cz * dy) - by_ * (cx * dz - cz * dx) + bz * (cx * dy - cy * dx)) AS v, bx * bx + by_ * by_ + bz * bz AS bb, cx * cx + cy * cy + cz * cz AS cc, dx * dx + dy * dy + dz * dz AS dd FROM qu),
    ce AS (SELECT unit, a, b, c, d, ox, oy, oz, (bb * (cy * dz - cz * dy) + cc * (dy * bz - dz * by_) + dd * (by_ * cz - bz * cy)) / v AS x, (bb * (cz * dx - cx * dz) + cc * (dz * bx - dx * bz) + dd * (bz * cx - bx * cz)) / v AS y, (bb * (cx * dy - cy * dx) + cc * (dx * by_ - dy * bx) + dd * (bx * cy - by_ * cx)) / v AS z FROM de WHERE v <> 0),
    sp AS (SELECT unit, a, b, c, d, ox + x AS cx, oy + y AS cy, oz + z AS cz, sqrt(x * x + y * y + z * z) AS radius FROM ce),
    em AS (SELECT * FROM sp WHERE radius BETWEEN 3 AND 12 AND NOT EXISTS (SELECT 1 FROM pts p WHERE p.unit = sp.unit AND p.i NOT IN (a, b, c, d) AND (px - cx) ** 2 + (py - cy) ** 2 + (pz - cz) ** 2 < radius * radius))"""


@query("GRA33_void_spheres", f"WITH {PTS}, {SPHERES} SELECT unit, a, b, c, d, round(cx, 6) + 0 AS cx, round(cy, 6) + 0 AS cy, round(cz, 6) + 0 AS cz, round(radius, 6) AS radius FROM em")
def gra33(spark, d):
    """Empty spheres through four points, with radii of 3 to 12."""
    return L.void_spheres(pts(spark, d), 3.0, 12.0).select("unit", "a", "b", "c", "d", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "radius")])


@query("GRA34_triangular_field_solve")
def gra34(spark, d):
    """y = T x over the field of four for lower triangular Toeplitz T of each customer nation's digits, and x solved back."""
    from tessera.functions.field import solve_rows

    n = table(spark, d, "nation")
    return solve_rows(n.select(F.col("n_nationkey").alias("unit"), F.transform(F.split("n_name", ""), lambda c: F.ascii(c) % 4).alias("x")))


# ---- feature families: columns assembled by joins on (unit, i) ----


@query("FEA01_surface_family")
def fea01(spark, d):
    p = pts(spark, d)
    return _counts(p, 8.0).join(D.buriedness(p), ["unit", "i"]).join(G.point_spectra(p, 7.0, 4), ["unit", "i"]).join(L.peel_depth(p), ["unit", "i"])


@query("FEA02_short_family")
def fea02(spark, d):
    return fea01(spark, d).select("unit", "i", "n", "buried", "discord", "depth")


LOCAL = "lo AS (SELECT p.unit, p.i, v, n, (p.i % 20) AS code FROM pts p JOIN n USING (unit, i))"


@query("FEA03_local_quantities", f"WITH {PTS}, {COUNT8}, {LOCAL} SELECT unit, i, round(v, 8) AS v, n, code, round((code - 9.5) / 10, 8) AS hydropathy FROM lo")
def fea03(spark, d):
    return local(spark, d).select("unit", "i", F.round("v", 8).alias("v"), "n", "code", F.round((F.col("code") - 9.5) / 10, 8).alias("hydropathy"))


def local(spark, d):
    p = pts(spark, d)
    return p.join(_counts(p, 8.0), ["unit", "i"]).withColumn("code", F.col("i") % 20)


@query("FEA04_with_contexts", f"WITH {PTS} SELECT a.unit, a.i, round(any_value(a.v), 8) AS v, {', '.join(f'round(avg(b.v) FILTER (WHERE {D2} <= {r * r}), 7) AS v{r}' for r in (6, 14, 20))} FROM pts a JOIN pts b ON a.unit = b.unit AND {D2} <= 400 GROUP BY a.unit, a.i")
def fea04(spark, d):
    p = pts(spark, d)
    m = S.neighbourhood_means(p, [6.0, 14.0, 20.0], ["v"])
    return p.join(m, ["unit", "i"]).select("unit", "i", F.round("v", 8).alias("v"), *[F.round(f"v_mean{r}", 7).alias(f"v{r}") for r in (6, 14, 20)])


@query("FEA05_hydropathy", f"WITH {PTS} SELECT a.unit, a.i, round((a.i % 20 - 9.5) / 10, 8) AS own, round(avg((b.i % 20 - 9.5) / 10), 8) + 0 AS near FROM pts a JOIN pts b ON a.unit = b.unit AND {D2} <= 100 GROUP BY a.unit, a.i")
def fea05(spark, d):
    p = pts(spark, d).withColumn("h", (F.col("i") % 20 - 9.5) / 10)
    return p.join(S.neighbourhood_means(p, [10.0], ["h"]), ["unit", "i"]).select("unit", "i", F.round("h", 8).alias("own"), (F.round("h_mean10", 8) + 0.0).alias("near"))


@query("FEA06_backbone_columns", f"WITH {NB}, {TORSION}, r AS (SELECT unit, i, round(c, 7) AS c, round(s, 7) AS s FROM to_) SELECT unit, i, c, s, lag(c) OVER w AS c_before, lead(s) OVER w AS s_after FROM r WINDOW w AS (PARTITION BY unit ORDER BY i)")
def fea06(spark, d):
    t = torsions(spark, d).select("unit", "i", F.round("c", 7).alias("c"), F.round("s", 7).alias("s"))
    w = Window.partitionBy("unit").orderBy("i")
    return t.select("unit", "i", "c", "s", F.lag("c").over(w).alias("c_before"), F.lead("s").over(w).alias("s_after"))


@query("FEA07_side_columns", f"WITH {PTS} SELECT unit, i, CAST(floor(px / 10) AS INTEGER) AS well, round(sqrt(px * px + py * py + pz * pz), 7) AS reach FROM pts")
def fea07(spark, d):
    return pts(spark, d).select("unit", "i", F.floor(F.col("px") / 10).cast("int").alias("well"), F.round(F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2), 7).alias("reach"))


@query("FEA08_void_columns", f"WITH {PTS}, {SPHERES}, co AS (SELECT unit, radius, unnest([a, b, c, d]) AS i FROM em) SELECT unit, i, count(*) AS n_spheres, round(max(radius), 6) AS largest, round(min(radius), 6) AS smallest, round(median(radius), 6) AS middle, round(avg(radius), 6) AS mean, count(*) FILTER (WHERE radius < 4) AS n_tight, count(*) FILTER (WHERE radius > 8) AS n_open FROM co GROUP BY ALL")
def fea08(spark, d):
    """The empty spheres that each point holds up: how many, and how wide."""
    v = L.void_spheres(pts(spark, d), 3.0, 12.0)
    corner = v.select("unit", "radius", F.explode(F.array("a", "b", "c", "d")).alias("i"))
    return corner.groupBy("unit", "i").agg(F.count(F.lit(1)).alias("n_spheres"), F.round(F.max("radius"), 6).alias("largest"), F.round(F.min("radius"), 6).alias("smallest"), F.round(F.median("radius"), 6).alias("middle"), F.round(F.avg("radius"), 6).alias("mean"), F.count_if(F.col("radius") < 4).alias("n_tight"), F.count_if(F.col("radius") > 8).alias("n_open"))


@query("FEA08b_void_family")
def fea08b(spark, d):
    """All columns of voids for owners of three points each, in the order of a unit's points; every other point is a side point."""
    at = F.row_number().over(Window.partitionBy("unit").orderBy("i")) - 1
    p = pts(spark, d).withColumn("owner", F.floor(at / 3)).withColumn("side", F.col("i") % 2 == 1)
    return V.void_columns(p, 3.0, 12.0, tight=4.0, wide=8.0)


@query("FEA09_displacement_columns", f"WITH {EV} SELECT unit, i, round(coalesce((x - avg(x) OVER u) / nullif(stddev_pop(x) OVER u, 0), 0), 7) AS z, (rank() OVER (PARTITION BY unit ORDER BY x) - 1 + (count(*) OVER (PARTITION BY unit, x) - 1) / 2.0::DOUBLE) / greatest(count(*) OVER u - 1, 1) AS r FROM ev WINDOW u AS (PARTITION BY unit)")
def fea09(spark, d):
    return ev(spark, d).select("unit", "i", F.round(W.z_score("x"), 7).alias("z"), W.normal_rank("x").alias("r"))


@query("FEA10_seam_columns")
def fea10(spark, d):
    apart = lambda a, b: lambda at, d2, near: np.count_nonzero(near & (np.abs(b["i"][None] - a["i"][at, None]) > 100), axis=1)[:, None]
    far = S.near_sums(pts(spark, d), 10.0, ["far"], apart).select("unit", "i", F.col("far").cast("long").alias("far"))
    return far.join(G.point_spectra(pts(spark, d), 10.0), ["unit", "i"]).join(L.peel_depth(pts(spark, d)), ["unit", "i"])


@query("FEA11_wall_columns")
def fea11(spark, d):
    return local_shapes(pts(spark, d), (10.0,)).join(agg_wall(spark, d), ["unit", "i"])


def agg_wall(spark, d):
    p = pts(spark, d)

    def sums(a, b):
        return lambda at, d2, near: np.where(near, np.sqrt(d2), 0.0).sum(1)[:, None]

    def nearest(a, b):
        def of(at, d2, near):
            d = np.where(near, np.sqrt(d2), np.inf)
            least = d.min(1, keepdims=True, initial=np.inf)
            return np.isfinite(least), least

        return of

    mean = S.near_sums(p, 10.0, ["total"], sums).select("unit", "i", (F.col("total") / F.col("n")).alias("mean_d"))
    least = S.near_lists(p, 10.0, nearest).select("unit", "i", F.get("values", F.lit(0)).alias("nearest"))
    return least.join(mean, ["unit", "i"]).join(S.near_quantile(p, 10.0, 0.9).select("unit", "i", F.col("q").alias("p90")), ["unit", "i"])


@query("FEA12_aperture_columns", f"""WITH {PTS}, {AXES}, al AS (SELECT a.unit, a.i, k, (b.px - a.px) * x + (b.py - a.py) * y + (b.pz - a.pz) * z AS along, {D2} AS d2 FROM pts a JOIN pts b ON a.unit = b.unit AND a.i <> b.i, ax),
    f AS (SELECT unit, i, k, least(coalesce(min(CASE WHEN along > 0 AND d2 - along * along <= 4 THEN along END), 12), 12) AS far FROM al GROUP BY ALL), fr AS (SELECT unit, i, round(max(far), 7) AS longest, round(avg(far), 7) AS mean FROM f GROUP BY ALL),
    c AS (SELECT unit, i, sqrt((px - avg(px) OVER u) ** 2 + (py - avg(py) OVER u) ** 2 + (pz - avg(pz) OVER u) ** 2) AS r FROM pts WINDOW u AS (PARTITION BY unit)), {FACETS},
    de AS (SELECT p.unit, p.i, round(min(abs((px - ax) * nx + (py - ay) * ny + (pz - az) * nz) / sqrt(nx * nx + ny * ny + nz * nz)), 6) + 0 AS depth FROM pts p JOIN fa ON fa.unit = p.unit GROUP BY p.unit, p.i)
    SELECT fr.unit, fr.i, longest, mean, r >= quantile_cont(r, 0.85) OVER (PARTITION BY fr.unit) AS outer_, depth FROM fr JOIN c USING (unit, i) JOIN de USING (unit, i)""")
def fea12(spark, d):
    """Free runs from each point, whether it is one of the outer ones, and how deep it lies below the hull."""
    outer = L.hull_fallback(pts(spark, d)).withColumnRenamed("outer", "outer_")
    return gra32(spark, d).join(outer, ["unit", "i"]).join(gra24c(spark, d), ["unit", "i"])


@query("FEA13_gate_columns", f"WITH {EV}, b AS (SELECT unit, i, k % 3 = 0 AS f FROM ev), g AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY i) - row_number() OVER (PARTITION BY unit, f ORDER BY i) AS g FROM b) SELECT unit, i, CASE WHEN f THEN count(*) OVER (PARTITION BY unit, f, g) ELSE 0 END AS run, sum(CAST(f AS INTEGER)) OVER (PARTITION BY unit ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)::BIGINT AS near FROM g")
def fea13(spark, d):
    r = W.runs(ev(spark, d).withColumn("f", F.col("k") % 3 == 0).withColumn("f1", F.col("f").cast("int")), "f")
    return r.select("unit", "i", F.col("run_length").cast("long").alias("run"), W.centred(F.sum, "f1", 4).alias("near"))


@query("FEA14_lattice_contacts", f"WITH {PTS}, sh AS (SELECT dx * 25.0::DOUBLE AS dx FROM range(-1, 2) t(dx) WHERE dx <> 0), im AS (SELECT unit, i, px + dx AS px, py, pz FROM pts, sh) SELECT a.unit, a.i, count(*) AS n FROM pts a JOIN im b ON a.unit = b.unit AND {D2} <= 225 GROUP BY a.unit, a.i")
def fea14(spark, d):
    """Contacts with images shifted by the cell; the shifts are a fixed array."""
    p = pts(spark, d)
    images = p.withColumn("dx", F.explode(F.array(F.lit(-25.0), F.lit(25.0)))).withColumn("px", F.col("px") + F.col("dx")).drop("dx")
    return S.radius_join(p, images, 15.0).groupBy("unit", F.col("a_i").alias("i")).agg(F.count(F.lit(1)).alias("n"))


@query("FEA15_probe_columns", f"WITH {PTS}, g AS (SELECT unit, i, px, py, pz + 3 AS pz FROM pts) SELECT a.unit, a.i, count(*) FILTER (WHERE b.i % 3 = 0) AS donors, count(*) FILTER (WHERE b.i % 3 = 1) AS acceptors FROM g a JOIN pts b ON a.unit = b.unit AND {D2} <= 36 GROUP BY a.unit, a.i")
def fea15(spark, d):
    p = pts(spark, d)
    j = S.radius_join(p.withColumn("pz", F.col("pz") + 3), p, 6.0)
    return j.groupBy("unit", F.col("a_i").alias("i")).agg(F.count_if(F.col("b_i") % 3 == 0).alias("donors"), F.count_if(F.col("b_i") % 3 == 1).alias("acceptors"))


@query("FEA16_spectral_columns")
def fea16(spark, d):
    return G.point_spectra(pts(spark, d), 10.0, 12)


@query("FEA17_operator_columns")
def fea17(spark, d):
    return local_shapes(pts(spark, d), (8.0, 12.0, 16.0)).join(G.point_spectra(pts(spark, d), 10.0), ["unit", "i"])


@query("FEA18_chain_operator_columns")
def fea18(spark, d):
    m = L.elastic_modes(pts(spark, d), 6, 14.0)
    clean = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)).alias(c)
    return m.select("unit", "i", clean("share"), clean("thermal"))


@query("FEA19_geometry_columns", f"WITH {PTS}, {COUNT8}, {edge_sql(8)}, o AS (SELECT unit, src AS i, sum(t_v) AS contact FROM e GROUP BY ALL) SELECT n.unit, n.i, n.n, round(contact, 6) AS contact FROM n JOIN o USING (unit, i)")
def fea19(spark, d):
    p = pts(spark, d)
    c = S.edges(p, 8.0, ["v"]).groupBy("unit", F.col("src").alias("i")).agg(F.round(F.sum("t_v"), 6).alias("contact"))
    return _counts(p, 8.0).join(c, ["unit", "i"])


@query("FEA20_aligned_seams", f"WITH {PTS}, {edge_sql(8)}, o AS (SELECT unit, src AS i, any_value(s_v) AS own, sum(t_v) AS contact FROM e GROUP BY ALL) SELECT p.unit, p.i, round(coalesce(own, p.v), 6) AS own, round(coalesce(contact, 0), 6) AS contact FROM pts p LEFT JOIN o USING (unit, i)")
def fea20(spark, d):
    p = pts(spark, d)
    c = S.edges(p, 8.0, ["v"]).groupBy("unit", F.col("src").alias("i")).agg(F.sum("t_v").alias("contact"))
    return p.join(c, ["unit", "i"], "left").select("unit", "i", F.round("v", 6).alias("own"), F.round(F.coalesce("contact", F.lit(0.0)), 6).alias("contact"))


@query("FEA21_composition", f"WITH {PTS}, {edge_sql(8)} SELECT unit, src AS i, {', '.join(f'count(*) FILTER (WHERE dst % 4 = {c}) AS c{c}' for c in range(4))} FROM e GROUP BY ALL")
def fea21(spark, d):
    return edge8(spark, d).groupBy("unit", F.col("src").alias("i")).agg(*[F.count_if(F.col("dst") % 4 == c).alias(f"c{c}") for c in range(4)])


@query("FEA22_property_walks", f"WITH {PTS}, {edge_sql(8)} SELECT unit, src AS i, CAST(sum(dst % 20) AS BIGINT) AS contact FROM e GROUP BY ALL")
def fea22(spark, d):
    return edge8(spark, d).groupBy("unit", F.col("src").alias("i")).agg(F.sum(F.col("dst") % 20).alias("contact"))


@query("FEA23_graph_columns")
def fea23(spark, d):
    return gra29d(spark, d)


@query("FEA24_sequence_geometry", f"WITH {PTS} SELECT unit, i, {', '.join(f'round(coalesce(sqrt((lead(px, {k}) OVER w - px) ** 2 + (lead(py, {k}) OVER w - py) ** 2 + (lead(pz, {k}) OVER w - pz) ** 2), 0), 7) AS d{k}' for k in (1, 2, 4))} FROM pts WINDOW w AS (PARTITION BY unit ORDER BY i)")
def fea24(spark, d):
    w = Window.partitionBy("unit").orderBy("i")
    far = lambda k: F.sqrt(sum((F.pow(F.lead(c, k).over(w) - F.col(c), F.lit(2.0)) for c in S.XYZ), F.lit(0.0)))
    return pts(spark, d).select("unit", "i", *[F.round(F.coalesce(far(k), F.lit(0.0)), 7).alias(f"d{k}") for k in (1, 2, 4)])


@query("FEA25_asymmetry", f"WITH {PTS} SELECT a.unit, a.i, round(coalesce(avg(b.v) FILTER (WHERE b.i > a.i), 0) - coalesce(avg(b.v) FILTER (WHERE b.i < a.i), 0), 7) AS skew FROM pts a JOIN pts b ON a.unit = b.unit AND a.i <> b.i AND {D2} <= 100 GROUP BY a.unit, a.i")
def fea25(spark, d):
    e = S.edges(pts(spark, d), 10.0, ["v"])
    side = lambda c: F.coalesce(F.avg(F.when(c, F.col("t_v"))), F.lit(0.0))
    return e.groupBy("unit", F.col("src").alias("i")).agg(F.round(side(F.col("dst") > F.col("src")) - side(F.col("dst") < F.col("src")), 7).alias("skew"))


@query("FEA26_permuted_control", f"WITH {EV}, a AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY i) AS place FROM ev), b AS (SELECT unit, x AS px, row_number() OVER (PARTITION BY unit ORDER BY (i * 1103515245 + 12345) % 2147483648, i) AS place FROM ev) SELECT a.unit, a.i, b.px AS x FROM a JOIN b ON a.unit = b.unit AND a.place = b.place")
def fea26(spark, d):
    from tessera.operators.bootstrap import permuted

    return permuted(ev(spark, d), "x").select("unit", "i", "x")
