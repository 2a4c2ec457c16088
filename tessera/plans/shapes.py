"""Queries on scalar functions: vectors, angles, codes, words of digits, intervals, tokens (SCA)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import tables as T
from tessera.plans.bindings import EV, ORD, PTS, ev, orders, pts
from tessera.plans.registry import query
from tessera.session import table

P = ("px", "py", "pz")
NB = f"""{PTS}, nb AS (SELECT unit, i, px, py, pz, v, lead(px, 1) OVER w AS bx, lead(py, 1) OVER w AS by_, lead(pz, 1) OVER w AS bz, lead(px, 2) OVER w AS cx, lead(py, 2) OVER w AS cy, lead(pz, 2) OVER w AS cz, lead(px, 3) OVER w AS dx, lead(py, 3) OVER w AS dy, lead(pz, 3) OVER w AS dz FROM pts WINDOW w AS (PARTITION BY unit ORDER BY i)), q AS (SELECT * FROM nb WHERE dx IS NOT NULL)"""
BOND = "bx - px AS u1, by_ - py AS u2, bz - pz AS u3, cx - bx AS v1, cy - by_ AS v2, cz - bz AS v3, dx - cx AS w1, dy - cy AS w2, dz - cz AS w3"
NORMALS = "u2 * v3 - u3 * v2 AS n1, u3 * v1 - u1 * v3 AS n2, u1 * v2 - u2 * v1 AS n3, v2 * w3 - v3 * w2 AS m1, v3 * w1 - v1 * w3 AS m2, v1 * w2 - v2 * w1 AS m3"
TORSION = f"""bo AS (SELECT unit, i, {BOND} FROM q), no AS (SELECT *, {NORMALS} FROM bo), si AS (SELECT *, nullif(sqrt(n1 * n1 + n2 * n2 + n3 * n3) * sqrt(m1 * m1 + m2 * m2 + m3 * m3), 0) AS sz, nullif(sqrt(v1 * v1 + v2 * v2 + v3 * v3), 0) AS vz FROM no),
    to_ AS (SELECT unit, i, (n1 * m1 + n2 * m2 + n3 * m3) / sz AS c, ((n2 * m3 - n3 * m2) * v1 + (n3 * m1 - n1 * m3) * v2 + (n1 * m2 - n2 * m1) * v3) / vz / sz AS s FROM si)"""


def quads(spark, d):
    """Each point with the three that follow it."""
    w = Window.partitionBy("unit").orderBy("i")
    q = pts(spark, d).select("unit", "i", "v", *P, *[F.lead(c, k).over(w).alias(f"{n}{c[1]}") for k, n in ((1, "b"), (2, "c"), (3, "d")) for c in P])
    return q.filter("dx is not null")


def of(n):
    return [f"{n}x", f"{n}y", f"{n}z"]


def torsions(spark, d):
    c, s = G.dihedral(P, of("b"), of("c"), of("d"))
    return quads(spark, d).select("unit", "i", c.alias("c"), s.alias("s"))


@query("SCA01_distance", f"WITH {NB} SELECT unit, i, round(sqrt((px - bx) ** 2 + (py - by_) ** 2 + (pz - bz) ** 2), 9) AS d FROM q")
def sca01(spark, d):
    return quads(spark, d).select("unit", "i", F.round(G.distance(P, of("b")), 9).alias("d"))


@query("SCA02_closest_of_set", f"WITH {NB} SELECT unit, i, round(least(sqrt((px - bx) ** 2 + (py - by_) ** 2 + (pz - bz) ** 2), sqrt((px - cx) ** 2 + (py - cy) ** 2 + (pz - cz) ** 2), sqrt((px - dx) ** 2 + (py - dy) ** 2 + (pz - dz) ** 2)), 9) AS dca FROM q")
def sca02(spark, d):
    ligand = F.array(*[F.array(*[F.col(c) for c in of(n)]) for n in "bcd"])
    far = F.transform(ligand, lambda p: G.distance(P, [F.get(p, F.lit(k)) for k in range(3)]))
    return quads(spark, d).select("unit", "i", F.round(F.array_min(far), 9).alias("dca"))


@query("SCA03_centre_distance", f"WITH {NB} SELECT unit, i, round(sqrt(((px + bx) / 2 - (cx + dx) / 2) ** 2 + ((py + by_) / 2 - (cy + dy) / 2) ** 2 + ((pz + bz) / 2 - (cz + dz) / 2) ** 2), 9) AS dcc FROM q")
def sca03(spark, d):
    mid = lambda a, b: G.times(G.plus(a, b), 0.5)
    return quads(spark, d).select("unit", "i", F.round(G.distance(mid(P, of("b")), mid(of("c"), of("d"))), 9).alias("dcc"))


@query("SCA04_dihedral", f"WITH {NB}, {TORSION} SELECT unit, i, round(c, 7) AS c, round(s, 7) AS s FROM to_")
def sca04(spark, d):
    return torsions(spark, d).select("unit", "i", F.round("c", 7).alias("c"), F.round("s", 7).alias("s"))


# Coefficients that place a virtual side-chain atom from three backbone atoms.
BETA = (-0.58273431, 0.56802827, -0.54067466)


@query("SCA05_virtual_atom", f"WITH {NB}, bo AS (SELECT unit, i, bx, bx - px AS u1, by_ - py AS u2, bz - pz AS u3, cx - bx AS v1, cy - by_ AS v2, cz - bz AS v3 FROM q) SELECT unit, i, round({BETA[0]}::DOUBLE * (u2 * v3 - u3 * v2) + {BETA[1]}::DOUBLE * u1 + {BETA[2]}::DOUBLE * v1 + bx, 7) AS x FROM bo")
def sca05(spark, d):
    u, v = G.minus(of("b"), P), G.minus(of("c"), of("b"))
    p = G.plus(G.plus(G.plus(G.times(G.cross(u, v), BETA[0]), G.times(u, BETA[1])), G.times(v, BETA[2])), of("b"))
    return quads(spark, d).select("unit", "i", F.round(p[0], 7).alias("x"))


@query("SCA06_link", f"WITH {NB} SELECT unit, i, isfinite(px) AND sqrt((px - bx) ** 2 + (py - by_) ** 2 + (pz - bz) ** 2) <= 8.0 AS linked FROM q")
def sca06(spark, d):
    dist = G.distance(P, of("b"))
    return quads(spark, d).select("unit", "i", (~F.isnan(dist) & (dist <= 8.0)).alias("linked"))


DEG = "degrees(atan2(s, c))"


@query("SCA07_angle_cell", f"WITH {NB}, {TORSION}, a AS (SELECT unit, i, {DEG} AS phi, lead({DEG}) OVER (PARTITION BY unit ORDER BY i) AS psi FROM to_) SELECT unit, i, CASE WHEN phi IS NULL OR psi IS NULL THEN 0 WHEN phi BETWEEN -160 AND -20 AND psi BETWEEN -120 AND 50 THEN 1 WHEN phi BETWEEN -180 AND -40 AND psi > 50 THEN 2 WHEN phi > 20 AND psi BETWEEN -60 AND 120 THEN 3 ELSE 0 END AS cell FROM a")
def sca07(spark, d):
    a = torsions(spark, d).withColumn("phi", F.degrees(F.atan2("s", "c"))).withColumn("psi", F.lead("phi").over(Window.partitionBy("unit").orderBy("i")))
    phi, psi = F.col("phi"), F.col("psi")
    cell = F.when(phi.isNull() | psi.isNull(), 0).when(phi.between(-160, -20) & psi.between(-120, 50), 1).when(phi.between(-180, -40) & (psi > 50), 2).when((phi > 20) & psi.between(-60, 120), 3).otherwise(0)
    return a.select("unit", "i", cell.alias("cell"))


@query("SCA08_rotamer_well", f"WITH {NB}, {TORSION}, a AS (SELECT unit, i, (({DEG}) % 360 + 360) % 360 AS chi FROM to_) SELECT unit, i, CAST(1 + floor(chi / 120) AS INTEGER) AS well, round(abs(chi - (60 + 120 * floor(chi / 120))), 6) AS off FROM a")
def sca08(spark, d):
    chi = F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0))
    a = torsions(spark, d).select("unit", "i", chi.alias("chi")).withColumn("w", F.floor(F.col("chi") / 120))
    return a.select("unit", "i", (1 + F.col("w")).cast("int").alias("well"), F.round(F.abs(F.col("chi") - (60 + 120 * F.col("w"))), 6).alias("off"))


SPH = f"""sq AS (SELECT unit, i, bx - px AS a1, by_ - py AS a2, bz - pz AS a3, cx - px AS b1, cy - py AS b2, cz - pz AS b3, dx - px AS c1, dy - py AS c2, dz - pz AS c3 FROM q),
    sr AS (SELECT *, nullif(2 * (a1 * (b2 * c3 - b3 * c2) + a2 * (b3 * c1 - b1 * c3) + a3 * (b1 * c2 - b2 * c1)), 0) AS vol, a1 * a1 + a2 * a2 + a3 * a3 AS aa, b1 * b1 + b2 * b2 + b3 * b3 AS bb, c1 * c1 + c2 * c2 + c3 * c3 AS cc FROM sq),
    st AS (SELECT unit, i, ((b2 * c3 - b3 * c2) * aa + (c2 * a3 - c3 * a2) * bb + (a2 * b3 - a3 * b2) * cc) / vol AS o1, ((b3 * c1 - b1 * c3) * aa + (c3 * a1 - c1 * a3) * bb + (a3 * b1 - a1 * b3) * cc) / vol AS o2, ((b1 * c2 - b2 * c1) * aa + (c1 * a2 - c2 * a1) * bb + (a1 * b2 - a2 * b1) * cc) / vol AS o3 FROM sr)"""


@query("SCA09_circumsphere", f"WITH {NB}, {SPH} SELECT unit, i, round(sqrt(o1 * o1 + o2 * o2 + o3 * o3), 4) AS radius FROM st WHERE sqrt(o1 * o1 + o2 * o2 + o3 * o3) < 50")
def sca09(spark, d):
    r = G.tetrahedron_sphere(P, of("b"), of("c"), of("d"))[1]
    return quads(spark, d).withColumn("r", r).filter("r < 50").select("unit", "i", F.round("r", 4).alias("radius"))


@query("SCA10_exact_band")
def sca10(spark, d):
    """Whether a circumradius lies in 3..40, decided in integers of a thousandth."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                a, p, q, s = ([round(1000 * r[c]) for c in names] for names in (P, of("b"), of("c"), of("d")))
                u, v, w = ([x - y for x, y in zip(m, a, strict=True)] for m in (p, q, s))
                cross = lambda m, n: (m[1] * n[2] - m[2] * n[1], m[2] * n[0] - m[0] * n[2], m[0] * n[1] - m[1] * n[0])
                dot = lambda m, n: sum(x * y for x, y in zip(m, n, strict=True))
                vol = 2 * dot(u, cross(v, w))
                n = [dot(u, u) * x + dot(v, v) * y + dot(w, w) * z for x, y, z in zip(cross(v, w), cross(w, u), cross(u, v), strict=True)]
                rows.append(bool(vol) and (3000 * vol) ** 2 <= dot(n, n) <= (40000 * vol) ** 2)
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("i"), pa.array(rows, pa.bool_())], ["unit", "i", "in_band"])

    return quads(spark, d).mapInArrow(run, "unit int, i long, in_band boolean")


@query("SCA11_crystal_system", "SELECT p_partkey AS i, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'cubic' WHEN p_size % 3 = 0 THEN 'tetragonal' WHEN p_size % 2 = 0 THEN 'orthorhombic' WHEN p_size % 5 = 0 THEN 'hexagonal' WHEN p_size % 7 = 0 THEN 'monoclinic' ELSE 'triclinic' END AS system FROM part")
def sca11(spark, d):
    """Cells made from sizes: lengths and angles first, then the rule on them."""
    s = F.col("p_size")
    a = F.lit(10.0)
    cell = table(spark, d, "part").select(
        F.col("p_partkey").alias("i"),
        a.alias("a"),
        F.when((s % 3 == 0) | (s % 2 != 0) & (s % 5 == 0), a).otherwise(11.0).alias("b"),
        F.when((s % 3 == 0) & (s % 2 == 0), a).otherwise(12.0).alias("c"),
        F.when((s % 3 == 0) | (s % 2 == 0) | (s % 5 == 0) | (s % 7 == 0), 90.0).otherwise(80.0).alias("alpha"),
        F.when((s % 3 == 0) | (s % 2 == 0) | (s % 5 == 0), 90.0).when(s % 7 == 0, 100.0).otherwise(85.0).alias("beta"),
        F.when((s % 3 == 0) | (s % 2 == 0), 90.0).when(s % 5 == 0, 120.0).when(s % 7 == 0, 90.0).otherwise(95.0).alias("gamma"),
    )
    from tessera.functions.codes import crystal_system

    return cell.select("i", crystal_system().alias("system"))


@query("SCA12_rotation_order", "SELECT k AS trace, CASE k WHEN 3 THEN 1 WHEN -1 THEN 2 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 6 END AS rotation FROM (SELECT DISTINCT CAST(n_nationkey % 6 AS INTEGER) - 2 AS k FROM nation)")
def sca12(spark, d):
    from tessera.functions.codes import rotation_order

    k = table(spark, d, "nation").select((F.col("n_nationkey") % 6 - 2).cast("int").alias("trace")).distinct()
    return k.select("trace", rotation_order("trace").alias("rotation"))


@query("SCA13_tensor_invariants", f"WITH {NB}, t AS (SELECT unit, i, px * px + 1 AS a, py * py + 1 AS b, pz * pz + 1 AS c, px * py AS f, px * pz AS g, py * pz AS h FROM q) SELECT unit, i, round(a + b + c, 6) AS trace, round(a * b * c + 2 * f * g * h - a * h * h - b * g * g - c * f * f, 4) AS det, round((a * b * c + 2 * f * g * h - a * h * h - b * g * g - c * f * f) / ((a + b + c) / 3) ** 3, 8) AS ratio FROM t")
def sca13(spark, d):
    x, y, z = map(F.col, P)
    a, b, c, f, g, h = x * x + 1, y * y + 1, z * z + 1, x * y, x * z, y * z
    det = a * b * c + 2 * f * g * h - a * h * h - b * g * g - c * f * f
    return quads(spark, d).select("unit", "i", F.round(a + b + c, 6).alias("trace"), F.round(det, 4).alias("det"), F.round(det / F.pow((a + b + c) / 3, F.lit(3.0)), 8).alias("ratio"))


@query("SCA14_line_angle", f"WITH {NB} SELECT unit, i, round(coalesce(degrees(acos(least(1.0, abs(px * bx + py * by_ + pz * bz) / nullif(sqrt(px * px + py * py + pz * pz) * sqrt(bx * bx + by_ * by_ + bz * bz), 0)))), 90), 7) AS angle FROM q")
def sca14(spark, d):
    return quads(spark, d).select("unit", "i", F.round(G.undirected_angle(P, of("b")), 7).alias("angle"))


@query("SCA15_type_code", "SELECT n_nationkey AS i, coalesce(list_position(['ALGERIA', 'BRAZIL', 'CANADA', 'FRANCE'], n_name) - 1, -1) AS code FROM nation")
def sca15(spark, d):
    from tessera.functions.codes import code_of

    return table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), code_of("n_name", ["ALGERIA", "BRAZIL", "CANADA", "FRANCE"]).alias("code"))


@query("SCA16_propensity_or_mean", f"WITH {EV}, p AS (SELECT k, avg(y) AS w FROM ev WHERE k < 50 GROUP BY k) SELECT i, round(coalesce(w, (SELECT avg(w) FROM p)), 9) AS w FROM ev LEFT JOIN p ON ev.k = p.k")
def sca16(spark, d):
    e = ev(spark, d)
    p = e.filter("k < 50").groupBy("k").agg(F.avg("y").alias("w"))
    mean = p.agg(F.avg("w").alias("m"))
    return e.join(p, "k", "left").join(F.broadcast(mean), F.lit(True)).select("i", F.round(F.coalesce("w", "m"), 9).alias("w"))


@query("SCA17_constants_or_mean", "WITH s AS (SELECT s_nationkey, avg(s_acctbal) AS a, count(*)::DOUBLE AS n FROM supplier WHERE s_nationkey < 20 GROUP BY 1) SELECT n_nationkey AS i, round(coalesce(a, (SELECT avg(a) FROM s)), 6) AS a, round(coalesce(n, (SELECT avg(n) FROM s)), 6) AS n FROM nation LEFT JOIN s ON n_nationkey = s_nationkey")
def sca17(spark, d):
    s = table(spark, d, "supplier").filter("s_nationkey < 20").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    m = s.agg(F.avg("a").alias("ma"), F.avg("n").alias("mn"))
    n = table(spark, d, "nation")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").join(F.broadcast(m), F.lit(True)).select(F.col("n_nationkey").alias("i"), F.round(F.coalesce("a", "ma"), 6).alias("a"), F.round(F.coalesce("n", "mn"), 6).alias("n"))


@query("SCA18_total_dimension", "SELECT c_custkey AS i, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def sca18(spark, d):
    """A lookup in which a missing key is an error."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    name = F.coalesce(F.col("r_name"), F.raise_error(F.lit("a key has no row in the dimension")))
    return j.select(F.col("c_custkey").alias("i"), "n_name", name.alias("r_name"))


WORD = "[CAST(k % 4 AS INTEGER), CAST(k // 4 % 4 AS INTEGER), CAST(i % 4 AS INTEGER)]"


def words(spark, d):
    k, i = F.col("k"), F.col("i")
    return ev(spark, d).select("i", F.array((k % 4).cast("int"), (F.floor(k / 4) % 4).cast("int"), (i % 4).cast("int")).alias("w"))


@query("SCA19_packed_word", f"WITH {EV}, w AS (SELECT i, {WORD} AS w FROM ev) SELECT i, CAST(w[1] + 4 * w[2] + 16 * w[3] AS BIGINT) AS addr, array_to_string(w, ',') AS back FROM w")
def sca19(spark, d):
    a = words(spark, d).withColumn("addr", T.address(F.col("w")))
    return a.select("i", "addr", F.array_join(F.transform(T.unpacked(F.col("addr"), 3), lambda x: x.cast("string")), ",").alias("back"))


@query("SCA20_orbit_address", f"WITH {EV}, w AS (SELECT i, list_sort({WORD}) AS w FROM ev) SELECT i, CAST(w[1] * 16 + w[2] * 4 + w[3] AS BIGINT) AS orbit FROM w")
def sca20(spark, d):
    return words(spark, d).select("i", T.orbit_address(F.col("w"), 4).alias("orbit"))


@query("SCA21_orbit_count", f"WITH {EV} SELECT unit, i, k, CAST(round(exp(lgamma(k + 4) - lgamma(4) - lgamma(k + 1))) AS BIGINT) AS n FROM ev")
def sca21(spark, d):
    """C(k + L - 1, k) for L = 4, as a running product."""
    n = F.aggregate(F.sequence(F.lit(0), F.col("k")), F.lit(1.0), lambda a, x: F.when(x == 0, a).otherwise(a * (x + 3) / x))
    return ev(spark, d).select("unit", "i", "k", F.bround(n).cast("long").alias("n"))


@query("SCA22_band_index", f"WITH {EV} SELECT i, CAST(x >= 10 AS INTEGER) + CAST(x >= 25 AS INTEGER) + CAST(x >= 75 AS INTEGER) AS band FROM ev")
def sca22(spark, d):
    from tessera.functions.codes import band_of

    return ev(spark, d).select("i", band_of("x", (10.0, 25.0, 75.0)).alias("band"))


@query("SCA23_edge_address", f"WITH {EV} SELECT i, CAST((CAST(x >= 25 AS INTEGER) + CAST(x >= 50 AS INTEGER) + CAST(x >= 75 AS INTEGER)) + 4 * (CAST(k >= 25 AS INTEGER) + CAST(k >= 50 AS INTEGER) + CAST(k >= 75 AS INTEGER)) AS BIGINT) AS addr FROM ev")
def sca23(spark, d):
    from tessera.functions.codes import band_of

    e = (25.0, 50.0, 75.0)
    return ev(spark, d).select("i", T.address(F.array(band_of("x", e), band_of("k", e))).alias("addr"))


@query("SCA24_mcc_f1", "WITH c AS (SELECT l_suppkey AS unit, count(*) FILTER (WHERE l_quantity > 40 AND l_returnflag = 'R') AS tp, count(*) FILTER (WHERE l_quantity > 40 AND l_returnflag <> 'R') AS fp, count(*) FILTER (WHERE l_quantity <= 40 AND l_returnflag = 'R') AS fn, count(*) FILTER (WHERE l_quantity <= 40 AND l_returnflag <> 'R') AS tn FROM lineitem GROUP BY 1) SELECT unit, round((tp * tn - fp * fn)::DOUBLE / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 10) AS mcc, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 10) AS f1 FROM c")
def sca24(spark, d):
    from tessera.operators import ranking as R

    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), (F.col("l_quantity") > 40).alias("call"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    m = R.confusion(li, F.col("call"), "y", ["unit"])
    return m.select("unit", F.round(R.mcc(), 10).alias("mcc"), F.round(R.f1(), 10).alias("f1"))


@query("SCA25_percentile", f"WITH {ORD} SELECT unit, round(quantile_cont(x, 0.3), 6) AS p30 FROM od GROUP BY unit")
def sca25(spark, d):
    return orders(spark, d).groupBy("unit").agg(F.round(F.percentile("x", F.lit(0.3)), 6).alias("p30"))


@query("SCA26_wilson", f"WITH {EV}, c AS (SELECT unit, sum(y)::DOUBLE AS k, count(*)::DOUBLE AS n FROM ev GROUP BY unit) SELECT unit, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS low, round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS high FROM c")
def sca26(spark, d):
    from tessera.functions.codes import wilson

    c = ev(spark, d).groupBy("unit").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson("k", "n", 1.96)
    return c.select("unit", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("SCA27_token_parts", "SELECT p_partkey AS i, CAST(regexp_extract('A_' || p_partkey || 'B', '^([A-Za-z0-9]+)_(-?[0-9]+)([A-Z]?)$', 2) AS INTEGER) AS number, regexp_extract('A_' || p_partkey || 'B', '^([A-Za-z0-9]+)_(-?[0-9]+)([A-Z]?)$', 3) AS letter FROM part")
def sca27(spark, d):
    t = F.concat(F.lit("A_"), F.col("p_partkey").cast("string"), F.lit("B"))
    r = r"^([A-Za-z0-9]+)_(-?[0-9]+)([A-Z]?)$"
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.regexp_extract(t, r, 2).cast("int").alias("number"), F.regexp_extract(t, r, 3).alias("letter"))


@query("SCA28_redaction", "SELECT page_id, regexp_replace(regexp_replace('/home/user' || page_id || '/run took ' || page_id || '.5 s at ' || url, '/home/[^/ ]+', '~', 'g'), '[0-9]+\\.[0-9]+ s', '<time>', 'g') AS t FROM pages")
def sca28(spark, d):
    i = F.col("page_id").cast("string")
    t = F.concat(F.lit("/home/user"), i, F.lit("/run took "), i, F.lit(".5 s at "), F.col("url"))
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(t, "/home/[^/ ]+", "~"), r"[0-9]+\.[0-9]+ s", "<time>").alias("t"))


@query("SCA29_unit_key", "SELECT n_nationkey AS i, concat_ws('_', n_name, CASE WHEN n_regionkey = 0 THEN NULL ELSE CAST(n_regionkey AS VARCHAR) END) AS unit FROM nation")
def sca29(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.concat_ws("_", "n_name", F.when(F.col("n_regionkey") != 0, F.col("n_regionkey").cast("string"))).alias("unit"))


@query("SCA30_identifier", "SELECT page_id, rtrim(regexp_extract('JRNL DOI 10.' || (1000 + page_id) || '/abc.' || page_id || '. END', '(10\\.[0-9]{4,9}/[^ ]+)', 1), '.') AS doi FROM pages")
def sca30(spark, d):
    i = F.col("page_id")
    t = F.concat(F.lit("JRNL DOI 10."), (1000 + i).cast("string"), F.lit("/abc."), i.cast("string"), F.lit(". END"))
    return table(spark, d, "pages").select("page_id", F.rtrim(F.regexp_extract(t, r"(10\.[0-9]{4,9}/[^ ]+)", 1), F.lit(".")).alias("doi"))


@query("SCA31_field_of_four", f"WITH {EV}, v AS (SELECT unit, i, CAST(k % 4 AS BIGINT) AS a, CAST(i % 4 AS BIGINT) AS b FROM ev) SELECT unit, i, xor(a, b) AS total, [[0, 0, 0, 0], [0, 1, 2, 3], [0, 2, 3, 1], [0, 3, 1, 2]][a + 1][b + 1] AS product FROM v")
def sca31(spark, d):
    """Sum and product of two digits of each row."""
    from tessera.functions.codes import gf4_times

    v = ev(spark, d).select("unit", "i", (F.col("k") % 4).cast("long").alias("a"), (F.col("i") % 4).cast("long").alias("b"))
    return v.select("unit", "i", F.col("a").bitwiseXOR(F.col("b")).alias("total"), gf4_times("a", "b").alias("product"))


@query("SCA32_small_network")
def sca32(spark, d):
    from tessera.functions.network import forward

    return forward(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("SCA33_sphere_directions", f"WITH {PTS}, dr AS (SELECT CAST(k AS INTEGER) AS k, sin(acos(1 - 2 * (k + 0.5) / 30)) * cos(pi() * (1 + sqrt(5)) * (k + 0.5)) AS x, sin(acos(1 - 2 * (k + 0.5) / 30)) * sin(pi() * (1 + sqrt(5)) * (k + 0.5)) AS y, 1 - 2 * (k + 0.5) / 30 AS z FROM range(30) t(k)) SELECT unit, k, round(max(px * x + py * y + pz * z), 7) AS reach FROM pts, dr GROUP BY unit, k")
def sca33(spark, d):
    """How far each unit reaches along 30 directions spread over the sphere."""
    from tessera.functions.codes import sphere_directions

    ways = F.broadcast(sphere_directions(spark, 30))  # 30 rows
    along = F.col("px") * F.col("x") + F.col("py") * F.col("y") + F.col("pz") * F.col("z")
    return pts(spark, d).join(ways, F.lit(True)).groupBy("unit", "k").agg(F.round(F.max(along), 7).alias("reach"))


@query("SCA34_radial_dilation", f"WITH {PTS}, r AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS r FROM pts) SELECT unit, i, round(CASE WHEN r BETWEEN 3 AND 9 THEN px * 1.25 ELSE px END, 8) AS x FROM r")
def sca34(spark, d):
    r = G.norm(P)
    return pts(spark, d).select("unit", "i", F.round(F.when(r.between(3, 9), F.col("px") * 1.25).otherwise(F.col("px")), 8).alias("x"))


@query("SCA35_masked_rotation", f"WITH {PTS} SELECT unit, i, round(CASE WHEN i % 2 = 0 THEN px * cos(0.3) - py * sin(0.3) ELSE px END, 8) AS x, round(CASE WHEN i % 2 = 0 THEN px * sin(0.3) + py * cos(0.3) ELSE py END, 8) AS y FROM pts")
def sca35(spark, d):
    t = G.rotated(P, [F.lit(0.0), F.lit(0.0), F.lit(1.0)], 0.3)
    even = F.col("i") % 2 == 0
    return pts(spark, d).select("unit", "i", F.round(F.when(even, t[0]).otherwise(F.col("px")), 8).alias("x"), F.round(F.when(even, t[1]).otherwise(F.col("py")), 8).alias("y"))


@query("SCA36_after_date", "SELECT o_orderkey AS i FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-05-08'")
def sca36(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderdate").cast("date") > F.to_date(F.lit("1997-05-08"))).select(F.col("o_orderkey").alias("i"))


@query("SCA37_element_fallback", "SELECT p_partkey AS i, CASE WHEN p_size % 3 = 0 THEN upper(left(p_type, 1)) WHEN regexp_extract(p_brand, '([A-Z])', 1) <> '' THEN regexp_extract(p_brand, '([A-Z])', 1) ELSE 'C' END AS element FROM part")
def sca37(spark, d):
    name = F.regexp_extract("p_brand", "([A-Z])", 1)
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.when(F.col("p_size") % 3 == 0, F.upper(F.substring("p_type", 1, 1))).when(name != "", name).otherwise("C").alias("element"))


@query("SCA38_unit_sequence", f"WITH {EV} SELECT unit, string_agg(upper(left(event_type, 1)), '' ORDER BY i) AS seq FROM ev GROUP BY unit")
def sca38(spark, d):
    from tessera.functions.codes import sequence_of

    return ev(spark, d).groupBy("unit").agg(sequence_of("i", F.upper(F.substring("event_type", 1, 1))).alias("seq"))


@query("SCA39_mapped_sequence", f"WITH {EV}, f AS (SELECT unit, k, min(i) AS i, arg_min(CASE event_type WHEN 'error' THEN 'M' ELSE upper(left(event_type, 1)) END, i) AS c FROM ev GROUP BY ALL) SELECT unit, string_agg(c, '' ORDER BY i) AS seq FROM f GROUP BY unit")
def sca39(spark, d):
    from tessera.functions.codes import sequence_of

    c = F.when(F.col("event_type") == "error", "M").otherwise(F.upper(F.substring("event_type", 1, 1)))
    f = ev(spark, d).groupBy("unit", "k").agg(F.min("i").alias("i"), F.min_by(c, "i").alias("c"))
    return f.groupBy("unit").agg(sequence_of("i", F.col("c")).alias("seq"))
