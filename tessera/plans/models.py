"""Queries on count-table models and the detectors that chain them (MOD, DET)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import grid
from tessera.operators import ranking as R
from tessera.operators import spatial as S
from tessera.operators import tables as T
from tessera.operators import windows as W
from tessera.operators.ordered import quantiles
from tessera.plans.bindings import EV, PTS, ev, pts
from tessera.plans.graphs import deformed
from tessera.plans.registry import query
from tessera.plans.scored import AUC, F1
from tessera.plans.spatial import ADR, CELL, D2, DIG, TABLES, WIDE, addresses, digits, wide
from tessera.session import table

BASE = "(SELECT avg(y) FROM dg)"
SCORE = f"{ADR}, {CELL}, sc AS (SELECT ad.unit, ad.i, any_value(ad.y) AS y, sum(pos / tot::DOUBLE) AS x FROM ad JOIN ce USING (t, addr) GROUP BY ad.unit, ad.i)"
CALLED = "cl AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(x, 9) DESC, i) <= greatest(1, round_even(0.1::DOUBLE * count(*) OVER (PARTITION BY unit), 0)) AS called FROM sc)"


def scored(spark, d, weights=None):
    a = addresses(spark, d)
    w = F.get(F.array(*map(F.lit, weights)), F.col("t")) if weights else None
    return T.score_rows(a, T.cells(a), ["unit", "i", "y"], F.lit(0.0), w).withColumnRenamed("score", "x")


#: Parts and suppliers as wires, each in an order that a linear congruential function shuffles.
SHUFFLED = "wr AS (SELECT p_partkey AS w, row_number() OVER (ORDER BY (p_partkey * 1103515245 + 12345) % 2147483648, p_partkey) - 1 AS place FROM part), ws AS (SELECT s_suppkey AS w, row_number() OVER (ORDER BY (s_suppkey * 1103515245 + 12345) % 2147483648, s_suppkey) - 1 AS place FROM supplier)"


def shuffled(wires, key):
    """w and at, its place in the shuffled order: by ranges of that order, none of which is the whole table."""
    from tessera.operators.bootstrap import A, C, M
    from tessera.operators.ordered import running

    rows = wires.select(F.col(key).alias("w"), F.pmod(F.col(key) * A + C, F.lit(M)).alias("mix"), F.lit(1).cast("long").alias("one"))
    return running(rows, ["mix", "w"], {"one": "after"}).select("w", (F.col("after") - 1).alias("at"))


@query("MOD01_table_partition", f"WITH {SHUFFLED} SELECT place // 2 AS t, min(w) FILTER (WHERE place % 2 = 0) AS a, min(w) FILTER (WHERE place % 2 = 1) AS b FROM wr GROUP BY 1")
def mod01(spark, d):
    """A seeded partition of wires into pairs, as the dimension that table queries join; the last of an odd number stands alone."""
    side = lambda k: F.min(F.when(F.col("at") % 2 == k, F.col("w")))
    return shuffled(table(spark, d, "part"), "p_partkey").groupBy(F.expr("at div 2").alias("t")).agg(side(0).alias("a"), side(1).alias("b"))


@query("MOD02_cell_addresses", f"WITH {EV}, {ADR} SELECT unit, i, t, addr + 16 * t AS cell FROM ad")
def mod02(spark, d):
    return addresses(spark, d).select("unit", "i", "t", (F.col("addr") + 16 * F.col("t")).alias("cell"))


#: Integer weights of the ridge discriminant of three digits for each ridge of rg: pooled scatter by class, Cramer's rule, the peak at 32.
FAN_OUT = """cl AS (SELECT y, count(*) AS n, avg(d0) AS m0, avg(d1) AS m1, avg(d2) AS m2, covar_pop(d0, d0) * count(*) AS s00, covar_pop(d0, d1) * count(*) AS s01, covar_pop(d0, d2) * count(*) AS s02, covar_pop(d1, d1) * count(*) AS s11, covar_pop(d1, d2) * count(*) AS s12, covar_pop(d2, d2) * count(*) AS s22 FROM dg GROUP BY y),
    po AS (SELECT sum(s00) / sum(n) AS p, sum(s01) / sum(n) AS a, sum(s02) / sum(n) AS b, sum(s11) / sum(n) AS q, sum(s12) / sum(n) AS c, sum(s22) / sum(n) AS r, sum(CASE y WHEN 1 THEN m0 ELSE -m0 END) AS u, sum(CASE y WHEN 1 THEN m1 ELSE -m1 END) AS v, sum(CASE y WHEN 1 THEN m2 ELSE -m2 END) AS w FROM cl),
    ri AS (SELECT ridge, p + ridge * (p + q + r) / 3 AS p, a, b, q + ridge * (p + q + r) / 3 AS q, c, r + ridge * (p + q + r) / 3 AS r, u, v, w FROM po, rg),
    wt AS (SELECT ridge, [u * (q * r - c * c) - a * (v * r - c * w) + b * (v * c - q * w), p * (v * r - c * w) - u * (a * r - c * b) + b * (a * w - v * b), p * (q * w - v * c) - a * (a * w - v * b) + u * (a * c - q * b)] AS x, p * (q * r - c * c) - a * (a * r - c * b) + b * (a * c - q * b) AS det FROM ri),
    fo AS (SELECT ridge, CAST(k AS INTEGER) AS wire, CAST(round_even(32 * (x[k + 1] / det) / list_max(list_transform(x, lambda e: abs(e / det))), 0) AS INTEGER) AS multiplicity FROM wt, range(3) t(k))"""


@query("MOD03_integer_fan_out", f"WITH {EV}, {DIG}, rg AS (SELECT 0.1::DOUBLE AS ridge), {FAN_OUT} SELECT wire, multiplicity FROM fo")
def mod03(spark, d):
    w = T.fan_out(T.gram(digits(spark, d), ["d0", "d1", "d2"], "y"), 0.1)
    return spark.createDataFrame([(k, int(x)) for k, x in enumerate(w)], "wire int, multiplicity int")


@query("MOD04_table_score", f"WITH {EV}, {SCORE} SELECT unit, i, round(x, 9) AS score FROM sc")
def mod04(spark, d):
    return scored(spark, d).select("unit", "i", F.round("x", 9).alias("score"))


@query("MOD05_compiled_model", f"WITH {EV}, {ADR}, {CELL} SELECT t, count(*) AS n_cells, CAST(sum(tot) AS BIGINT) AS total, CAST(sum(pos) AS BIGINT) AS positive FROM ce GROUP BY t")
def mod05(spark, d):
    return T.cells(addresses(spark, d)).groupBy("t").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("tot").alias("total"), F.sum("pos").alias("positive"))


@query("MOD07_scored_call", f"WITH {EV}, {SCORE}, {CALLED} SELECT unit, i, called FROM cl")
def mod07(spark, d):
    return scored(spark, d).withColumn("x", F.round("x", 9)).select("unit", "i", R.top_share("x", 0.1).alias("called"))


THEME = "SELECT 0 AS w, d0 AS x, y FROM dg UNION ALL SELECT 1, d1, y FROM dg UNION ALL SELECT 2, d2, y FROM dg"
POOL = "pr AS (SELECT w, y, rank() OVER (PARTITION BY w ORDER BY x) + (count(*) OVER (PARTITION BY w, x) - 1) / 2.0::DOUBLE AS r FROM th), pa AS (SELECT w, (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc FROM pr GROUP BY w)"


def digit_aucs(spark, d):
    """Pooled AUC of each digit, from counts per level: nothing is ranked row by row."""
    levels = F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"d{w}").alias("x")) for w in range(3)])
    c = digits(spark, d).select("y", F.inline(levels)).groupBy("w", "x").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("w").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = c.withColumn("r", before + (F.col("n") + 1) / 2).groupBy("w").agg(F.sum(F.col("r") * F.col("p")).alias("s"), F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    return g.select("w", ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


@query("MOD08_ranked_multiplicity", f"WITH {EV}, {DIG}, th AS ({THEME}), {POOL} SELECT w, round(auc, 9) AS auc, row_number() OVER (ORDER BY round(abs(2 * auc - 1), 9), w) AS multiplicity FROM pa")
def mod08(spark, d):
    a = digit_aucs(spark, d)
    return a.select("w", F.round("auc", 9).alias("auc"), F.row_number().over(Window.orderBy(F.round(F.abs(2 * F.col("auc") - 1), 9), "w")).cast("long").alias("multiplicity"))


@query("MOD09_fused_score", f"WITH {EV}, {SCORE}, m AS (SELECT *, max(abs(x)) OVER (PARTITION BY unit) AS top FROM sc), k AS (SELECT unit, i, k FROM ev) SELECT m.unit, m.i, round(coalesce(x / nullif(top, 0), 0) + 0.5 * coalesce(k / nullif(max(abs(k)) OVER (PARTITION BY m.unit), 0)::DOUBLE, 0), 8) AS s FROM m JOIN k USING (unit, i)")
def mod09(spark, d):
    j = scored(spark, d).join(ev(spark, d).select("unit", "i", "k"), ["unit", "i"])
    return j.select("unit", "i", F.round(W.peak_scaled("x") + 0.5 * W.peak_scaled("k"), 8).alias("s"))


@query("MOD10_ordinal_auc", f"WITH {EV}, r AS (SELECT y, row_number() OVER (ORDER BY x, i) AS r FROM ev) SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 9) AS auc FROM r")
def mod10(spark, d):
    return R.pooled_auc(ev(spark, d), "x", "y", ties=False).select(F.round("auc", 9).alias("auc"))


#: Ridge coefficients of three standardised digits, by Cramer's rule.
RIDGE3 = """mo AS (SELECT corr(d0, d1) AS a, corr(d0, d2) AS b, corr(d1, d2) AS c, covar_pop(d0, y) / stddev_pop(d0) AS u, covar_pop(d1, y) / stddev_pop(d1) AS v, covar_pop(d2, y) / stddev_pop(d2) AS w, 1 + 1e-3::DOUBLE AS g FROM dg),
    dt AS (SELECT *, g * (g * g - c * c) - a * (a * g - c * b) + b * (a * c - g * b) AS det FROM mo),
    be AS (SELECT 'd0' AS wire, round((u * (g * g - c * c) - a * (v * g - c * w) + b * (v * c - g * w)) / det, 9) AS beta FROM dt UNION ALL
           SELECT 'd1', round((g * (v * g - c * w) - u * (a * g - c * b) + b * (a * w - v * b)) / det, 9) FROM dt UNION ALL
           SELECT 'd2', round((g * (g * w - v * c) - a * (a * w - v * b) + u * (a * c - g * b)) / det, 9) FROM dt)"""


@query("MOD11_ridge_regression", f"WITH {EV}, {DIG}, {RIDGE3} SELECT wire, beta FROM be")
def mod11(spark, d):
    """Closed form from the Gram of standardised digits."""
    cols = ["d0", "d1", "d2"]
    parts = T.gram(digits(spark, d), cols, "y")
    n = sum(p[0] for p in parts.values())
    mean = sum(p[0] * p[1] for p in parts.values()) / n
    s = sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts.values()) / n
    sd = np.sqrt(np.diag(s))
    cross = parts[1][0] / n * (parts[1][1] - mean) / sd
    beta = np.linalg.solve(s / np.outer(sd, sd) + 1e-3 * np.eye(3), cross)
    return spark.createDataFrame([(c, round(float(b), 9)) for c, b in zip(cols, beta, strict=True)], "wire string, beta double")


@query("MOD11b_wide_ridge")
def mod11b(spark, d):
    """Ridge regression of the class on 625 standardised columns, by conjugate gradients on stored blocks."""
    beta = _wide_beta(spark, d)
    return spark.createDataFrame([(k, float(b)) for k, b in enumerate(beta)], "k int, beta double")


def _wide_beta(spark, d):
    return B.wide_ridge(B.gram_blocks(wide(spark, d), WIDE), {0: 0.0, 1: 1.0}, 1.0)


@query("MOD12_nearest_cell_fill", f"""WITH {EV}, {DIG}, o AS (SELECT CAST(d0 + 4 * d1 + 16 * d2 AS BIGINT) AS addr, avg(y) AS frac FROM dg WHERE d0 <> d1 GROUP BY 1), a AS (SELECT addr FROM range(64) t(addr)),
    h AS (SELECT a.addr, o.addr AS src, frac, CAST(a.addr % 4 <> o.addr % 4 AS INTEGER) + CAST(a.addr // 4 % 4 <> o.addr // 4 % 4 AS INTEGER) + CAST(a.addr // 16 <> o.addr // 16 AS INTEGER) AS hd FROM a, o) SELECT addr, arg_min(src, (hd, src)) AS src, min(hd) AS distance, round(arg_min(frac, (hd, src)), 9) AS frac FROM h GROUP BY addr""")
def mod12(spark, d):
    """Every one of the 64 addresses gets the nearest cell with unlike digits (all of those are occupied, the others not); both sides are bounded by the address space."""
    w = F.col("d0") + 4 * F.col("d1") + 16 * F.col("d2")
    o = digits(spark, d).filter("d0 <> d1").groupBy(w.cast("long").alias("src")).agg(F.avg("y").alias("frac"))
    cells = o.agg(F.collect_list(F.struct("src", "frac")).alias("c"))  # at most 64
    a = spark.range(64).withColumnRenamed("id", "addr").join(F.broadcast(cells), F.lit(True)).select("addr", F.explode("c").alias("c")).select("addr", "c.*")
    at = lambda c, k: F.pmod(F.floor(F.col(c) / 4**k), F.lit(4))
    hd = sum(((at("addr", k) != at("src", k)).cast("int") for k in range(3)), F.lit(0))
    g = a.withColumn("hd", hd).groupBy("addr").agg(F.min(F.struct("hd", "src", "frac")).alias("b"))
    return g.select("addr", "b.src", F.col("b.hd").alias("distance"), F.round("b.frac", 9).alias("frac"))


@query("MOD13_quartile_edges", f"WITH {EV} SELECT round(quantile_cont(x, 0.25), 9) AS e1, round(quantile_cont(x, 0.5), 9) AS e2, round(quantile_cont(x, 0.75), 9) AS e3 FROM ev")
def mod13(spark, d):
    row = quantiles(ev(spark, d), "x", [0.25, 0.5, 0.75])
    # equal edges are pushed apart by one step of the float grid
    edges = reduce(lambda a, e: [*a, e if not a or e > a[-1] else float(np.nextafter(a[-1], np.inf))], row, [])
    return spark.createDataFrame([[round(e, 9) for e in edges]], "e1 double, e2 double, e3 double")


@query("MOD14_lookup_compile", f"WITH {EV}, {DIG} SELECT d0 AS digit, count(*) AS tot, CAST(sum(y) AS BIGINT) AS pos, round(avg(y), 9) AS frac FROM dg GROUP BY d0")
def mod14(spark, d):
    return digits(spark, d).groupBy(F.col("d0").alias("digit")).agg(F.count(F.lit(1)).alias("tot"), F.sum("y").alias("pos"), F.round(F.avg("y"), 9).alias("frac"))


FOLD = "fo AS (SELECT unit, CAST((dense_rank() OVER (ORDER BY unit % 23) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT unit FROM ev))"


def folds(spark, d):
    """Fold of each unit by the order of its cluster."""
    u = ev(spark, d).select("unit").distinct().withColumn("cluster", F.col("unit") % 23)
    c = u.select("cluster").distinct().withColumn("fold", ((F.row_number().over(Window.orderBy("cluster")) - 1) % 5).cast("int"))
    return u.join(c, "cluster").select("unit", "fold")


@query("MOD15_cluster_folds", f"WITH {EV}, {FOLD} SELECT unit, fold FROM fo")
def mod15(spark, d):
    return folds(spark, d)


OOF = f"{ADR}, {FOLD}, af AS (SELECT ad.*, fold FROM ad JOIN fo USING (unit)), tc AS (SELECT t, addr, count(*) AS n, sum(y) AS p FROM af GROUP BY ALL), fc AS (SELECT t, addr, fold, count(*) AS n, sum(y) AS p FROM af GROUP BY ALL), fr AS (SELECT f.t, f.addr, f.fold, tc.n - f.n AS tot, tc.p - f.p AS pos FROM fc f JOIN tc USING (t, addr))"


def out_of_fold(spark, d):
    """Counts of each cell without the own fold's rows: totals less the fold's part, one pass."""
    a = addresses(spark, d).join(folds(spark, d), "unit")
    by = a.groupBy("t", "addr", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    w = Window.partitionBy("t", "addr")  # at most one row per fold
    return a, by.select("t", "addr", "fold", (F.sum("n").over(w) - F.col("n")).alias("tot"), (F.sum("p").over(w) - F.col("p")).alias("pos"))


@query("MOD16_out_of_fold", f"WITH {EV}, {OOF} SELECT t, addr, fold, CAST(tot AS BIGINT) AS tot, CAST(pos AS BIGINT) AS pos FROM fr")
def mod16(spark, d):
    return out_of_fold(spark, d)[1]


@query("MOD17_equal_count_bands", f"WITH {EV} SELECT i, CAST(x > (SELECT quantile_cont(x, 0.25) FROM ev) AS INTEGER) + CAST(x > (SELECT quantile_cont(x, 0.5) FROM ev) AS INTEGER) + CAST(x > (SELECT quantile_cont(x, 0.75) FROM ev) AS INTEGER) AS band FROM ev")
def mod17(spark, d):
    e = ev(spark, d)
    return e.select("i", sum(((F.col("x") > edge).cast("int") for edge in quantiles(e, "x", [0.25, 0.5, 0.75])), F.lit(0)).alias("band"))


@query("MOD18_cells_or_base", f"WITH {EV}, {DIG}, dk AS (SELECT dg.*, k FROM dg JOIN ev USING (unit, i)), ce AS (SELECT k, d0, d1, d2, avg(y) AS f FROM dk WHERE unit % 5 <> 0 GROUP BY ALL), ba AS (SELECT avg(y) AS b FROM dk WHERE unit % 5 <> 0) SELECT dk.unit, dk.i, round(coalesce(f, b), 9) AS frac, f IS NOT NULL AS known FROM dk CROSS JOIN ba LEFT JOIN ce ON dk.k = ce.k AND dk.d0 = ce.d0 AND dk.d1 = ce.d1 AND dk.d2 = ce.d2")
def mod18(spark, d):
    """Cells from all folds but the first; rows whose cell no such fold has seen get the base rate."""
    g = digits(spark, d).join(ev(spark, d).select("unit", "i", "k"), ["unit", "i"])
    seen = g.filter("unit % 5 <> 0")
    ce, base = seen.groupBy("k", "d0", "d1", "d2").agg(F.avg("y").alias("f")), seen.agg(F.avg("y").alias("b"))
    return g.join(ce, ["k", "d0", "d1", "d2"], "left").join(F.broadcast(base), F.lit(True)).select("unit", "i", F.round(F.coalesce("f", "b"), 9).alias("frac"), F.col("f").isNotNull().alias("known"))


HALF = "hf AS (SELECT unit, unit % 23 AS cluster, (unit % 23 * 1103515245 + 12345) % 2147483648 % 2 AS half FROM (SELECT DISTINCT unit FROM ev))"


@query("MOD19_cluster_halves", f"WITH {EV}, {HALF} SELECT unit, CAST(half AS INTEGER) AS half, count(*) OVER (PARTITION BY cluster) = count(*) OVER (PARTITION BY cluster, half) AS whole FROM hf")
def mod19(spark, d):
    from tessera.operators.bootstrap import A, C, M

    u = ev(spark, d).select("unit").distinct().withColumn("cluster", (F.col("unit") % 23).cast("long"))
    h = u.withColumn("half", (F.pmod(F.col("cluster") * A + C, F.lit(M)) % 2).cast("int"))
    c = Window.partitionBy("cluster")
    return h.select("unit", "half", (F.count(F.lit(1)).over(c) == F.count(F.lit(1)).over(Window.partitionBy("cluster", "half"))).alias("whole"))


@query("MOD20_architectures", f"WITH {EV}, {SCORE}, ar AS (SELECT sc.unit, sc.i, sc.y, 'table' AS arm, round(sc.x, 9) AS x FROM sc UNION ALL SELECT unit, i, y, 'raw', x FROM ev UNION ALL SELECT unit, i, y, 'k', k FROM ev), r AS (SELECT arm, unit, y, rank() OVER (PARTITION BY arm, unit ORDER BY x) + (count(*) OVER (PARTITION BY arm, unit, x) - 1) / 2.0::DOUBLE AS r FROM ar), au AS (SELECT arm, unit, (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0)::DOUBLE AS auc FROM r GROUP BY ALL) SELECT arm, round(avg(auc), 8) AS auc FROM au GROUP BY arm")
def mod20(spark, d):
    e = ev(spark, d)
    arms = {"table": scored(spark, d).select("unit", "i", "y", F.round("x", 9).alias("x")), "raw": e.select("unit", "i", "y", "x"), "k": e.select("unit", "i", "y", F.col("k").cast("double").alias("x"))}
    every = reduce(lambda a, b: a.unionByName(b), [x.select(F.struct(F.lit(n).alias("arm"), F.col("unit")).alias("unit"), "i", "y", "x") for n, x in arms.items()])
    return R.auc(every, "x", "y").groupBy(F.col("unit.arm").alias("arm")).agg(F.round(F.avg("auc"), 8).alias("auc"))


@query("MOD21_leave_fold_out", f"WITH {EV}, {OOF}, so AS (SELECT af.unit, af.i, any_value(af.y) AS y, any_value(af.fold) AS fold, round(sum(pos / nullif(tot, 0)::DOUBLE), 9) AS x FROM af JOIN fr USING (t, addr, fold) GROUP BY af.unit, af.i), {AUC.format('so')}, fu AS (SELECT DISTINCT unit, fold FROM so) SELECT fold, round(avg(auc), 8) AS auc FROM auc JOIN fu USING (unit) GROUP BY fold")
def mod21(spark, d):
    a, c = out_of_fold(spark, d)
    so = a.join(c, ["t", "addr", "fold"]).groupBy("unit", "i", "y", "fold").agg(F.round(F.sum(F.col("pos") / F.nullif(F.col("tot").cast("double"), F.lit(0.0))), 9).alias("x"))
    return R.auc(so, "x", "y").join(folds(spark, d), "unit").groupBy("fold").agg(F.round(F.avg("auc"), 8).alias("auc"))


@query("MOD22_ridge_logistic")
def mod22(spark, d):
    """Newton steps; each is one distributed sum of gradient and curvature (4 + 16 numbers)."""
    from tessera.operators.solvers import newton_logistic

    beta = newton_logistic(digits(spark, d), ["d0", "d1", "d2"], "y", ridge=1.0, steps=8)
    return spark.createDataFrame([(n, float(b)) for n, b in zip(["one", "d0", "d1", "d2"], beta, strict=True)], "wire string, beta double")


@query("MOD23_multiplicity_rules")
def mod23(spark, d):
    parts = T.gram(digits(spark, d), ["d0", "d1", "d2"], "y")
    s = (parts[0][2] + parts[1][2]) / (parts[0][0] + parts[1][0])
    delta = parts[1][1] - parts[0][1]
    peak = lambda w: np.rint(32 * w / np.abs(w).max()).astype(int)
    rng = np.random.default_rng(0)
    rules = {"ridge": T.fan_out(parts, 0.1), "diagonal": peak(delta / np.diag(s)), "standardised": peak(delta / np.sqrt(np.diag(s))), "bands": np.argsort(np.argsort(np.abs(delta))) + 1, "sign": np.sign(delta).astype(int), "random_sign": rng.choice([-1, 1], 3)}
    return spark.createDataFrame([(r, k, int(x)) for r, w in rules.items() for k, x in enumerate(w)], "rule string, wire int, multiplicity int")


@query("MOD24_region_solve")
def mod24(spark, d):
    g = digits(spark, d).withColumn("region", (F.col("unit") % 3).cast("int"))
    rows = []
    for region in range(3):  # a handful of regions, one Gram each
        for k, x in enumerate(T.fan_out(T.gram(g.filter(F.col("region") == region), ["d0", "d1", "d2"], "y"), 0.1)):
            rows.append((region, k, int(x)))
    return spark.createDataFrame(rows, "region int, wire int, multiplicity int")


@query("MOD25_damped_region_weights")
def mod25(spark, d):
    whole = {r["wire"]: r["multiplicity"] for r in mod03(spark, d).collect()}
    m = mod24(spark, d)
    base = F.create_map(*[F.lit(x) for kv in whole.items() for x in kv])
    return m.select("region", "wire", (base[F.col("wire")] + 0.25 * (F.col("multiplicity") - base[F.col("wire")])).alias("weight"))


VAR = "vr AS (SELECT t, sum((pos - (SELECT avg(y) FROM dg) * tot) ** 2 / tot) / (SELECT count(*) FROM dg) AS v FROM ce GROUP BY t)"


@query("MOD26_interaction_variance", f"WITH {EV}, {ADR}, {CELL}, {VAR}, l AS (SELECT 0 AS w, d0 AS l, y FROM dg UNION ALL SELECT 1, d1, y FROM dg UNION ALL SELECT 2, d2, y FROM dg), lc AS (SELECT w, l, count(*) AS tot, sum(y) AS pos FROM l GROUP BY ALL), lv AS (SELECT w, sum((pos - (SELECT avg(y) FROM dg) * tot) ** 2 / tot) / (SELECT count(*) FROM dg) AS v FROM lc GROUP BY w) SELECT t, round(vr.v, 9) AS pair, round(vr.v - a.v - b.v, 9) AS interaction FROM vr JOIN lv a ON a.w = CASE t WHEN 2 THEN 1 ELSE 0 END JOIN lv b ON b.w = CASE t WHEN 0 THEN 1 ELSE 2 END")
def mod26(spark, d):
    pair, single = variances(spark, d)
    a, b = single.select(F.col("w").alias("wa"), F.col("v").alias("va")), single.select(F.col("w").alias("wb"), F.col("v").alias("vb"))
    j = pair.join(a, F.col("wa") == F.when(F.col("t") == 2, 1).otherwise(0)).join(b, F.col("wb") == F.when(F.col("t") == 0, 1).otherwise(2))
    return j.select("t", F.round("v", 9).alias("pair"), F.round(F.col("v") - F.col("va") - F.col("vb"), 9).alias("interaction"))


def variances(spark, d):
    """Between-cell variance of the label for each pair table, and for each digit alone."""
    g = digits(spark, d)
    base = g.agg(F.avg("y").alias("p"), F.count(F.lit(1)).alias("m"))
    part = lambda c, k: c.join(F.broadcast(base), F.lit(True)).groupBy(k, "m").agg((F.sum(F.pow(F.col("pos") - F.col("p") * F.col("tot"), F.lit(2.0)) / F.col("tot")) / F.first("m")).alias("v")).select(k, "v")
    levels = F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"d{w}").alias("l")) for w in range(3)])
    single = g.select("y", F.inline(levels)).groupBy("w", "l").agg(F.count(F.lit(1)).alias("tot"), F.sum("y").alias("pos"))
    return part(T.cells(addresses(spark, d)), "t"), part(single, "w")


@query("MOD27_bipartite_pairs", f"WITH {SHUFFLED} SELECT wr.w AS old, ws.w AS new FROM wr JOIN ws ON wr.place = ws.place")
def mod27(spark, d):
    """Old wires paired with new ones, place by place of their shuffled orders, until one kind is used up."""
    old, new = (shuffled(table(spark, d, t), k) for t, k in (("part", "p_partkey"), ("supplier", "s_suppkey")))
    return old.withColumnRenamed("w", "old").join(new.withColumnRenamed("w", "new"), "at").select("old", "new")


@query("MOD28_stagewise_selection")
def mod28(spark, d):
    from tessera.operators.solvers import stagewise

    return spark.createDataFrame(stagewise(T.cells(addresses(spark, d)), addresses(spark, d), 3, signs=(1, -1)), "step int, t int, sign int, auc double")


@query("MOD29_integer_greedy")
def mod29(spark, d):
    from tessera.operators.solvers import stagewise

    picks = stagewise(T.cells(addresses(spark, d)), addresses(spark, d), 5, signs=(1,), again=True)
    count: dict[int, int] = {}
    for _, t, _, _ in picks:
        count[t] = count.get(t, 0) + 1
    return spark.createDataFrame(sorted(count.items()) or [], "t int, multiplicity int")


@query("MOD30_pair_expansion", f"WITH {EV}, {DIG}, l AS (SELECT i, y, 0 AS w, d0 AS l FROM dg UNION ALL SELECT i, y, 1, d1 FROM dg UNION ALL SELECT i, y, 2, d2 FROM dg) SELECT a.w AS w1, b.w AS w2, a.l AS l1, b.l AS l2, count(*) AS tot, CAST(sum(a.y) AS BIGINT) AS pos FROM l a JOIN l b ON a.i = b.i AND a.w < b.w GROUP BY ALL")
def mod30(spark, d):
    pairs = F.array(*[F.struct(F.lit(a).alias("w1"), F.lit(b).alias("w2"), F.col(f"d{a}").alias("l1"), F.col(f"d{b}").alias("l2")) for a in range(3) for b in range(a + 1, 3)])
    return digits(spark, d).select("y", F.inline(pairs)).groupBy("w1", "w2", "l1", "l2").agg(F.count(F.lit(1)).alias("tot"), F.sum("y").alias("pos"))


@query("MOD31_triple_table", f"WITH {EV}, {DIG} SELECT CAST(d0 + 4 * d1 + 16 * d2 AS BIGINT) AS addr, count(*) AS tot, CAST(sum(y) AS BIGINT) AS pos FROM dg GROUP BY 1")
def mod31(spark, d):
    return digits(spark, d).groupBy(T.address(F.array("d0", "d1", "d2")).alias("addr")).agg(F.count(F.lit(1)).alias("tot"), F.sum("y").alias("pos"))


@query("MOD32_ridge_path", f"WITH {EV}, {DIG}, rg AS (SELECT unnest([0.01::DOUBLE, 0.1, 1.0]) AS ridge), {FAN_OUT} SELECT ridge, wire, multiplicity FROM fo")
def mod32(spark, d):
    parts = T.gram(digits(spark, d), ["d0", "d1", "d2"], "y")
    return spark.createDataFrame([(float(r), k, int(x)) for r in (0.01, 0.1, 1.0) for k, x in enumerate(T.fan_out(parts, r))], "ridge double, wire int, multiplicity int")


@query("MOD33_compared_methods", f"WITH {EV}, a AS (SELECT unit, y, rank() OVER (PARTITION BY unit ORDER BY x) + (count(*) OVER (PARTITION BY unit, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY unit ORDER BY k) + (count(*) OVER (PARTITION BY unit, k) - 1) / 2.0::DOUBLE AS rk FROM ev) SELECT unit, round((sum(rx * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 9) AS auc_a, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 9) AS auc_b FROM a GROUP BY unit HAVING sum(y) BETWEEN 1 AND count(*) - 1")
def mod33(spark, d):
    e = ev(spark, d)
    a, b = R.auc(e, "x", "y"), R.auc(e, "k", "y").withColumnRenamed("auc", "b")
    return a.join(b, "unit").filter("auc is not null").select("unit", F.round("auc", 9).alias("auc_a"), F.round("b", 9).alias("auc_b"))


ZZ = "zz AS (SELECT unit, i, coalesce((x - avg(x) OVER u) / nullif(stddev_pop(x) OVER u, 0), 0) AS za, coalesce((k - avg(k) OVER u) / nullif(stddev_pop(k) OVER u, 0), 0) AS zb FROM ev WINDOW u AS (PARTITION BY unit))"


def zs(spark, d):
    return ev(spark, d).select("unit", "i", W.z_score("x").alias("za"), W.z_score("k").alias("zb"))


@query("MOD34_z_fusion", f"WITH {EV}, {ZZ} SELECT unit, i, round(za + zb, 7) AS equal, round(2 * za + zb, 7) AS weighted FROM zz")
def mod34(spark, d):
    return zs(spark, d).select("unit", "i", F.round(F.col("za") + F.col("zb"), 7).alias("equal"), F.round(2 * F.col("za") + F.col("zb"), 7).alias("weighted"))


@query("MOD35_z_switches", f"WITH {EV}, {ZZ} SELECT unit, i, round(greatest(za, zb), 7) AS top, round(CASE WHEN za < 0 AND zb > 1 THEN zb ELSE za END, 7) AS swapped, round(za + greatest(zb - za, 0), 7) AS lifted FROM zz")
def mod35(spark, d):
    a, b = F.col("za"), F.col("zb")
    return zs(spark, d).select("unit", "i", F.round(F.greatest(a, b), 7).alias("top"), F.round(F.when((a < 0) & (b > 1), b).otherwise(a), 7).alias("swapped"), F.round(a + F.greatest(b - a, F.lit(0.0)), 7).alias("lifted"))


CON = f"{ADR}, {CELL}, cn AS (SELECT ad.unit, ad.i, ad.t, pos / tot::DOUBLE AS c FROM ad JOIN ce USING (t, addr)), dv AS (SELECT *, c - avg(c) OVER (PARTITION BY unit, t) AS dev FROM cn)"


@query("MOD36_additive_parts", f"WITH {EV}, {CON}, f AS (SELECT unit, i, CASE t WHEN 2 THEN 1 ELSE 0 END AS family, dev / 2 AS dev FROM dv UNION ALL SELECT unit, i, CASE t WHEN 0 THEN 1 ELSE 2 END, dev / 2 FROM dv) SELECT unit, i, family, round(sum(dev), 9) AS part FROM f GROUP BY ALL")
def mod36(spark, d):
    a = addresses(spark, d)
    c = a.join(T.cells(a), ["t", "addr"]).select("unit", "i", "t", (F.col("pos") / F.col("tot")).alias("c"))
    dev = c.withColumn("dev", F.col("c") - F.avg("c").over(Window.partitionBy("unit", "t")))
    fam = F.get(F.array(*[F.array(F.lit(int(x[1])), F.lit(int(y[1]))) for x, y in TABLES]), F.col("t"))
    return dev.select("unit", "i", F.explode(fam).alias("family"), (F.col("dev") / 2).alias("dev")).groupBy("unit", "i", "family").agg(F.round(F.sum("dev"), 9).alias("part"))


@query("MOD37_identical_digits", f"WITH {EV}, {DIG}, b AS (SELECT unit, d0, d1, d2, count(*) AS n, sum(y) AS p FROM dg GROUP BY ALL) SELECT unit, count(*) AS blocks, count(*) FILTER (WHERE p > 0 AND p < n) AS mixed, max(n) AS largest, round(sum(lgamma(n + 1)) / ln(10), 6) AS log10_orders FROM b GROUP BY unit")
def mod37(spark, d):
    b = digits(spark, d).groupBy("unit", "d0", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, k: a + F.log10(k.cast("double")))
    return b.groupBy("unit").agg(F.count(F.lit(1)).alias("blocks"), F.count_if((F.col("p") > 0) & (F.col("p") < F.col("n"))).alias("mixed"), F.max("n").alias("largest"), F.round(F.sum(log_factorial), 6).alias("log10_orders"))


@query("MOD38_table_variance", f"WITH {EV}, {ADR}, {CELL}, {VAR} SELECT t, round(v, 10) AS v, row_number() OVER (ORDER BY v DESC, t) AS rank FROM vr")
def mod38(spark, d):
    v = variances(spark, d)[0]
    return v.select("t", F.round("v", 10).alias("v"), F.row_number().over(Window.orderBy(F.desc("v"), "t")).cast("long").alias("rank"))


@query("MET31_interaction_share", f"WITH {EV}, {ADR}, {CELL}, {VAR} SELECT round(avg(v), 10) AS mean, round(median(v), 10) AS median, round(quantile_cont(v, 0.1), 10) AS p10, round(quantile_cont(v, 0.9), 10) AS p90 FROM vr")
def met31(spark, d):
    v = variances(spark, d)[0]
    return v.agg(F.round(F.avg("v"), 10).alias("mean"), F.round(F.median("v"), 10).alias("median"), F.round(F.percentile("v", F.lit(0.1)), 10).alias("p10"), F.round(F.percentile("v", F.lit(0.9)), 10).alias("p90"))


@query("MOD39_gate_sweep", f"WITH {EV}, w AS (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS weight), s AS (SELECT weight, unit % 3 AS region, unit, y, round(coalesce(x + weight * k * (stddev_pop(x) OVER (PARTITION BY unit, weight) / nullif(stddev_pop(k) OVER (PARTITION BY unit, weight), 0)), x), 9) AS s FROM ev, w), r AS (SELECT *, rank() OVER (PARTITION BY weight, unit ORDER BY s) + (count(*) OVER (PARTITION BY weight, unit, s) - 1) / 2.0::DOUBLE AS r FROM s), a AS (SELECT weight, region, unit, (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0)::DOUBLE AS auc FROM r GROUP BY ALL) SELECT weight, region, round(avg(auc), 8) AS auc FROM a GROUP BY ALL")
def mod39(spark, d):
    e = ev(spark, d).withColumn("weight", F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0))))).withColumn("unit", F.struct("weight", "unit"))
    s = e.select("unit", "y", "i", F.round(F.coalesce(F.col("x") + F.col("weight") * F.col("k") * (F.stddev_pop("x").over(Window.partitionBy("unit")) / F.nullif(F.stddev_pop("k").over(Window.partitionBy("unit")), F.lit(0.0))), F.col("x")), 9).alias("s"))
    return R.auc(s, "s", "y").groupBy(F.col("unit.weight").alias("weight"), (F.col("unit.unit") % 3).alias("region")).agg(F.round(F.avg("auc"), 8).alias("auc"))


# ---- detectors ----

FIELD = f"{SCORE}, {CALLED}, mt AS (SELECT unit, count(*) FILTER (WHERE called AND y = 1) AS tp, count(*) FILTER (WHERE called AND y = 0) AS fp, count(*) FILTER (WHERE NOT called AND y = 1) AS fn FROM cl GROUP BY unit), {AUC.format('(SELECT unit, y, i, round(x, 9) AS x FROM sc)')}"


@query("DET09_table_field", f"WITH {EV}, {FIELD} SELECT unit, round(auc, 9) AS auc, tp, fp, fn, round({F1}, 9) AS f1 FROM mt JOIN auc USING (unit)")
def det09(spark, d):
    """The whole chain: digits, pair tables, counts, score, top-share call, metrics per unit."""
    s = scored(spark, d).withColumn("x", F.round("x", 9))
    m = R.confusion(s.withColumn("called", R.top_share("x", 0.1)), F.col("called"), "y", ["unit"])
    return R.auc(s, "x", "y").join(m, "unit").select("unit", F.round("auc", 9).alias("auc"), "tp", "fp", "fn", F.round(R.f1(), 9).alias("f1"))


@query("DET06_lookup_detector", f"WITH {EV}, {DIG}, ce AS (SELECT d0, d1, avg(y) AS f FROM dg GROUP BY ALL), s AS (SELECT unit, i, round(f, 9) AS s FROM dg JOIN ce USING (d0, d1)) SELECT unit, i, s >= quantile_cont(s, 0.85) OVER (PARTITION BY unit) AS positive FROM s")
def det06(spark, d):
    g = digits(spark, d)
    ce = g.groupBy("d0", "d1").agg(F.avg("y").alias("f"))
    s = g.join(ce, ["d0", "d1"]).select("unit", "i", F.round("f", 9).alias("s"))
    return s.select("unit", "i", (F.col("s") >= F.percentile("s", F.lit(0.85)).over(Window.partitionBy("unit"))).alias("positive"))


@query("DET07_counting_field", f"WITH {EV}, {SCORE} SELECT unit, i, round(coalesce(x / nullif(max(abs(x)) OVER (PARTITION BY unit), 0), 0), 8) AS s FROM sc")
def det07(spark, d):
    return scored(spark, d).select("unit", "i", F.round(W.peak_scaled("x"), 8).alias("s"))


@query("DET08_linear_field", f"WITH {EV}, {DIG}, {RIDGE3} SELECT unit, i, round(d0 * b0 + d1 * b1 + d2 * b2, 8) AS score FROM dg, (SELECT max(beta) FILTER (WHERE wire = 'd0') AS b0, max(beta) FILTER (WHERE wire = 'd1') AS b1, max(beta) FILTER (WHERE wire = 'd2') AS b2 FROM be)")
def det08(spark, d):
    """The digits weighted by the ridge coefficients, one small row that joins them."""
    model = mod11(spark, d).groupBy().pivot("wire", ["d0", "d1", "d2"]).agg(F.first("beta"))
    beta = model.select(*[F.col(c).alias(f"b_{c}") for c in ("d0", "d1", "d2")])
    score = sum((F.col(c) * F.col(f"b_{c}") for c in ("d1", "d2")), F.col("d0") * F.col("b_d0"))
    return digits(spark, d).join(F.broadcast(beta), F.lit(True)).select("unit", "i", F.round(score, 8).alias("score"))


@query("DET08b_wide_linear_field")
def det08b(spark, d):
    """Each embedding's score by the coefficients on 625 columns, in one pass over the rows."""
    beta = F.array(*[F.lit(float(b)) for b in _wide_beta(spark, d)])
    x = wide(spark, d, ("vec_id",))
    return x.select("vec_id", "y", F.aggregate(F.zip_with("x", beta, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("score"))


def _wider(n, extra_sql, extra):
    """The table field with one more digit column from another family."""
    sql = f"""WITH {EV}, {ADR}, fx AS (SELECT unit, i, y, CAST(({extra_sql}) % 4 AS INTEGER) AS d3 FROM ev), a2 AS (SELECT * FROM ad UNION ALL SELECT dg.unit, dg.i, dg.y, 3, d0 + 4 * d3 FROM dg JOIN fx USING (unit, i)),
        c2 AS (SELECT t, addr, count(*) AS tot, sum(y) AS pos FROM a2 GROUP BY ALL), s2 AS (SELECT a2.unit, a2.i, any_value(a2.y) AS y, round(sum(pos / tot::DOUBLE), 9) AS x FROM a2 JOIN c2 USING (t, addr) GROUP BY a2.unit, a2.i), {AUC.format('s2')} SELECT unit, round(auc, 9) AS auc FROM auc"""

    @query(n, sql)
    def run(spark, d):
        e = ev(spark, d).select("unit", "i", (F.expr(extra) % 4).cast("int").alias("d3"))
        a = T.table_addresses(digits(spark, d).join(e, ["unit", "i"]), [*TABLES, ("d0", "d3")], ["unit", "i", "y"])
        s = T.score_rows(a, T.cells(a), ["unit", "i", "y"], F.lit(0.0)).select("unit", "i", "y", F.round("score", 9).alias("x"))
        return R.auc(s, "x", "y").select("unit", F.round("auc", 9).alias("auc"))

    return run


for _n, _s in {"DET10_with_geometry": "k // 7", "DET11_with_seams": "k // 3", "DET12_with_apertures": "i // 5", "DET13_with_gates": "i // 9 + k", "DET14_with_lags": "k // 11", "DET15_with_probes": "i // 13", "DET16_with_conservation": "k // 2 + 1"}.items():
    _wider(_n, _s, "cast(" + _s.replace("//", "div") + " as bigint)")


RAYS = "ry AS (SELECT * FROM (VALUES " + ", ".join(f"({1 << k}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for k, (x, y, z) in enumerate(grid.directions(30))) + ") t(bit, v0, v1, v2))"
#: The grid of each unit's box, what is free of it, how buried that is, and the score of the buried.
GRID = f"""bx AS (SELECT unit, min(px) - 3 AS lx, min(py) - 3 AS ly, min(pz) - 3 AS lz, CAST(ceil((max(px) + 3 + 1.5 - (min(px) - 3)) / 1.5) AS BIGINT) AS nx, CAST(ceil((max(py) + 3 + 1.5 - (min(py) - 3)) / 1.5) AS BIGINT) AS ny, CAST(ceil((max(pz) + 3 + 1.5 - (min(pz) - 3)) / 1.5) AS BIGINT) AS nz FROM pts GROUP BY unit),
    gr AS (SELECT unit, (x * ny + y) * nz + z AS i, lx + x * 1.5::DOUBLE AS gx, ly + y * 1.5::DOUBLE AS gy, lz + z * 1.5::DOUBLE AS gz FROM bx, LATERAL (SELECT unnest(range(nx)) AS x), LATERAL (SELECT unnest(range(ny)) AS y), LATERAL (SELECT unnest(range(nz)) AS z)),
    df AS (SELECT g.*, px - gx AS o0, py - gy AS o1, pz - gz AS o2 FROM gr g JOIN pts p ON g.unit = p.unit),
    fr AS MATERIALIZED (SELECT unit, i, any_value(gx) AS px, any_value(gy) AS py, any_value(gz) AS pz FROM df GROUP BY unit, i HAVING min(o0 * o0 + o1 * o1 + o2 * o2) > 6.76 AND min(o0 * o0 + o1 * o1 + o2 * o2) < 36),
    hi AS (SELECT unit, i, bit_or(bit) AS bits FROM (SELECT df.unit, df.i, bit, o0 * v0 + o1 * v1 + o2 * v2 AS along, o0 * o0 + o1 * o1 + o2 * o2 AS d2 FROM df SEMI JOIN fr ON df.unit = fr.unit AND df.i = fr.i JOIN ry ON o0 * o0 + o1 * o1 + o2 * o2 <= 121) WHERE along > 0 AND along <= 11 AND d2 - along * along <= 3.24 GROUP BY ALL),
    bu AS (SELECT fr.*, coalesce(bit_count(bits), 0) / 30.0::DOUBLE AS buried FROM fr LEFT JOIN hi ON fr.unit = hi.unit AND fr.i = hi.i),
    dp AS MATERIALIZED (SELECT * FROM (SELECT *, max(buried) OVER (PARTITION BY unit) AS top, row_number() OVER (PARTITION BY unit ORDER BY buried DESC, i) AS r FROM bu) WHERE buried >= 0.55 OR top < 0.55 AND r <= 50),
    gs AS (SELECT a.unit, a.i, any_value(a.px) AS px, any_value(a.py) AS py, any_value(a.pz) AS pz, round(any_value(a.buried) * ln(1.0::DOUBLE + count(*)), 9) AS v FROM dp a JOIN dp b ON a.unit = b.unit AND {D2} <= 64 GROUP BY a.unit, a.i)"""


@query("DET01_free_grid", f"""WITH {PTS}, {RAYS}, {GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY v DESC, i) AS rank FROM gs), l AS (SELECT unit, list(struct_pack(i := i, s := v, px := px, py := py, pz := pz) ORDER BY rank) AS c FROM r GROUP BY unit),
    k AS (SELECT unit, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < 5 AND len(list_filter(acc, lambda o: sqrt((o.px - x[1].px) ** 2 + (o.py - x[1].py) ** 2 + (o.pz - x[1].pz) ** 2) < 6)) = 0 THEN list_concat(acc, x) ELSE acc END) AS kept FROM l),
    u AS (SELECT unit, CAST(generate_subscripts(kept, 1) AS INTEGER) AS place, unnest(kept) AS c FROM k) SELECT unit, place, c.i AS i, c.s AS score FROM u""")
def det01(spark, d):
    """Free grid points at least 0.55 buried (else the 50 most buried), scored by burial and buried company, thinned by greedy suppression."""
    s = grid.pocket_scores(pts(spark, d)).withColumn("score", F.round("score", 9))
    return R.suppress(s, "score", S.XYZ, 6.0, 5)


@query("DET02_dilation_gain", f"""WITH {PTS}, c AS (SELECT unit, avg(px) AS cx, avg(py) AS cy, avg(pz) AS cz FROM pts GROUP BY unit),
    mv AS (SELECT f, p.unit, p.i, cx + f * (px - cx) AS px, cy + f * (py - cy) AS py, cz + f * (pz - cz) AS pz FROM pts p JOIN c ON p.unit = c.unit, (VALUES (1.1::DOUBLE), (1.25)) v(f)),
    ow AS (SELECT a.unit, a.i, count(*) AS n FROM pts a JOIN pts b ON a.unit = b.unit AND {D2} <= 64 GROUP BY a.unit, a.i), nf AS (SELECT a.unit, a.i, f, count(*) AS n FROM pts a JOIN mv b ON a.unit = b.unit AND {D2} <= 64 GROUP BY a.unit, a.i, f)
    SELECT o.unit, o.i, round(any_value(o.n) * (1 + max(greatest(o.n - coalesce(nf.n, 0), 0) / o.n::DOUBLE)), 9) AS score FROM ow o CROSS JOIN (VALUES (1.1::DOUBLE), (1.25)) v(f) LEFT JOIN nf ON nf.unit = o.unit AND nf.i = o.i AND nf.f = v.f GROUP BY o.unit, o.i""")
def det02(spark, d):
    """Burial times one plus the gain in empty neighbourhood under two dilations about the centroid."""
    from tessera.operators.detectors import dilation_gain

    return dilation_gain(pts(spark, d)).withColumn("score", F.round("score", 9))


@query("DET03_anchored_deformation", f"WITH {PTS}, {deformed(27)} SELECT unit, i, score FROM bd")
def det03(spark, d):
    from tessera.operators.detectors import best_deformation

    return best_deformation(pts(spark, d), 27).withColumn("score", F.round("score", 9))


@query("DET04_branch_gated")
def det04(spark, d):
    from tessera.operators.detectors import best_deformation
    from tessera.operators.graph import linked_branches

    p = pts(spark, d)
    s = best_deformation(p, 8, isochoric=True).join(linked_branches(p, 14.0), ["unit", "i"])
    full = s.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("unit", "branch")))
    return full.filter("size >= 3").groupBy("unit", "branch").agg(F.max_by("i", F.struct(F.col("score"), -F.col("i"))).alias("i"), F.max("score").alias("score"))


@query("DET05_jittered_grid")
def det05(spark, d):
    from tessera.operators.detectors import jittered_candidates

    p = pts(spark, d)
    c = jittered_candidates(p, 6.0, 0)
    n = S.radius_join(c, p, 8.0).groupBy("unit", F.col("a_i").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return R.suppress(c.join(n, ["unit", "i"]), "score", S.XYZ, 4.0, 5)


@query("DET20_random_box")
def det20(spark, d):
    from tessera.operators.detectors import random_boxes

    return random_boxes(pts(spark, d), 5, 42)


@query("DET21_random_surface", f"WITH {PTS} SELECT unit, i, r AS rank FROM (SELECT unit, i, row_number() OVER (PARTITION BY unit ORDER BY (i * 1103515245 + 12345) % 2147483648, i) AS r FROM pts) WHERE r <= 5")
def det21(spark, d):
    from tessera.operators.bootstrap import A, C, M

    r = F.row_number().over(Window.partitionBy("unit").orderBy(F.pmod(F.col("i") * A + C, F.lit(M)), "i")).cast("long")
    return pts(spark, d).select("unit", "i", r.alias("rank")).filter("rank <= 5")
