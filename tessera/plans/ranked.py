"""Queries on ranks, windows, top-k and suppression (WIN, TOP)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import ranking as R
from tessera.operators import windows as W
from tessera.plans.bindings import EV, ORD, PTS, ev, orders, pts
from tessera.plans.registry import query
from tessera.session import table

MID = "(rank() OVER (PARTITION BY unit ORDER BY x) - 1 + (count(*) OVER (PARTITION BY unit, x) - 1) / 2.0::DOUBLE)"
NORM = f"({MID} / greatest(count(*) OVER (PARTITION BY unit) - 1, 1))"


@query("WIN01_quartile_digit", f"WITH {EV} SELECT unit, i, CAST(least(3, floor({NORM} * 4)) AS INTEGER) AS digit FROM ev")
def win01(spark, d):
    return ev(spark, d).select("unit", "i", W.quartile_digit("x").alias("digit"))


@query("WIN02_cut_digit", f"WITH {EV} SELECT unit, i, CAST((quantile_cont(x, 0.25) OVER w < x) AS INTEGER) + CAST((quantile_cont(x, 0.5) OVER w < x) AS INTEGER) + CAST((quantile_cont(x, 0.75) OVER w < x) AS INTEGER) AS digit FROM ev WINDOW w AS (PARTITION BY unit)")
def win02(spark, d):
    return ev(spark, d).select("unit", "i", W.cut_digit("x").alias("digit"))


@query("WIN03_rank_band", f"WITH {EV}, r AS (SELECT unit, i, {NORM} AS r FROM ev) SELECT unit, i, CAST(r >= 0.1 AS INTEGER) + CAST(r >= 0.5 AS INTEGER) + CAST(r >= 0.9 AS INTEGER) AS band FROM r")
def win03(spark, d):
    return ev(spark, d).select("unit", "i", W.rank_band("x", (0.1, 0.5, 0.9)).alias("band"))


@query("WIN04_normal_rank", f"WITH {EV} SELECT unit, i, {NORM} AS r FROM ev")
def win04(spark, d):
    return ev(spark, d).select("unit", "i", W.normal_rank("x").alias("r"))


@query("WIN05_permille", f"WITH {ORD} SELECT unit, i, CASE WHEN count(*) OVER (PARTITION BY unit) = 1 THEN 500.0::DOUBLE ELSE 1000 * {NORM} END AS permille FROM od")
def win05(spark, d):
    return orders(spark, d).select("unit", "i", W.permille("x").alias("permille"))


@query("WIN06_robust_z", f"""WITH {EV}, m AS (SELECT *, median(x) OVER (PARTITION BY unit) AS m FROM ev), q AS (SELECT *, median(abs(x - m)) OVER (PARTITION BY unit) AS mad FROM m)
    SELECT unit, i, round(coalesce(100 * greatest(-8.0::DOUBLE, least(8.0::DOUBLE, (x - m) / nullif(mad, 0))), 0.0::DOUBLE), 8) AS z FROM q""")
def win06(spark, d):
    return W.robust_z(ev(spark, d), "x", "z").select("unit", "i", F.round("z", 8).alias("z"))


RUNS = """g AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY i) - row_number() OVER (PARTITION BY unit, f ORDER BY i) AS g FROM b),
    r AS (SELECT unit, i, f, CASE WHEN f THEN count(*) OVER (PARTITION BY unit, f, g) ELSE 0 END AS run_length, CASE WHEN f THEN row_number() OVER (PARTITION BY unit, f, g ORDER BY i) - 1 END AS run_offset FROM g)"""


@query("WIN07_runs", f"WITH {EV}, b AS (SELECT unit, i, x > 50 AS f FROM ev), {RUNS} SELECT unit, i, run_length, run_offset FROM r")
def win07(spark, d):
    return W.runs(ev(spark, d).withColumn("f", F.col("x") > 50), "f").select("unit", "i", F.col("run_length").cast("long").alias("run_length"), F.col("run_offset").cast("long").alias("run_offset"))


SEG = "s AS (SELECT *, sum(CASE WHEN p IS NULL THEN 0 WHEN abs(x - p) <= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY i) AS seg FROM (SELECT *, lag(x) OVER (PARTITION BY unit ORDER BY i) AS p FROM ev))"


def _segmented(spark, d):
    w = Window.partitionBy("unit").orderBy("i")
    return W.segments(ev(spark, d), F.abs(F.col("x") - F.lag("x").over(w)) <= 40)


@query("WIN08_segments", f"WITH {EV}, {SEG} SELECT unit, i, CAST(seg AS BIGINT) AS seg FROM s")
def win08(spark, d):
    return _segmented(spark, d).select("unit", "i", "seg")


@query("WIN09_segment_shift", f"WITH {EV}, {SEG} SELECT unit, i, lag(x, 2, -1.0::DOUBLE) OVER w AS back, lead(x, 1, 0.0::DOUBLE) OVER w AS ahead FROM s WINDOW w AS (PARTITION BY unit, seg ORDER BY i)")
def win09(spark, d):
    return _segmented(spark, d).select("unit", "i", W.shifted("x", 2, -1.0).alias("back"), W.shifted("x", -1, 0.0).alias("ahead"))


@query("WIN10_stable_rank", f"WITH {EV} SELECT unit, i, row_number() OVER (PARTITION BY unit ORDER BY x, i) / (count(*) OVER (PARTITION BY unit))::DOUBLE AS r, x >= quantile_cont(x, 0.75) OVER (PARTITION BY unit) AS top FROM ev")
def win10(spark, d):
    q = F.percentile("x", F.lit(0.75)).over(Window.partitionBy("unit"))
    return ev(spark, d).select("unit", "i", (W.ordinal_rank("x") / W.unit_size()).alias("r"), (F.col("x") >= q).alias("top"))


@query("WIN11_ordinal_share", f"WITH {EV} SELECT unit, i, (row_number() OVER (PARTITION BY unit ORDER BY x, i) - 1) / greatest(count(*) OVER (PARTITION BY unit) - 1, 1)::DOUBLE AS r FROM ev")
def win11(spark, d):
    return ev(spark, d).select("unit", "i", ((W.ordinal_rank("x") - 1) / F.greatest(W.unit_size() - 1, F.lit(1))).alias("r"))


LAGS = (1, 2, 3, 4, 5, 8, 12, 16, 20)


@query("WIN12_number_lags", f"""WITH {EV}, n AS (SELECT unit, i // 20 AS i, avg(x) AS x FROM ev GROUP BY ALL)
    SELECT a.unit, a.i, {', '.join(f'round(avg(CASE WHEN abs(a.i - b.i) = {k} THEN abs(a.x - b.x) END), 8) AS lag{k}' for k in LAGS)}
    FROM n a LEFT JOIN n b ON a.unit = b.unit AND abs(a.i - b.i) IN {LAGS} GROUP BY a.unit, a.i""")
def win12(spark, d):
    n = ev(spark, d).groupBy("unit", F.floor(F.col("i") / 20).cast("long").alias("i")).agg(F.avg("x").alias("x"))
    out = W.number_lags(n, "x", LAGS)
    return out.select("unit", "i", *[F.round(f"lag{k}", 8).alias(f"lag{k}") for k in LAGS])


@query("WIN13_positional_lags", f"WITH {EV} SELECT unit, i, {', '.join(f'coalesce(abs(x - lead(x, {k}) OVER w), abs(lag(x, {k}) OVER w - x), 0) AS far{k}, coalesce(x * lead(x, {k}) OVER w, 0) AS prod{k}' for k in (1, 3, 5))} FROM ev WINDOW w AS (PARTITION BY unit ORDER BY i)")
def win13(spark, d):
    w = Window.partitionBy("unit").orderBy("i")
    out = ev(spark, d)
    return out.select("unit", "i", *[c for k in (1, 3, 5) for c in (F.coalesce(F.abs(F.col("x") - F.lead("x", k).over(w)), F.abs(F.lag("x", k).over(w) - F.col("x")), F.lit(0.0)).alias(f"far{k}"), F.coalesce(F.col("x") * F.lead("x", k).over(w), F.lit(0.0)).alias(f"prod{k}"))])


@query("WIN14_turn_angles", f"""WITH {PTS}, v AS (SELECT *, px - lag(px) OVER w AS ax, py - lag(py) OVER w AS ay, pz - lag(pz) OVER w AS az, lead(px) OVER w - px AS bx, lead(py) OVER w - py AS by_, lead(pz) OVER w - pz AS bz FROM pts WINDOW w AS (PARTITION BY unit ORDER BY i))
    SELECT unit, i, CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN round(degrees(acos(greatest(-1.0, least(1.0, (ax * bx + ay * by_ + az * bz) / nullif(sqrt(ax * ax + ay * ay + az * az) * sqrt(bx * bx + by_ * by_ + bz * bz), 0))))), 7) END AS angle FROM v""")
def win14(spark, d):
    w = Window.partitionBy("unit").orderBy("i")
    a = [F.col(c) - F.lag(c).over(w) for c in ("px", "py", "pz")]
    b = [F.lead(c).over(w) - F.col(c) for c in ("px", "py", "pz")]
    from tessera.functions.geometry import dot, norm

    v = pts(spark, d).select("unit", "i", *[x.alias(f"a{k}") for k, x in enumerate(a)], *[x.alias(f"b{k}") for k, x in enumerate(b)])
    a, b = [F.col(f"a{k}") for k in range(3)], [F.col(f"b{k}") for k in range(3)]
    c = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return v.select("unit", "i", F.when(c.isNotNull(), F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))), 7)).alias("angle"))


@query("WIN15_centred_sums", f"WITH {EV} SELECT unit, i, {', '.join(f'round(sum(x) OVER (PARTITION BY unit ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING), 7) AS sum{h}, count(*) OVER (PARTITION BY unit ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS n{h}' for h in (2, 3, 4))} FROM ev")
def win15(spark, d):
    return ev(spark, d).select("unit", "i", *[c for h in (2, 3, 4) for c in (F.round(W.centred(F.sum, "x", h), 7).alias(f"sum{h}"), W.centred(F.count, "x", h).alias(f"n{h}"))])


@query("WIN16_run_and_window", f"WITH {EV}, b AS (SELECT unit, i, k % 3 = 0 AS f FROM ev), {RUNS} SELECT unit, i, run_length, sum(CAST(f AS INTEGER)) OVER (PARTITION BY unit ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)::BIGINT AS near FROM r")
def win16(spark, d):
    r = W.runs(ev(spark, d).withColumn("f", F.col("k") % 3 == 0).withColumn("f1", F.col("f").cast("int")), "f")
    return r.select("unit", "i", F.col("run_length").cast("long").alias("run_length"), W.centred(F.sum, "f1", 2).alias("near"))


@query("WIN17_capped_run_and_change", f"""WITH {EV}, c AS (SELECT unit, i, k % 4 AS cell, row_number() OVER (PARTITION BY unit ORDER BY i) AS rn FROM ev), h AS (SELECT *, coalesce(cell <> lag(cell) OVER (PARTITION BY unit ORDER BY i), true) AS new FROM c),
    g AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY unit ORDER BY i) AS g FROM h)
    SELECT unit, i, least(count(*) OVER (PARTITION BY unit, g), 12) AS run, least(rn - min(rn) OVER (PARTITION BY unit, g), max(rn) OVER (PARTITION BY unit, g) - rn) AS to_change FROM g""")
def win17(spark, d):
    w = Window.partitionBy("unit").orderBy("i")
    c = ev(spark, d).select("unit", "i", (F.col("k") % 4).alias("cell"), F.row_number().over(w).cast("long").alias("rn"))
    g = W.segments(c, F.col("cell") == F.lag("cell").over(w), "g")
    own = Window.partitionBy("unit", "g")
    return g.select("unit", "i", F.least(F.count(F.lit(1)).over(own), F.lit(12)).alias("run"), F.least(F.col("rn") - F.min("rn").over(own), F.max("rn").over(own) - F.col("rn")).alias("to_change"))


@query("WIN18_runs_in_window", f"""WITH {EV}, f AS (SELECT unit, i, x > 60 AS f FROM ev), s AS (SELECT *, CAST(f AND coalesce(NOT lag(f) OVER (PARTITION BY unit ORDER BY i), false) AS INTEGER) AS start FROM f)
    SELECT unit, i, CAST(coalesce(sum(start) OVER (PARTITION BY unit ORDER BY i ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING), 0) + first_value(CAST(f AS INTEGER)) OVER (PARTITION BY unit ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS n_runs FROM s""")
def win18(spark, d):
    w = Window.partitionBy("unit").orderBy("i")
    f = ev(spark, d).select("unit", "i", (F.col("x") > 60).alias("f"))
    s = f.withColumn("start", (F.col("f") & F.coalesce(~F.lag("f").over(w), F.lit(False))).cast("int"))
    first = F.first(F.col("f").cast("int")).over(w.rowsBetween(-5, 5))
    return s.select("unit", "i", (F.coalesce(F.sum("start").over(w.rowsBetween(-4, 5)), F.lit(0)) + first).cast("long").alias("n_runs"))


@query("WIN19_borda", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY x, i) + row_number() OVER (PARTITION BY unit ORDER BY k, i) AS borda, count(*) OVER (PARTITION BY unit) AS n FROM ev),
    h AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY borda DESC, i) <= greatest(1, round_even(0.1 * n, 0)) AS head FROM r)
    SELECT unit, i, borda, CASE WHEN head THEN n + row_number() OVER (PARTITION BY unit, head ORDER BY x, i) ELSE row_number() OVER (PARTITION BY unit, head ORDER BY borda, i) END AS score FROM h""")
def win19(spark, d):
    r = ev(spark, d).select("unit", "i", "x", (W.ordinal_rank("x") + W.ordinal_rank("k")).cast("long").alias("borda"), W.unit_size().alias("n"))
    h = r.withColumn("head", R.top_share("borda", 0.1))
    own = Window.partitionBy("unit", "head")
    return h.select("unit", "i", "borda", F.when(F.col("head"), F.col("n") + F.row_number().over(own.orderBy("x", "i"))).otherwise(F.row_number().over(own.orderBy("borda", "i"))).alias("score"))


Z = "coalesce((x - avg(x) OVER u) / nullif(stddev_pop(x) OVER u, 0), 0)"


@query("WIN20_z_score", f"WITH {EV} SELECT unit, i, round({Z}, 7) AS z FROM ev WINDOW u AS (PARTITION BY unit)")
def win20(spark, d):
    return ev(spark, d).select("unit", "i", F.round(W.z_score("x"), 7).alias("z"))


@query("WIN21_gate", f"WITH {EV} SELECT unit, i, round(coalesce(x + 0.5 * k * (stddev_pop(x) OVER u / nullif(stddev_pop(k) OVER u, 0)), x), 7) AS s FROM ev WINDOW u AS (PARTITION BY unit)")
def win21(spark, d):
    return ev(spark, d).select("unit", "i", F.round(W.gate("x", "k", 0.5), 7).alias("s"))


@query("WIN22_peak_scaled", f"WITH {EV} SELECT unit, i, coalesce((x - 50) / nullif(max(abs(x - 50)) OVER (PARTITION BY unit), 0), 0) AS s FROM ev")
def win22(spark, d):
    return ev(spark, d).withColumn("x", F.col("x") - 50).select("unit", "i", W.peak_scaled("x").alias("s"))


@query("WIN23_unit_scaled", f"WITH {ORD} SELECT unit, i, coalesce((x - min(x) OVER u) / nullif(max(x) OVER u - min(x) OVER u, 0), 0) AS s FROM od WINDOW u AS (PARTITION BY unit)")
def win23(spark, d):
    u = Window.partitionBy("unit")
    return orders(spark, d).select("unit", "i", F.coalesce((F.col("x") - F.min("x").over(u)) / F.nullif(F.max("x").over(u) - F.min("x").over(u), F.lit(0.0)), F.lit(0.0)).alias("s"))


@query("WIN24_equal_bands", f"WITH {EV}, n AS (SELECT unit, count(*) AS size FROM ev GROUP BY unit), r AS (SELECT *, row_number() OVER (ORDER BY size, unit) - 1 AS pos, count(*) OVER () AS n FROM n) SELECT unit, size, CAST(pos >= floor(n / 4.0) AS INTEGER) + CAST(pos >= floor(2 * n / 4.0) AS INTEGER) + CAST(pos >= floor(3 * n / 4.0) AS INTEGER) AS band FROM r")
def win24(spark, d):
    return W.equal_bands(ev(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("size")), "size", 4)


@query("TOP01_top_share", f"WITH {EV} SELECT unit, i, row_number() OVER (PARTITION BY unit ORDER BY x DESC, i) <= greatest(1, round_even(0.15::DOUBLE * count(*) OVER (PARTITION BY unit), 0)) AS called FROM ev")
def top01(spark, d):
    return ev(spark, d).select("unit", "i", R.top_share("x", 0.15).alias("called"))


@query("TOP02_nearest_of_top", f"""WITH {PTS}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY v DESC, i) AS rank FROM pts), c AS (SELECT unit, avg(px) AS cx, avg(py) AS cy, avg(pz) AS cz FROM pts GROUP BY unit)
    SELECT unit, round(min(sqrt((px - cx) ** 2 + (py - cy) ** 2 + (pz - cz) ** 2)), 8) AS dca, min(sqrt((px - cx) ** 2 + (py - cy) ** 2 + (pz - cz) ** 2)) <= 4 AS hit FROM r JOIN c USING (unit) WHERE rank <= 3 GROUP BY unit""")
def top02(spark, d):
    from tessera.functions.geometry import distance

    p = pts(spark, d)
    c = p.groupBy("unit").agg(*[F.avg(x).alias(f"c{x[1]}") for x in ("px", "py", "pz")])
    top = R.top_rows(p, [F.desc("v"), "i"], 3, ["unit"]).join(c, "unit")
    m = F.min(distance(["px", "py", "pz"], ["cx", "cy", "cz"]))
    return top.groupBy("unit").agg(F.round(m, 8).alias("dca"), (m <= 4).alias("hit"))


@query("TOP03_suppression", f"""WITH {PTS}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY v DESC, i) AS rank FROM pts), l AS (SELECT unit, list(struct_pack(i := i, s := v, px := px, py := py, pz := pz) ORDER BY rank) AS c FROM r GROUP BY unit),
    k AS (SELECT unit, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < 5 AND len(list_filter(acc, lambda o: sqrt((o.px - x[1].px) ** 2 + (o.py - x[1].py) ** 2 + (o.pz - x[1].pz) ** 2) < 6)) = 0 THEN list_concat(acc, x) ELSE acc END) AS kept FROM l),
    u AS (SELECT unit, CAST(generate_subscripts(kept, 1) AS INTEGER) AS place, unnest(kept) AS c FROM k) SELECT unit, place, c.i AS i, c.s AS score FROM u""")
def top03(spark, d):
    return R.suppress(pts(spark, d), "v", ("px", "py", "pz"), 6.0, 5)


@query("TOP04_stride", f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY unit) AS n FROM ev) SELECT unit, i FROM r WHERE n <= 20 OR pos % CAST(ceil(n / 20.0) AS BIGINT) = 0")
def top04(spark, d):
    r = ev(spark, d).withColumns({"at": F.row_number().over(Window.partitionBy("unit").orderBy("i")) - 1, "n": W.unit_size()})
    return r.filter((F.col("n") <= 20) | (F.col("at") % F.ceil(F.col("n") / 20) == 0)).select("unit", "i")


@query("TOP05_threshold_with_fallback", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY x DESC, i) AS rank, count(*) FILTER (WHERE x >= 99) OVER (PARTITION BY unit) AS good FROM ev)
    SELECT unit, i, x FROM r WHERE rank <= 6 AND (x >= 99 OR good = 0)""")
def top05(spark, d):
    r = ev(spark, d).withColumns({"rank": F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("x"), "i")), "good": F.count_if(F.col("x") >= 99).over(Window.partitionBy("unit"))})
    return r.filter((F.col("rank") <= 6) & ((F.col("x") >= 99) | (F.col("good") == 0))).select("unit", "i", "x")


@query("TOP06_rank_sums", f"WITH {EV}, s AS (SELECT unit, k % 5 AS site, round(sum(x), 6) AS score FROM ev GROUP BY ALL) SELECT unit, site, score, row_number() OVER (PARTITION BY unit ORDER BY score DESC, site) AS rank FROM s")
def top06(spark, d):
    s = ev(spark, d).groupBy("unit", (F.col("k") % 5).alias("site")).agg(F.round(F.sum("x"), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("score"), "site")).cast("long"))


@query("TOP07_best_with_null_order", f"WITH {ORD}, c AS (SELECT *, CASE WHEN i % 3 = 0 THEN NULL ELSE x END AS res FROM od) SELECT unit, i FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY coalesce(res, 99e9), -x, i) AS r FROM c) WHERE r = 1")
def top07(spark, d):
    c = orders(spark, d).withColumn("res", F.when(F.col("i") % 3 != 0, F.col("x")))
    return R.top_rows(c, [F.coalesce("res", F.lit(99e9)), F.desc("x"), "i"], 1, ["unit"]).select("unit", "i")


@query("TOP08_top_deviations", f"WITH {EV}, r AS (SELECT *, x - avg(x) OVER (PARTITION BY unit) AS dev FROM ev) SELECT unit, i, round(dev, 8) AS dev, rank FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(abs(dev), 9) DESC, i) AS rank FROM r) WHERE rank <= 4")
def top08(spark, d):
    r = ev(spark, d).withColumn("dev", F.col("x") - F.avg("x").over(Window.partitionBy("unit")))
    return R.top_rows(r, [F.desc(F.round(F.abs("dev"), 9)), "i"], 4, ["unit"]).select("unit", "i", F.round("dev", 8).alias("dev"), F.col("rank").cast("long").alias("rank"))


@query("TOP09_case_per_class", f"""WITH {EV}, c AS (SELECT *, CASE WHEN x >= 50 AND k >= 50 THEN 'both' WHEN x >= 50 THEN 'first' WHEN k >= 50 THEN 'second' ELSE 'neither' END AS outcome FROM ev),
    r AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY CASE outcome WHEN 'both' THEN least(x, k) WHEN 'neither' THEN x + k ELSE abs(x - k) END DESC, i) AS r FROM c) SELECT outcome, unit, i FROM r WHERE r = 1""")
def top09(spark, d):
    x, k = F.col("x"), F.col("k").cast("double")
    outcome = F.when((x >= 50) & (k >= 50), "both").when(x >= 50, "first").when(k >= 50, "second").otherwise("neither")
    rule = F.when(F.col("outcome") == "both", F.least(x, k)).when(F.col("outcome") == "neither", x + k).otherwise(F.abs(x - k))
    best = ev(spark, d).withColumn("outcome", outcome).groupBy("outcome").agg(F.max_by(F.struct("unit", "i"), F.struct(rule, -F.col("i"))).alias("b"))
    return best.select("outcome", "b.unit", "b.i")


@query("TOP10_role_picks", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY x DESC, i) <= greatest(1, round_even(0.2::DOUBLE * count(*) OVER (PARTITION BY unit), 0)) AS called FROM ev)
    SELECT unit, arg_max(i, (x, -i)) FILTER (WHERE called AND y = 1) AS hit, arg_max(i, (x, -i)) FILTER (WHERE called AND y = 0) AS false_call, arg_max(i, (x, -i)) FILTER (WHERE NOT called AND y = 1) AS near_miss, arg_min(i, (x, i)) FILTER (WHERE NOT called AND y = 1) AS deep_miss FROM r GROUP BY unit""")
def top10(spark, d):
    r = ev(spark, d).withColumn("called", R.top_share("x", 0.2))
    best = lambda cond, name: F.max_by(F.when(cond, F.col("i")), F.when(cond, F.struct(F.col("x"), -F.col("i")))).alias(name)
    c, y = F.col("called"), F.col("y") == 1
    return r.groupBy("unit").agg(best(c & y, "hit"), best(c & ~y, "false_call"), best(~c & y, "near_miss"), F.min_by(F.when(~c & y, F.col("i")), F.when(~c & y, F.struct("x", "i"))).alias("deep_miss"))


@query("TOP11_disjoint_pairs", """WITH bm AS (SELECT c_nationkey AS n, date_trunc('month', o_orderdate) AS m, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    w AS (SELECT x.n AS a, y.n AS b, CAST(sum(least(x.c, y.c)) AS BIGINT) AS weight FROM bm x JOIN bm y ON x.m = y.m AND x.n < y.n GROUP BY ALL),
    l AS (SELECT list(struct_pack(a := a, b := b, weight := weight) ORDER BY weight DESC, a, b) AS c FROM w),
    k AS (SELECT list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda o: o.a IN (x[1].a, x[1].b) OR o.b IN (x[1].a, x[1].b))) = 0 THEN list_concat(acc, x) ELSE acc END) AS kept FROM l)
    SELECT p.a, p.b, p.weight FROM (SELECT unnest(kept) AS p FROM k)""")
def top11(spark, d):
    """Greedy heaviest disjoint pairs of customers' nations by shared order months: a driver fold over a bounded matrix (25 x 25)."""
    from tessera.operators.tables import greedy_pairs

    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    by = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", F.trunc("o_orderdate", "month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    a, b = by.select(F.col("c_nationkey").alias("a"), "m", F.col("n").alias("na")), by.select(F.col("c_nationkey").alias("b"), "m", F.col("n").alias("nb"))
    w = a.join(b, "m").filter("a < b").groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("weight"))
    return greedy_pairs(spark, w, n.count())
