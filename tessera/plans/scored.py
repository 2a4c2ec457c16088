"""Queries on metrics, statistics and bootstraps (MET) and on sets (SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import bootstrap as B
from tessera.operators import ranking as R
from tessera.operators import windows as W
from tessera.plans.bindings import EV, ORD, ev, orders
from tessera.plans.registry import query
from tessera.session import table

AUC = """r AS (SELECT unit, y, rank() OVER (PARTITION BY unit ORDER BY x) + (count(*) OVER (PARTITION BY unit, x) - 1) / 2.0::DOUBLE AS r FROM {0}),
    auc AS (SELECT unit, (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0)::DOUBLE AS auc FROM r GROUP BY unit)"""
AP = """c AS (SELECT unit, y, sum(y) OVER w AS c, row_number() OVER w AS n FROM {0} WINDOW w AS (PARTITION BY unit ORDER BY x DESC, i ROWS UNBOUNDED PRECEDING)),
    ap AS (SELECT unit, sum(CASE WHEN y = 1 THEN c / n::DOUBLE END) / nullif(sum(y), 0)::DOUBLE AS ap FROM c GROUP BY unit)"""
CALL = "d AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY x DESC, i) <= greatest(1, round_even(0.2::DOUBLE * count(*) OVER (PARTITION BY unit), 0)) AS called FROM {0}), m AS (SELECT unit, count(*) FILTER (WHERE called AND y = 1) AS tp, count(*) FILTER (WHERE called AND y = 0) AS fp, count(*) FILTER (WHERE NOT called AND y = 1) AS fn, count(*) FILTER (WHERE NOT called AND y = 0) AS tn FROM d GROUP BY unit)"
MCC = "(tp * tn - fp * fn)::DOUBLE / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0)"
F1 = "(2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0)"


def called(df, q=0.2):
    return df.withColumn("called", R.top_share("x", q))


@query("MET01_auc", f"WITH {EV}, {AUC.format('ev')} SELECT unit, round(auc, 10) AS auc FROM auc")
def met01(spark, d):
    return R.auc(ev(spark, d), "x", "y").select("unit", F.round("auc", 10).alias("auc"))


@query("MET02_average_precision", f"WITH {EV}, {AP.format('ev')} SELECT unit, round(ap, 10) AS ap FROM ap")
def met02(spark, d):
    return R.average_precision(ev(spark, d), "x", "y").select("unit", F.round("ap", 10).alias("ap"))


@query("MET03_unit_metrics", f"WITH {EV}, {AUC.format('ev')}, {AP.format('ev')}, {CALL.format('ev')} SELECT unit, round(auc, 10) AS auc, round(ap, 10) AS ap, round({MCC}, 10) AS mcc, round({F1}, 10) AS f1 FROM auc JOIN ap USING (unit) JOIN m USING (unit)")
def met03(spark, d):
    e = ev(spark, d)
    m = R.confusion(called(e), F.col("called"), "y", ["unit"])
    out = R.auc(e, "x", "y").join(R.average_precision(e, "x", "y"), "unit").join(m, "unit")
    return out.select("unit", F.round("auc", 10).alias("auc"), F.round("ap", 10).alias("ap"), F.round(R.mcc(), 10).alias("mcc"), F.round(R.f1(), 10).alias("f1"))


STATUS = "CASE WHEN i % 17 = 0 THEN 'CRASH' WHEN i % 13 = 0 THEN 'EMPTY' WHEN i % 29 = 0 THEN 'TOOL_UNAVAILABLE' ELSE 'OK' END"


def status(i="i"):
    i = F.col(i)
    return F.when(i % 17 == 0, "CRASH").when(i % 13 == 0, "EMPTY").when(i % 29 == 0, "TOOL_UNAVAILABLE").otherwise("OK")


@query("MET04_prediction_score", f"WITH {ORD}, s AS (SELECT unit % 20 AS method, {STATUS} AS status, x, y FROM od) SELECT method, status, status <> 'TOOL_UNAVAILABLE' AS eligible, count(*) AS n, CAST(sum(CASE WHEN status = 'OK' AND x > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS top1, CAST(sum(CASE WHEN status = 'OK' AND x > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS top3 FROM s GROUP BY ALL")
def met04(spark, d):
    s = orders(spark, d).select((F.col("unit") % 20).alias("method"), status().alias("status"), "x")
    ok = F.col("status") == "OK"
    return s.groupBy("method", "status", (F.col("status") != "TOOL_UNAVAILABLE").alias("eligible")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok & (F.col("x") > 200000)).alias("top1"), F.count_if(ok & (F.col("x") > 100000)).alias("top3"))


@query("MET05_telemetry_row", f"WITH {EV}, {AUC.format('ev')}, {CALL.format('ev')}, n AS (SELECT unit, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_positive, min(i) AS first_i FROM ev GROUP BY unit) SELECT 'top' AS method, unit, n_rows, n_positive, CASE WHEN n_positive = 0 THEN 'EMPTY' ELSE 'OK' END AS status, round(auc, 10) AS auc, tp, fp, fn, tn, first_i FROM n JOIN auc USING (unit) JOIN m USING (unit)")
def met05(spark, d):
    e = ev(spark, d)
    n = e.groupBy("unit").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("n_positive"), F.min("i").alias("first_i"))
    out = n.join(R.auc(e, "x", "y"), "unit").join(R.confusion(called(e), F.col("called"), "y", ["unit"]), "unit")
    return out.select(F.lit("top").alias("method"), "unit", "n_rows", "n_positive", F.when(F.col("n_positive") == 0, "EMPTY").otherwise("OK").alias("status"), F.round("auc", 10).alias("auc"), "tp", "fp", "fn", "tn", "first_i")


@query("MET06_confusion_at_threshold", f"WITH {EV}, m AS (SELECT unit, count(*) FILTER (WHERE x >= 70 AND y = 1) AS tp, count(*) FILTER (WHERE x >= 70 AND y = 0) AS fp, count(*) FILTER (WHERE x < 70 AND y = 1) AS fn, count(*) FILTER (WHERE x < 70 AND y = 0) AS tn FROM ev GROUP BY unit) SELECT *, round({MCC}, 10) AS mcc, round({F1}, 10) AS f1 FROM m")
def met06(spark, d):
    m = R.confusion(ev(spark, d), F.col("x") >= 70, "y", ["unit"])
    return m.select("*", F.round(R.mcc(), 10).alias("mcc"), F.round(R.f1(), 10).alias("f1"))


# Bootstraps draw by a linear congruential step over (replicate, draw), the same numbers in either engine.
DRAW = "CAST(((CAST(b AS BIGINT) * 1103515245 + CAST(j AS BIGINT) * 12345 + 7919) % 2147483648 * 1103515245 + 12345) % 2147483648 AS BIGINT)"
PAIRED = f"""{EV}, u AS (SELECT unit, avg(x) AS a, avg(k) AS c FROM ev GROUP BY unit), n AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS pos, count(*) OVER () AS n FROM u),
    dr AS (SELECT b, j, {DRAW} % (SELECT count(*) FROM u) AS pos FROM range(200) t(b), range((SELECT count(*) FROM u)) s(j)),
    bs AS (SELECT b, avg(a) AS ma, avg(c) AS mc, avg(a - c) AS delta FROM dr JOIN n USING (pos) GROUP BY b)"""


def _unit_means(spark, d):
    return ev(spark, d).groupBy("unit").agg(F.avg("x").alias("a"), F.avg("k").alias("c"))


@query("MET07_paired_bootstrap", f"WITH {PAIRED} SELECT round(avg(delta), 8) AS mean_delta, round(quantile_cont(delta, 0.025), 8) AS low, round(quantile_cont(delta, 0.975), 8) AS high, round(2 * least(avg(CAST(delta <= 0 AS DOUBLE)), 1 - avg(CAST(delta <= 0 AS DOUBLE))), 8) AS p FROM bs")
def met07(spark, d):
    bs = B.bootstrap(_unit_means(spark, d), "unit", 200, {"delta": F.avg(F.col("a") - F.col("c"))})
    share = F.avg((F.col("delta") <= 0).cast("double"))
    return bs.agg(F.round(F.avg("delta"), 8).alias("mean_delta"), F.round(F.percentile("delta", F.lit(0.025)), 8).alias("low"), F.round(F.percentile("delta", F.lit(0.975)), 8).alias("high"), F.round(2 * F.least(share, 1 - share), 8).alias("p"))


@query("MET08_baseline_choice", "SELECT min_by(p_brand, rank) AS baseline FROM (SELECT p_brand, CASE p_brand WHEN 'Brand#99' THEN 0 WHEN 'Brand#12' THEN 1 WHEN 'Brand#23' THEN 2 ELSE 3 END AS rank FROM part) WHERE rank < 3")
def met08(spark, d):
    order = F.when(F.col("p_brand") == "Brand#99", 0).when(F.col("p_brand") == "Brand#12", 1).when(F.col("p_brand") == "Brand#23", 2)
    return table(spark, d, "part").select("p_brand", order.alias("r")).filter("r is not null").agg(F.min_by("p_brand", "r").alias("baseline"))


@query("MET09_bootstrap_mean", f"WITH {PAIRED}, o AS (SELECT ma, row_number() OVER (ORDER BY ma) - 1 AS pos FROM bs) SELECT round(max(CASE WHEN pos = 5 THEN ma END), 8) AS low, round(max(CASE WHEN pos = 194 THEN ma END), 8) AS high FROM o")
def met09(spark, d):
    bs = B.bootstrap(_unit_means(spark, d), "unit", 200, {"ma": F.avg("a")})
    s = bs.agg(F.sort_array(F.collect_list("ma")).alias("s"))  # one number per replicate
    return s.select(F.round(F.get("s", F.lit(5)), 8).alias("low"), F.round(F.get("s", F.lit(194)), 8).alias("high"))


@query("MET10_mcnemar", f"""WITH {EV}, u AS (SELECT unit, avg(x) > 50 AS a, avg(k) > 50 AS b FROM ev GROUP BY unit), t AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS n10, count(*) FILTER (WHERE b AND NOT a) AS n01 FROM u),
    l AS (SELECT n10, n01, n10 + n01 AS n, least(n10, n01) AS k FROM t) SELECT n10, n01, round(least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2))) FROM range(1000) r(j) WHERE j <= k)), 9) AS p FROM l""")
def met10(spark, d):
    u = ev(spark, d).groupBy("unit").agg((F.avg("x") > 50).alias("a"), (F.avg("k") > 50).alias("b"))
    t = u.agg(F.count_if(F.col("a") & ~F.col("b")).alias("n10"), F.count_if(F.col("b") & ~F.col("a")).alias("n01"))
    return t.select("n10", "n01", F.round(B.sign_test("n10", "n01"), 9).alias("p"))


@query("MET11_difference_bootstrap", f"WITH {PAIRED} SELECT round(median(ma - mc), 8) AS median_delta, CAST(count(*) FILTER (WHERE ma > mc) AS BIGINT) AS wins FROM bs")
def met11(spark, d):
    bs = B.bootstrap(_unit_means(spark, d), "unit", 200, {"ma": F.avg("a"), "mc": F.avg("c")})
    return bs.agg(F.round(F.median(F.col("ma") - F.col("mc")), 8).alias("median_delta"), F.count_if(F.col("ma") > F.col("mc")).alias("wins"))


PERM = "(row_number() OVER (PARTITION BY unit ORDER BY (i * 1103515245 + 12345) % 2147483648, i))"


@query("MET12_permuted_labels", f"WITH {EV}, a AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY i) AS place FROM ev), b AS (SELECT unit, y AS py, {PERM} AS place FROM ev) SELECT a.unit, a.i, b.py AS y FROM a JOIN b ON a.unit = b.unit AND a.place = b.place")
def met12(spark, d):
    return B.permuted(ev(spark, d), "y").select("unit", "i", "y")


@query("MET13_cluster_bootstrap", f"""WITH {EV}, c AS (SELECT unit % 10 AS g, avg(x) AS m, unit FROM ev GROUP BY unit), n AS (SELECT DISTINCT g, dense_rank() OVER (ORDER BY g) - 1 AS pos FROM c),
    dr AS (SELECT b, j, {DRAW} % 10 AS pos FROM range(100) t(b), range(10) s(j)), v AS (SELECT b, m FROM dr JOIN n USING (pos) JOIN c USING (g)),
    o AS (SELECT b, m, row_number() OVER (PARTITION BY b ORDER BY m) AS r, count(*) OVER (PARTITION BY b) AS n FROM v)
    SELECT b, round(avg(m), 8) AS mean, round(avg(m) FILTER (WHERE r > floor(0.2 * n) AND r <= n - floor(0.2 * n)), 8) AS trimmed FROM o GROUP BY b""")
def met13(spark, d):
    c = ev(spark, d).groupBy("unit").agg(F.avg("x").alias("m")).withColumn("g", F.col("unit") % 10)
    v = B.resampled(c, "g", 100)
    return v.groupBy("b").agg(F.round(F.avg("m"), 8).alias("mean"), F.round(B.trimmed_mean(F.sort_array(F.collect_list("m")), 0.2), 8).alias("trimmed"))


@query("MET14_precision_recall", f"WITH {EV}, {CALL.format('ev')} SELECT unit, round(tp::DOUBLE / nullif(tp + fp, 0), 10) AS precision_, round(tp::DOUBLE / nullif(tp + fn, 0), 10) AS recall, round({F1}, 10) AS f1, round({MCC}, 10) AS mcc FROM m")
def met14(spark, d):
    m = R.confusion(called(ev(spark, d)), F.col("called"), "y", ["unit"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return m.select("unit", F.round(R.ratio(tp, tp + fp), 10).alias("precision_"), F.round(R.ratio(tp, tp + fn), 10).alias("recall"), F.round(R.f1(), 10).alias("f1"), F.round(R.mcc(), 10).alias("mcc"))


@query("MET15_sign_span", f"WITH {EV}, s AS (SELECT unit, i, x - 50 AS v, lag(x - 50) OVER (PARTITION BY unit ORDER BY i) AS p FROM ev) SELECT unit, count(*) FILTER (WHERE v > 0) AS n_pos, count(*) FILTER (WHERE v < 0) AS n_neg, count(*) FILTER (WHERE v * p < 0) AS crossings, min(i) FILTER (WHERE v > 0) AS first_pos, max(i) FILTER (WHERE v > 0) AS last_pos FROM s GROUP BY unit")
def met15(spark, d):
    s = ev(spark, d).select("unit", "i", (F.col("x") - 50).alias("v")).withColumn("p", F.lag("v").over(Window.partitionBy("unit").orderBy("i")))
    v = F.col("v")
    return s.groupBy("unit").agg(F.count_if(v > 0).alias("n_pos"), F.count_if(v < 0).alias("n_neg"), F.count_if(v * F.col("p") < 0).alias("crossings"), F.min(F.when(v > 0, F.col("i"))).alias("first_pos"), F.max(F.when(v > 0, F.col("i"))).alias("last_pos"))


@query("MET16_spearman", f"WITH {EV}, r AS (SELECT unit, rank() OVER (PARTITION BY unit ORDER BY x) + (count(*) OVER (PARTITION BY unit, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY unit ORDER BY k) + (count(*) OVER (PARTITION BY unit, k) - 1) / 2.0 AS rk FROM ev) SELECT unit, round(corr(rx, rk), 8) AS rho FROM r GROUP BY unit")
def met16(spark, d):
    r = ev(spark, d).select("unit", W.mid_rank("x").alias("rx"), W.mid_rank("k").alias("rk"))
    return r.groupBy("unit").agg(F.round(F.corr("rx", "rk"), 8).alias("rho"))


@query("MET17_interval_levels", f"WITH {PAIRED}, l AS (SELECT unnest([0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS level) SELECT level, round(CASE WHEN level = 0.9 THEN quantile_cont(ma, 0.05) WHEN level = 0.95 THEN quantile_cont(ma, 0.025) ELSE quantile_cont(ma, 0.005) END, 8) AS low FROM l, bs GROUP BY level")
def met17(spark, d):
    bs = B.bootstrap(_unit_means(spark, d), "unit", 200, {"ma": F.avg("a")})
    q = bs.agg(F.percentile("ma", F.array(F.lit(0.05), F.lit(0.025), F.lit(0.005))).alias("q"))
    return q.select(F.explode(F.arrays_zip(F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99)).alias("level"), F.col("q").alias("low"))).alias("e")).select(F.col("e.level").alias("level"), F.round("e.low", 8).alias("low"))


@query("MET18_tertiles", f"WITH {EV}, u AS (SELECT unit, count(*) AS n FROM ev GROUP BY unit), r AS (SELECT n, row_number() OVER (ORDER BY n, unit) - 1 AS pos, count(*) OVER () AS m FROM u), c AS (SELECT max(CASE WHEN pos = m // 3 THEN n END) AS low_cut, max(CASE WHEN pos = 2 * m // 3 THEN n END) AS high_cut FROM r) SELECT low_cut, high_cut, count(*) FILTER (WHERE n < low_cut) AS n_low, count(*) FILTER (WHERE n >= low_cut AND n < high_cut) AS n_mid, count(*) FILTER (WHERE n >= high_cut) AS n_high FROM u, c GROUP BY ALL")
def met18(spark, d):
    u = ev(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return B.tertiles(u, "n", "unit")


@query("MET19_paired_sign_test", f"WITH {EV}, u AS (SELECT unit, avg(x) - avg(k) AS dl FROM ev GROUP BY unit), t AS (SELECT median(dl) AS med, count(*) FILTER (WHERE dl > 0) AS wins, count(*) FILTER (WHERE dl < 0) AS losses FROM u) SELECT round(med, 8) AS median_delta, wins, losses, round(least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(j + 1) - lgamma(wins + losses - j + 1) - (wins + losses) * ln(2))) FROM range(1000) r(j) WHERE j <= least(wins, losses))), 9) AS p FROM t")
def met19(spark, d):
    u = ev(spark, d).groupBy("unit").agg((F.avg("x") - F.avg("k")).alias("dl"))
    t = u.agg(F.round(F.median("dl"), 8).alias("median_delta"), F.count_if(F.col("dl") > 0).alias("wins"), F.count_if(F.col("dl") < 0).alias("losses"))
    return t.withColumn("p", F.round(B.sign_test("wins", "losses"), 9))


@query("MET20_tail_probability", f"WITH {EV}, p AS (SELECT 0 AS unit, x, CAST(k >= 90 AS INTEGER) AS y FROM ev), {AUC.format('p')} SELECT round(auc, 10) AS p_tail_over_rest FROM auc")
def met20(spark, d):
    p = ev(spark, d).select("i", "x", (F.col("k") >= 90).cast("int").alias("y"))
    return R.pooled_auc(p, "x", "y").select(F.round("auc", 10).alias("p_tail_over_rest"))


SCEN = "sc AS (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS shrink)"


@query("MET21_power_scenarios", f"WITH {EV}, u AS (SELECT unit, avg(x) - 50 AS v FROM ev GROUP BY unit), {SCEN}, s AS (SELECT shrink, v * shrink AS v FROM u, sc), o AS (SELECT *, row_number() OVER (PARTITION BY shrink ORDER BY v) AS r, count(*) OVER (PARTITION BY shrink) AS n FROM s) SELECT shrink, round(avg(v), 8) AS mean, round(median(v), 8) AS median, round(avg(v) FILTER (WHERE r > floor(0.2 * n) AND r <= n - floor(0.2 * n)), 8) AS trimmed, round(avg(CAST(v > 0 AS DOUBLE)), 8) AS win_rate FROM o GROUP BY shrink")
def met21(spark, d):
    u = ev(spark, d).groupBy("unit").agg((F.avg("x") - 50).alias("v"))
    s = u.select(F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).alias("shrink"), "v").withColumn("v", F.col("v") * F.col("shrink"))
    return s.groupBy("shrink").agg(F.round(F.avg("v"), 8).alias("mean"), F.round(F.median("v"), 8).alias("median"), F.round(B.trimmed_mean(F.sort_array(F.collect_list("v")), 0.2), 8).alias("trimmed"), F.round(F.avg((F.col("v") > 0).cast("double")), 8).alias("win_rate"))


@query("MET22_hits_at_radii", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY x DESC, i) AS rank, avg(k) OVER (PARTITION BY unit) AS c FROM ev), h AS (SELECT unnest([2, 5, 10]) AS radius), t AS (SELECT unnest([1, 3, 5]) AS top_k)
    SELECT radius, top_k, count(DISTINCT CASE WHEN abs(k - c) <= radius THEN unit END) AS hits FROM r, h, t WHERE rank <= top_k GROUP BY ALL""")
def met22(spark, d):
    w = Window.partitionBy("unit")
    r = ev(spark, d).withColumns({"rank": F.row_number().over(w.orderBy(F.desc("x"), "i")), "c": F.avg("k").over(w)}).filter("rank <= 5")
    grid = r.select("unit", "rank", F.abs(F.col("k") - F.col("c")).alias("far"), F.explode(F.array(*map(F.lit, (2, 5, 10)))).alias("radius")).withColumn("top_k", F.explode(F.array(*map(F.lit, (1, 3, 5))))).filter("rank <= top_k")
    return grid.groupBy("radius", "top_k").agg(F.count_distinct(F.when(F.col("far") <= F.col("radius"), F.col("unit"))).alias("hits"))


QS = [round(0.05 * k, 2) for k in range(1, 9)]
CURVE = f"""q AS (SELECT unnest([{', '.join(f'{q}::DOUBLE' for q in QS)}]) AS q), rk AS (SELECT unit, i, y, row_number() OVER (PARTITION BY unit ORDER BY x DESC, i) AS rank, count(*) OVER (PARTITION BY unit) AS n FROM ev),
    cf AS (SELECT q, count(*) FILTER (WHERE c AND y = 1) AS tp, count(*) FILTER (WHERE c AND y = 0) AS fp, count(*) FILTER (WHERE NOT c AND y = 1) AS fn, count(*) FILTER (WHERE NOT c AND y = 0) AS tn FROM (SELECT q, y, rank <= greatest(1, round_even(q * n, 0)) AS c FROM rk, q) GROUP BY q)"""


def _curve(spark, d):
    w = Window.partitionBy("unit")
    rk = ev(spark, d).select("unit", "y", F.row_number().over(w.orderBy(F.desc("x"), "i")).alias("rank"), F.count(F.lit(1)).over(w).alias("n"))
    g = rk.withColumn("q", F.explode(F.array(*map(F.lit, QS))))
    return R.confusion(g, F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("q") * F.col("n"))), "y", ["q"])


@query("MET23_pooled_curve", f"WITH {EV}, {CURVE} SELECT q, round({F1}, 10) AS f1, round({MCC}, 10) AS mcc FROM cf")
def met23(spark, d):
    return _curve(spark, d).select("q", F.round(R.f1(), 10).alias("f1"), F.round(R.mcc(), 10).alias("mcc"))


@query("MOD06_operating_point", f"WITH {EV}, {CURVE} SELECT arg_max(q, ({F1}, -q)) AS q, round(max({F1}), 10) AS f1 FROM cf")
def mod06(spark, d):
    c = _curve(spark, d).select("q", R.f1().alias("f1"))
    return c.agg(F.max_by("q", F.struct(F.col("f1"), -F.col("q"))).alias("q"), F.round(F.max("f1"), 10).alias("f1"))


@query("MET24_pairwise_auc", f"WITH {EV} SELECT a.unit, round(avg(CASE WHEN a.x > b.x THEN 1.0::DOUBLE WHEN a.x = b.x THEN 0.5 ELSE 0 END), 10) AS auc FROM ev a JOIN ev b ON a.unit = b.unit AND a.y = 1 AND b.y = 0 GROUP BY a.unit")
def met24(spark, d):
    return R.auc(ev(spark, d), "x", "y").filter("auc is not null").select("unit", F.round("auc", 10).alias("auc"))


@query("MET25_verdict_by_seed", f"""WITH {EV}, u AS (SELECT unit, avg(x) - avg(k) AS dl FROM ev GROUP BY unit), n AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS pos FROM u), s AS (SELECT sd FROM range(5) t(sd)),
    dr AS (SELECT sd, b, j, {DRAW.replace('CAST(b AS BIGINT)', 'CAST(b + 1000 * sd AS BIGINT)')} % (SELECT count(*) FROM u) AS pos FROM s, range(40) t(b), range((SELECT count(*) FROM u)) q(j)), bs AS (SELECT sd, b, avg(dl) AS m FROM dr JOIN n USING (pos) GROUP BY ALL),
    i AS (SELECT sd, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bs GROUP BY sd) SELECT count(*) FILTER (WHERE low > 0 OR high < 0) AS n_clear, round(min(low), 8) AS min_low, round(max(high), 8) AS max_high, CASE WHEN count(*) FILTER (WHERE low > 0 OR high < 0) = count(*) THEN 'always' WHEN count(*) FILTER (WHERE low > 0 OR high < 0) = 0 THEN 'never' ELSE 'sometimes' END AS verdict FROM i""")
def met25(spark, d):
    u = ev(spark, d).groupBy("unit").agg((F.avg("x") - F.avg("k")).alias("dl"))
    bs = B.bootstrap(u, "unit", 40, {"m": F.avg("dl")}, seeds=5)
    i = bs.groupBy("seed").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    clear = F.count_if((F.col("low") > 0) | (F.col("high") < 0))
    return i.agg(clear.alias("n_clear"), F.round(F.min("low"), 8).alias("min_low"), F.round(F.max("high"), 8).alias("max_high"), F.when(clear == F.count(F.lit(1)), "always").when(clear == 0, "never").otherwise("sometimes").alias("verdict"))


@query("MET26_difficulty", f"WITH {EV}, u AS (SELECT unit, count(*) AS n, sum(y) AS p FROM ev GROUP BY unit) SELECT median(n) AS median_n, round(avg(n), 8) AS mean_n, median(p) AS median_p, round(median(p::DOUBLE / n), 8) AS median_rate, round(avg(CAST(p < 10 AS DOUBLE)), 8) AS share_under_10, round(avg(CAST(p > 22 AS DOUBLE)), 8) AS share_over_22 FROM u")
def met26(spark, d):
    u = ev(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    return u.agg(F.median("n").alias("median_n"), F.round(F.avg("n"), 8).alias("mean_n"), F.median("p").alias("median_p"), F.round(F.median(F.col("p") / F.col("n")), 8).alias("median_rate"), F.round(F.avg((F.col("p") < 10).cast("double")), 8).alias("share_under_10"), F.round(F.avg((F.col("p") > 22).cast("double")), 8).alias("share_over_22"))


@query("MET27_covariates", f"WITH {EV}, u AS (SELECT unit, avg(x) - avg(k) AS dl, count(*) AS n, avg(y) AS rate FROM ev GROUP BY unit) SELECT CASE WHEN n < 60 THEN 'short' WHEN n < 70 THEN 'middle' ELSE 'long' END AS bin, round(avg(dl), 8) AS mean_delta, round(corr(dl, n), 7) AS r_n, round(corr(dl, rate), 7) AS r_rate FROM u GROUP BY bin")
def met27(spark, d):
    u = ev(spark, d).groupBy("unit").agg((F.avg("x") - F.avg("k")).alias("dl"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    b = F.when(F.col("n") < 60, "short").when(F.col("n") < 70, "middle").otherwise("long")
    return u.groupBy(b.alias("bin")).agg(F.round(F.avg("dl"), 8).alias("mean_delta"), F.round(F.corr("dl", "n"), 7).alias("r_n"), F.round(F.corr("dl", "rate"), 7).alias("r_rate"))


@query("MET28_reproduction", "SELECT count(*) AS n, abs(avg(o_totalprice) - (SELECT sum(o_totalprice) / count(*) FROM orders)) <= 1e-6 AS agrees FROM orders")
def met28(spark, d):
    o = table(spark, d, "orders")
    whole = o.agg((F.sum("o_totalprice") / F.count(F.lit(1))).alias("m"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("a")).join(whole, F.lit(True)).select("n", (F.abs(F.col("a") - F.col("m")) <= 1e-6).alias("agrees"))


ARMS = f"{EV}, a AS (SELECT unit, event_type AS arm, round(avg(x), 9) AS auc FROM ev GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY auc DESC, arm) AS rank FROM a)"


def _arms(spark, d):
    a = ev(spark, d).groupBy("unit", F.col("event_type").alias("arm")).agg(F.round(F.avg("x"), 9).alias("auc"))
    return a.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("auc"), "arm")))


@query("AGG23_arm_summary", f"WITH {ARMS} SELECT arm, round(avg(auc), 8) AS mean, round(stddev_samp(auc), 8) AS sd, min(auc) AS low, max(auc) AS high, round(avg(rank), 8) AS mean_rank, max(rank) AS worst_rank, count(*) FILTER (WHERE rank = 1) AS firsts FROM rk GROUP BY arm")
def agg23(spark, d):
    return _arms(spark, d).groupBy("arm").agg(F.round(F.avg("auc"), 8).alias("mean"), F.round(F.stddev_samp("auc"), 8).alias("sd"), F.min("auc").alias("low"), F.max("auc").alias("high"), F.round(F.avg("rank"), 8).alias("mean_rank"), F.max("rank").cast("long").alias("worst_rank"), F.count_if(F.col("rank") == 1).alias("firsts"))


@query("MET29_chosen_margin", f"WITH {ARMS}, b AS (SELECT unit, max(auc) FILTER (WHERE arm = 'view') AS own, max(auc) FILTER (WHERE arm <> 'view') AS rival FROM rk GROUP BY unit) SELECT round(avg(own - rival), 8) AS mean_margin, round(min(own - rival), 8) AS worst_margin, count(*) FILTER (WHERE own > rival) AS wins FROM b")
def met29(spark, d):
    v = F.col("arm") == "view"
    b = _arms(spark, d).groupBy("unit").agg(F.max(F.when(v, F.col("auc"))).alias("own"), F.max(F.when(~v, F.col("auc"))).alias("rival"))
    m = F.col("own") - F.col("rival")
    return b.agg(F.round(F.avg(m), 8).alias("mean_margin"), F.round(F.min(m), 8).alias("worst_margin"), F.count_if(m > 0).alias("wins"))


@query("MET30_trimmed_means", f"WITH {EV}, o AS (SELECT unit, x, row_number() OVER (PARTITION BY unit ORDER BY x) AS r, count(*) OVER (PARTITION BY unit) AS n FROM ev) SELECT unit, round(avg(x) FILTER (WHERE r > round_even(0.1::DOUBLE * n, 0) AND r <= n - round_even(0.1::DOUBLE * n, 0)), 8) AS rounded, round(avg(x) FILTER (WHERE r > floor(0.1::DOUBLE * n) AND r <= n - floor(0.1::DOUBLE * n)), 8) AS truncated FROM o GROUP BY unit")
def met30(spark, d):
    s = F.sort_array(F.collect_list("x"))
    return ev(spark, d).groupBy("unit").agg(F.round(B.trimmed_mean(s, 0.1, rounded=True), 8).alias("rounded"), F.round(B.trimmed_mean(s, 0.1), 8).alias("truncated"))


A, BSET = "(SELECT unit, list(DISTINCT k) AS s FROM ev WHERE x >= 60 GROUP BY unit)", "(SELECT unit, list(DISTINCT k) AS s FROM ev WHERE y = 1 GROUP BY unit)"


@query("SET01_set_overlap", f"WITH {EV}, p AS (SELECT a.unit, len(a.s) AS n_a, len(b.s) AS n_b, len(list_intersect(a.s, b.s)) AS n_ab FROM {A} a JOIN {BSET} b USING (unit)) SELECT unit, n_ab / n_a::DOUBLE AS precision_, n_ab / n_b::DOUBLE AS recall, 2 * n_ab / (n_a + n_b)::DOUBLE AS f1 FROM p")
def set01(spark, d):
    s = ev(spark, d).groupBy("unit").agg(F.collect_set(F.when(F.col("x") >= 60, F.col("k"))).alias("a"), F.collect_set(F.when(F.col("y") == 1, F.col("k"))).alias("b"))
    n = F.size(F.array_intersect("a", "b")).cast("double")
    return s.filter((F.size("a") > 0) & (F.size("b") > 0)).select("unit", (n / F.size("a")).alias("precision_"), (n / F.size("b")).alias("recall"), (2 * n / (F.size("a") + F.size("b"))).alias("f1"))


@query("SET02_intersection", "SELECT o_custkey AS unit FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set02(spark, d):
    o = table(spark, d, "orders")
    of = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("unit"))
    return of("F").intersect(of("O"))


@query("SET03_replaced_rows", f"WITH {EV}, new AS (SELECT unit, event_type, count(*) AS n FROM ev WHERE event_type IN ('click', 'view') AND x > 10 GROUP BY ALL), old AS (SELECT unit, event_type, count(*) AS n FROM ev GROUP BY ALL) SELECT * FROM old WHERE event_type NOT IN (SELECT event_type FROM new) UNION ALL SELECT * FROM new")
def set03(spark, d):
    e = ev(spark, d)
    counted = lambda x: x.groupBy("unit", "event_type").agg(F.count(F.lit(1)).alias("n"))
    new = counted(e.filter(F.col("event_type").isin("click", "view") & (F.col("x") > 10)))
    return counted(e).join(new.select("event_type").distinct(), "event_type", "left_anti").select("unit", "event_type", "n").unionByName(new)


@query("SET04_keyed_agreement", f"WITH {ORD}, a AS (SELECT * FROM od WHERE i % 7 <> 0), b AS (SELECT unit, i, x + (i % 3) * 0.5 AS x FROM od WHERE i % 5 <> 0) SELECT count(*) FILTER (WHERE b.i IS NULL) AS only_left, count(*) FILTER (WHERE a.i IS NULL) AS only_right, round(max(abs(a.x - b.x)), 6) AS worst FROM a FULL OUTER JOIN b ON a.i = b.i")
def set04(spark, d):
    o = orders(spark, d)
    a, b = o.filter("i % 7 <> 0").select("i", "x"), o.filter("i % 5 <> 0").select(F.col("i").alias("j"), (F.col("x") + (F.col("i") % 3) * 0.5).alias("z"))
    j = a.join(b, F.col("i") == F.col("j"), "full_outer")
    return j.agg(F.count_if(F.col("j").isNull()).alias("only_left"), F.count_if(F.col("i").isNull()).alias("only_right"), F.round(F.max(F.abs(F.col("x") - F.col("z"))), 6).alias("worst"))


@query("SET05_shifted_union", "SELECT 0 AS bank, n_nationkey AS a, n_regionkey AS b FROM nation UNION ALL SELECT 1, n_nationkey + 25, n_regionkey + 25 FROM nation")
def set05(spark, d):
    n = table(spark, d, "nation")
    shift = lambda k: n.select(F.lit(k).alias("bank"), (F.col("n_nationkey") + 25 * k).alias("a"), (F.col("n_regionkey") + 25 * k).alias("b"))
    return shift(0).unionByName(shift(1))


@query("SET06_missed_by_both", f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY x DESC, i) <= 10 AS a, row_number() OVER (PARTITION BY unit ORDER BY k DESC, i) <= 10 AS b FROM ev) SELECT unit, i FROM r WHERE y = 1 AND NOT a AND NOT b")
def set06(spark, d):
    w = Window.partitionBy("unit")
    r = ev(spark, d).withColumns({"a": F.row_number().over(w.orderBy(F.desc("x"), "i")) <= 10, "b": F.row_number().over(w.orderBy(F.desc("k"), "i")) <= 10})
    return r.filter((F.col("y") == 1) & ~F.col("a") & ~F.col("b")).select("unit", "i")


@query("SET07_pool_minus_spent", "SELECT c_custkey AS unit FROM customer WHERE c_nationkey NOT IN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey % 7 = 0) EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def set07(spark, d):
    c, s, o = (table(spark, d, t) for t in ("customer", "supplier", "orders"))
    spent = s.filter("s_suppkey % 7 = 0").select("s_nationkey").distinct()
    return c.join(spent, c.c_nationkey == spent.s_nationkey, "left_anti").select(F.col("c_custkey").alias("unit")).subtract(o.filter("o_orderkey % 3 = 0").select("o_custkey"))


@query("SET08_same_number", "WITH a AS (SELECT o_orderkey, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey), b AS (SELECT l_orderkey AS o_orderkey, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n, count(*) FILTER (WHERE abs(a.v - b.v) <= 0.011) AS agree FROM a JOIN b USING (o_orderkey)")
def set08(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey")
    s = F.round(F.sum("l_extendedprice"), 2)
    a = li.join(o, li.l_orderkey == o.o_orderkey, "left_semi").groupBy("l_orderkey").agg(s.alias("va"))
    b = li.groupBy(F.col("l_orderkey").alias("k")).agg(s.alias("vb"))
    return a.join(b, F.col("l_orderkey") == F.col("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("va") - F.col("vb")) <= 0.011).alias("agree"))
