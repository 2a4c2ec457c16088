"""Top-q calls, top-k per group, greedy suppression and the metrics of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.windows import mid_rank, unit_size
from tessera.session import stored


def top_share(score: str, q: float, unit: str = "unit", order: str = "i") -> Column:
    """The share q of the unit's rows with the highest scores (at least one; halves round to even; ties by index)."""
    k = F.greatest(F.lit(1), F.bround(F.lit(q) * unit_size(unit)))
    return F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(score), order)) <= k


def top_rows(df: DataFrame, order: list, k: int, keys: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def suppress(df: DataFrame, score: str, xyz: tuple[str, str, str], apart: float, k: int, unit: str = "unit", order: str = "i") -> DataFrame:
    """Greedy suppression: by descending score, keep a point at least `apart` from all kept, up to k per unit.

    Points are stored first, since each of k rounds reads them: the best of each unit that is far from those kept
    joins them. A round is a grouped maximum, so a unit of any size spreads over
    tasks; the kept ones, k per unit at most, are all that meets the points again.
    """
    point = F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"), F.col(order).alias("i"), F.array(*xyz).alias("p"))
    points = stored(df.select(unit, point.alias("c")), "points")
    kept = points.groupBy(unit).agg(F.array(F.max("c")).alias("kept"))
    far = lambda a, b: F.sqrt(sum((F.pow(F.get(a["p"], F.lit(j)) - F.get(b["p"], F.lit(j)), F.lit(2.0)) for j in range(3)), F.lit(0.0))) >= apart
    for _ in range(k - 1):
        far_from_all = F.forall("kept", lambda o: far(o, F.col("c")))
        best = points.join(kept, unit).groupBy(unit).agg(F.any_value("kept").alias("kept"), F.max(F.when(far_from_all, F.col("c"))).alias("b"))
        kept = best.select(unit, F.when(F.col("b").isNull(), F.col("kept")).otherwise(F.array_append("kept", F.col("b"))).alias("kept"))
    out = kept.select(unit, F.posexplode("kept").alias("place", "c"))
    return out.select(unit, (F.col("place") + 1).cast("int").alias("place"), F.col("c.i").alias(order), F.col("c.s").alias("score"))


def auc(df: DataFrame, score: str, y: str, unit: str = "unit") -> DataFrame:
    """Tie-aware ROC-AUC per unit; null with one class."""
    r = df.select(unit, y, (mid_rank(score, unit) + 1).alias("_r"))
    g = r.groupBy(unit).agg(F.sum(F.col("_r") * F.col(y)).alias("_s"), F.sum(y).alias("_p"), F.count(F.lit(1)).alias("_n"))
    p, n = F.col("_p"), F.col("_n")
    return g.select(unit, ((F.col("_s") - p * (p + 1) / 2) / F.nullif((p * (n - p)).cast("double"), F.lit(0.0))).alias("auc"))


def average_precision(df: DataFrame, score: str, y: str, unit: str = "unit", order: str = "i") -> DataFrame:
    w = Window.partitionBy(unit).orderBy(F.desc(score), order)
    r = df.select(unit, y, F.sum(y).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"), F.row_number().over(w).alias("_n"))
    return r.groupBy(unit).agg((F.sum(F.when(F.col(y) == 1, F.col("_c") / F.col("_n"))) / F.nullif(F.sum(y).cast("double"), F.lit(0.0))).alias("ap"))


def confusion(df: DataFrame, call: Column, y: str, keys: list[str]) -> DataFrame:
    pos = F.col(y) == 1
    return df.groupBy(*keys).agg(F.count_if(call & pos).alias("tp"), F.count_if(call & ~pos).alias("fp"), F.count_if(~call & pos).alias("fn"), F.count_if(~call & ~pos).alias("tn"))


def mcc(tp="tp", fp="fp", fn="fn", tn="tn") -> Column:
    a, b, c, d = (F.col(x).cast("double") for x in (tp, fp, fn, tn))
    return (a * d - b * c) / F.nullif(F.sqrt((a + b) * (a + c) * (d + b) * (d + c)), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    a, b, c = (F.col(x) for x in (tp, fp, fn))
    return ratio(2 * a, 2 * a + b + c)


def pooled_auc(df: DataFrame, score: str, y: str, ties: bool = True, order: str = "i") -> DataFrame:
    """ROC-AUC over all rows at once: one row.

    Rows shrink to counts per distinct score before any order is made; the
    running count over scores goes by ranges of scores, each summed in its own
    task, with one offset per range. ties=False ranks equal scores by index,
    for which rows must stay single.
    """
    keys = [score] if ties else [score, order]
    g = df.groupBy(*keys).agg(F.sum(y).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    from tessera.operators.ordered import running

    r = running(g, keys, {"n": "before"})
    rank = F.col("before") - F.col("n") + (F.col("n") + 1) / 2
    s = r.agg(F.sum(rank * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n = F.col("p"), F.col("n")
    return s.select(((F.col("s") - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0.0))).alias("auc"))
