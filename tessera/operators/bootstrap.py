"""Bootstraps, permutations and exact tests from reproducible draws.

Draws are a linear congruential function of (replicate, draw), so any engine
gets the same resamples, and no generator state lives on an executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

A, C, M = 1103515245, 12345, 2147483648


def draw(b: Column, j: Column) -> Column:
    """A number from 0 to M - 1 for draw j of replicate b."""
    return F.pmod(F.pmod(b.cast("long") * A + j.cast("long") * C + 7919, F.lit(M)) * A + C, F.lit(M))


def resampled(members: DataFrame, key: str, replicates: int, seeds: int = 1) -> DataFrame:
    """members of drawn keys, once per draw, with b (and seed). As many draws per replicate as there are keys.

    The numbered keys are one row per unit; draws are made where they are
    joined, replicate by replicate, never as one array.
    """
    keys = members.select(key).distinct().withColumn("_at", F.row_number().over(Window.orderBy(key)) - 1)
    n = keys.count()
    spark = members.sparkSession
    grid = spark.range(seeds * replicates * n).select(F.floor(F.col("id") / (replicates * n)).cast("long").alias("seed"), F.pmod(F.floor(F.col("id") / n), F.lit(replicates)).cast("long").alias("b"), F.pmod(F.col("id"), F.lit(max(n, 1))).cast("long").alias("j"))
    drawn = grid.withColumn("_at", F.pmod(draw(F.col("b") + 1000 * F.col("seed"), F.col("j")), F.lit(max(n, 1))))
    out = drawn.join(keys, "_at").join(members, key).drop("_at", "j")
    return out if seeds > 1 else out.drop("seed")


def bootstrap(members: DataFrame, key: str, replicates: int, stats: dict[str, Column], seeds: int = 1) -> DataFrame:
    """One row per replicate with each statistic over the drawn members; all statistics share the draws."""
    by = ["b"] + (["seed"] if seeds > 1 else [])
    return resampled(members, key, replicates, seeds).groupBy(*by).agg(*[c.alias(k) for k, c in stats.items()])


def permuted(df: DataFrame, column: str, unit: str = "unit", order: str = "i") -> DataFrame:
    """df with one column's values dealt anew within each unit, in the order of a fixed hash of the index."""
    w = Window.partitionBy(unit)
    own = df.withColumn("_place", F.row_number().over(w.orderBy(order)))
    dealt = df.select(F.col(unit).alias("_unit"), F.col(column).alias("_value"), F.row_number().over(w.orderBy(F.pmod(F.col(order) * A + C, F.lit(M)), order)).alias("_to"))
    return own.join(dealt, (F.col(unit) == F.col("_unit")) & (F.col("_place") == F.col("_to"))).withColumn(column, F.col("_value")).drop("_place", "_unit", "_value", "_to")


def sign_test(wins: str, losses: str) -> Column:
    """Exact two-sided p of a fair coin, from logarithms of binomial terms."""
    n, k = (F.col(wins) + F.col(losses)).cast("double"), F.least(F.col(wins), F.col(losses))
    # ln C(n, j) as a running sum of ln((n - j + 1) / j)
    step = lambda acc, j: F.struct((acc["l"] + F.log((n - j + 1) / j)).alias("l"), (acc["s"] + F.exp(acc["l"] + F.log((n - j + 1) / j) - n * F.log(F.lit(2.0)))).alias("s"))
    first = F.exp(-n * F.log(F.lit(2.0)))
    terms = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), 2 * F.aggregate(terms, F.struct(F.lit(0.0).alias("l"), first.alias("s")), step)["s"])


def trimmed_mean(ascending: Column, share: float, rounded: bool = False) -> Column:
    """Mean of a sorted array without `share` of it at each end; null if nothing is left."""
    n = F.size(ascending)
    k = (F.bround(share * n) if rounded else F.floor(share * n)).cast("int")
    kept = F.slice(ascending, k + 1, F.greatest(n - 2 * k, F.lit(0)))
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(kept).cast("double"), F.lit(0.0))


def tertiles(df: DataFrame, x: str, key: str) -> DataFrame:
    """Cut points at a third and two thirds of the order, and the group sizes. df: one row per unit."""
    from tessera.operators.ordered import placed

    n = df.count()
    r = placed(df, [x, key], "_r")
    cuts = r.agg(F.max(F.when(F.col("_r") == n // 3, F.col(x))).alias("low_cut"), F.max(F.when(F.col("_r") == 2 * n // 3, F.col(x))).alias("high_cut"))
    j = df.join(cuts, F.lit(True))
    v, a, b = F.col(x), F.col("low_cut"), F.col("high_cut")
    return j.groupBy("low_cut", "high_cut").agg(F.count_if(v < a).alias("n_low"), F.count_if((v >= a) & (v < b)).alias("n_mid"), F.count_if(v >= b).alias("n_high"))
