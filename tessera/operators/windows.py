"""Ranks, quantised digits, runs, lags and scalings within units.

A unit is a bounded group (a chain, a user); windows partition by it. Order
within a unit ends in its row index, so that ties never depend on the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mid_rank(x: str, unit: str = "unit") -> Column:
    """0-based rank with ties shared."""
    return F.rank().over(Window.partitionBy(unit).orderBy(x)) - 1 + (F.count(F.lit(1)).over(Window.partitionBy(unit, x)) - 1) / 2


def unit_size(unit: str = "unit") -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(unit))


def normal_rank(x: str, unit: str = "unit") -> Column:
    """Mid-rank over n - 1, in [0, 1]."""
    return mid_rank(x, unit) / F.greatest(unit_size(unit) - 1, F.lit(1))


def quartile_digit(x: str, unit: str = "unit", levels: int = 4) -> Column:
    return F.least(F.lit(levels - 1), F.floor(normal_rank(x, unit) * levels)).cast("int")


def cut_digit(x: str, unit: str = "unit", cuts: Sequence[float] = (0.25, 0.5, 0.75)) -> Column:
    """How many of the unit's quantiles lie strictly below x."""
    q = F.percentile(x, F.array(*map(F.lit, cuts))).over(Window.partitionBy(unit))
    return F.size(F.filter(q, lambda c: c < F.col(x)))


def rank_band(x: str, cuts: Sequence[float], unit: str = "unit") -> Column:
    """How many of the given cut points the normal rank reaches."""
    r = normal_rank(x, unit)
    return sum(((F.lit(c) <= r).cast("int") for c in cuts), F.lit(0))


def permille(x: str, unit: str = "unit") -> Column:
    return F.when(unit_size(unit) == 1, 500.0).otherwise(1000 * normal_rank(x, unit))


def robust_z(df: DataFrame, x: str, out: str, unit: str = "unit", clip: float = 8.0) -> DataFrame:
    """(x - median) / MAD, clipped, in hundredths; 0 where MAD is 0."""
    w = Window.partitionBy(unit)
    df = df.withColumn("_m", F.median(x).over(w)).withColumn("_d", F.median(F.abs(F.col(x) - F.col("_m"))).over(w))
    z = 100 * F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(x) - F.col("_m")) / F.nullif(F.col("_d"), F.lit(0.0))))
    return df.withColumn(out, F.coalesce(z, F.lit(0.0))).drop("_m", "_d")


def runs(df: DataFrame, flag: str, unit: str = "unit", order: str = "i") -> DataFrame:
    """run_length and run_offset (from 0) of runs of true flags; 0 and null outside."""
    w = Window.partitionBy(unit).orderBy(order)
    df = df.withColumn("_g", F.row_number().over(w) - F.row_number().over(Window.partitionBy(unit, flag).orderBy(order)))
    run = Window.partitionBy(unit, flag, "_g")
    on = F.col(flag)
    return df.withColumns({"run_length": F.when(on, F.count(F.lit(1)).over(run)).otherwise(0), "run_offset": F.when(on, F.row_number().over(run.orderBy(order)) - 1)}).drop("_g")


def segments(df: DataFrame, linked: Column, out: str = "seg", unit: str = "unit", order: str = "i") -> DataFrame:
    """A number that grows at each row not linked to the one before."""
    w = Window.partitionBy(unit).orderBy(order)
    broken = F.when(F.row_number().over(w) == 1, 0).when(linked, 0).otherwise(1)
    return df.withColumn("_b", broken).withColumn(out, F.sum("_b").over(w)).drop("_b")


def shifted(x: str, k: int, fill, keys: Sequence[str] = ("unit", "seg"), order: str = "i") -> Column:
    w = Window.partitionBy(*keys).orderBy(order)
    return F.lag(x, k, fill).over(w) if k >= 0 else F.lead(x, -k, fill).over(w)


def ordinal_rank(x: str, unit: str = "unit", order: str = "i") -> Column:
    """1-based, ties by the row index."""
    return F.row_number().over(Window.partitionBy(unit).orderBy(x, order))


def number_lags(df: DataFrame, x: str, lags: Sequence[int], unit: str = "unit", number: str = "i") -> DataFrame:
    """Mean of |x - x at number +- k| over the sides that exist, one column per lag; gaps in numbers stay gaps.

    Each side is a range frame of one number, so a row is shuffled once, however many lags there are.
    """
    rows = df.groupBy(unit, number).agg(F.collect_list(F.col(x).cast("double")).alias("_x"))
    w = Window.partitionBy(unit).orderBy(number)
    at = lambda k: F.coalesce(F.first("_x").over(w.rangeBetween(k, k)), F.array().cast("array<double>"))
    rows = rows.select(unit, number, "_x", *[at(s * k).alias(f"_{s * k}") for k in lags for s in (-1, 1)])
    known = F.col(unit).isNotNull() & F.col(number).isNotNull()

    def mean(k: int) -> Column:
        off = F.flatten(F.transform("_x", lambda v: F.transform(F.concat(f"_{-k}", f"_{k}"), lambda o: F.abs(v - o))))
        return F.when(known & (F.size(off) > 0), F.aggregate(off, F.lit(0.0), lambda t, v: t + v) / F.size(off))

    return rows.select(unit, number, *[mean(k).alias(f"lag{k}") for k in lags])


def centred(f, x: str, half: int, unit: str = "unit", order: str = "i") -> Column:
    return f(x).over(Window.partitionBy(unit).orderBy(order).rowsBetween(-half, half))


def z_score(x: str, unit: str = "unit") -> Column:
    w = Window.partitionBy(unit)
    return F.coalesce((F.col(x) - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0)), F.lit(0.0))


def gate(s: str, g: str, weight: float, unit: str = "unit") -> Column:
    """s + weight * g, g brought to the spread of s within the unit; s alone where g has none."""
    w = Window.partitionBy(unit)
    return F.coalesce(F.col(s) + weight * F.col(g) * (F.stddev_pop(s).over(w) / F.nullif(F.stddev_pop(g).over(w), F.lit(0.0))), F.col(s))


def peak_scaled(x: str, unit: str = "unit") -> Column:
    return F.coalesce(F.col(x) / F.nullif(F.max(F.abs(x)).over(Window.partitionBy(unit)), F.lit(0.0)), F.lit(0.0))


def equal_bands(df: DataFrame, x: str, bands: int, out: str = "band", key: str = "unit") -> DataFrame:
    """Bands of equal count over units by size: edges are whole parts of an even division. df: one row per unit."""
    from tessera.operators.ordered import placed

    n = df.count()
    edges = [int(k * n / bands) for k in range(1, bands)]
    return placed(df, [x, key], "_at").withColumn(out, sum(((F.col("_at") >= e).cast("int") for e in edges), F.lit(0))).drop("_at")
