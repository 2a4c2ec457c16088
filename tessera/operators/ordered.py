"""Running sums over a whole table's order without bringing it to one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored


def running(df: DataFrame, keys: list, sums: dict[str, str]) -> DataFrame:
    """df with running sums (own row included) in the order of keys. sums: column -> name of its running sum.

    Rows are dealt to ranges of the order and stored there; each range sums
    by itself, and starts at the total of the ranges before it, one number
    per range.
    """
    dealt = stored(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    own = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(offsets, "_range")
    return out.withColumns({name: F.col(f"_o_{c}") + F.sum(c).over(own) for c, name in sums.items()}).drop("_range", *[f"_o_{c}" for c in sums])


def placed(df: DataFrame, keys: list, name: str) -> DataFrame:
    """df with each row's place in the order of keys, from 0, by ranges of that order."""
    rows = running(df.withColumn("_one", F.lit(1).cast("long")), keys, {"_one": name})
    return rows.withColumn(name, F.col(name) - 1).drop("_one")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact quantiles of a whole column, between two values in proportion; nulls don't count. Empty without values.

    Rows shrink to counts per value first; values are added up by ranges of their
    order, so no task and no state holds them all.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    at = stored(running(counts, ["v"], {"n": "upto"}), "quantiles")
    total = at.agg(F.max("upto")).first()[0]
    if total is None:
        return []
    spots = [share * (total - 1) for share in shares]
    value = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    found = at.agg(*[value(k) for spot in spots for k in (math.floor(spot), math.ceil(spot))]).first()
    return [low + (high - low) * (spot - math.floor(spot)) for spot, low, high in zip(spots, found[::2], found[1::2], strict=True)]
