"""Codes, bands, intervals and small fixed tables as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def code_of(c: str, names: Sequence[str]) -> Column:
    """Place in names, from 0; -1 if absent."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)) - 1, F.lit(-1)).cast("int")


def band_of(x: str, edges: Sequence[float]) -> Column:
    """How many of the ascending edges x reaches."""
    return sum(((F.col(x) >= e).cast("int") for e in edges), F.lit(0))


def residue_number(c: str | Column) -> Column:
    """The last run of digits with a minus sign right before it; null without digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c, r"(-?\d+)[^0-9]*$", 1), F.lit("")).try_cast("int")


def wilson(k: str, n: str, z: float) -> tuple[Column, Column]:
    """Score interval of a proportion; null for n = 0."""
    m = F.nullif(F.col(n).cast("double"), F.lit(0.0))
    p = F.col(k) / m
    mid, half, size = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)), 1 + z * z / m
    return (mid - half) / size, (mid + half) / size


def crystal_system() -> Column:
    """From columns a, b, c, alpha, beta, gamma."""
    a, b, c, al, be, ga = map(F.col, ("a", "b", "c", "alpha", "beta", "gamma"))
    same = lambda x, y: F.abs(x - y) <= 1e-3
    right = lambda *xs: sum((F.when(F.abs(x - 90) <= 1e-3, 1).otherwise(0) for x in xs), F.lit(0))
    return (
        F.when((right(al, be, ga) == 3) & same(a, b) & same(b, c), "cubic")
        .when((right(al, be, ga) == 3) & same(a, b), "tetragonal")
        .when(right(al, be, ga) == 3, "orthorhombic")
        .when((right(al, be) == 2) & (F.abs(ga - 120) <= 1e-3) & same(a, b), "hexagonal")
        .when(right(al, ga) == 2, "monoclinic")
        .otherwise("triclinic")
    )


def rotation_order(trace: str) -> Column:
    """Order of a crystallographic rotation by the trace of its integer matrix."""
    return F.when(F.col(trace) == 3, 1).when(F.col(trace) == -1, 2).when(F.col(trace) == 0, 3).when(F.col(trace) == 1, 4).when(F.col(trace) == 2, 6)


def gf4_times(a: str, b: str) -> Column:
    """Product in the field of four elements 0, 1, w, w + 1: exponents of w add modulo 3."""
    x, y = F.col(a), F.col(b)
    return F.when((x == 0) | (y == 0), 0).otherwise((x + y - 2) % 3 + 1).cast("int")


def sphere_directions(spark: SparkSession, n: int) -> DataFrame:
    """n directions spread over the sphere by the golden ratio: k, x, y, z."""
    k = F.col("id") + 0.5
    tilt, turn = F.acos(1 - 2 * k / n), F.pi() * (1 + F.sqrt(F.lit(5.0))) * k
    return spark.range(n).select(F.col("id").cast("int").alias("k"), (F.sin(tilt) * F.cos(turn)).alias("x"), (F.sin(tilt) * F.sin(turn)).alias("y"), (1 - 2 * k / n).alias("z"))


def sequence_of(order: str, letter: Column) -> Column:
    """Letters of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), letter.alias("c")))), lambda s: s["c"]), "")
