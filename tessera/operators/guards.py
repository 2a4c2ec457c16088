"""Contracts around predictors and validators, at the level of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Predictor = Callable[[DataFrame], DataFrame]
PREDICTORS: dict[str, Predictor] = {}


def predictor(name: str) -> Callable[[Predictor], Predictor]:
    """Registers a predictor: rows of units in, rows with unit and its own columns out."""

    def add(f: Predictor) -> Predictor:
        PREDICTORS[name] = f
        return f

    return add


def guarded(predict: Predictor, offending: Callable[[DataFrame], DataFrame], unit: str = "unit") -> Predictor:
    """predict on clean units only; units that `offending` names (unit, reasons) come back as CRASH rows with their reasons."""

    def run(df: DataFrame) -> DataFrame:
        bad = offending(df)
        good = predict(df.join(bad.select(unit), unit, "left_anti")).withColumn("status", F.lit("OK"))
        crashed = bad.select(unit, F.lit("CRASH").alias("status"), "reasons")
        return good.unionByName(crashed, allowMissingColumns=True)

    return run


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule, broken: how many rows break each rule, in one pass."""
    counts = df.agg(*[F.count_if(~F.expr(r)).alias(k) for k, r in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("broken")) for k in rules])))
