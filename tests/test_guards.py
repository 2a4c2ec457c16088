from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.graph import spectra
from tessera.operators.guards import PREDICTORS, guarded, predictor, violations


def test_guard_keeps_offending_units_out(spark):
    df = spark.createDataFrame([(1, "GLY"), (1, "ALA"), (2, "GLY"), (2, "LIG"), (3, "XYZ")], "unit int, name string")

    @predictor("count")
    def count(x):
        return x.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))

    bad = lambda x: x.filter(~F.col("name").isin("GLY", "ALA")).groupBy("unit").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("reasons"))
    got = {(r["unit"], r["status"], r["n"], r["reasons"]) for r in guarded(PREDICTORS["count"], bad)(df).collect()}
    assert got == {(1, "OK", 2, None), (2, "CRASH", None, "LIG"), (3, "CRASH", None, "XYZ")}


def test_violations(spark):
    df = spark.range(10)
    assert {(r["rule"], r["broken"]) for r in violations(df, {"small": "id < 7", "any": "id >= 0"}).collect()} == {("small", 3), ("any", 0)}


def test_spectral_columns_do_not_depend_on_signs_or_order(spark):
    r = np.random.default_rng(0)
    e = {(int(a), int(b)) for a, b in r.integers(0, 14, (40, 2)) if a != b}
    e = sorted(e | {(b, a) for a, b in e})
    rows = lambda m: [(0, m[a], m[b]) for a, b in e]
    swap = {k: 13 - k for k in range(14)}
    get = lambda m: {x["i"]: (x["weight"], x["resistance"]) for x in spectra(spark.createDataFrame(rows(m), "unit int, src long, dst long"), 20).collect()}
    a, b = get({k: k for k in range(14)}), get(swap)
    assert all(np.allclose(a[k], b[swap[k]]) for k in a)
