"""Sums and order statistics over near points, made in blocks of any size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import spatial as S


def cloud(spark, n, spread=4.0):
    x = np.random.default_rng(5).standard_normal((n, 4)) * spread
    return x, spark.createDataFrame([(k % 2, k, *map(float, p)) for k, p in enumerate(x)], "unit int, i long, px double, py double, pz double, v double")


def near(x, r):
    k = np.arange(len(x))
    d = np.sqrt(((x[:, None, :3] - x[None, :, :3]) ** 2).sum(-1))
    return d, (d <= r) & (k[:, None] % 2 == k[None] % 2) & (k[:, None] != k[None])


@pytest.mark.parametrize("blocks", [(4096, 16384), (7, 11)])
def test_quantiles_and_walks_in_blocks(spark, blocks, monkeypatch):
    monkeypatch.setattr(S, "OWN_BLOCK", blocks[0])
    monkeypatch.setattr(S, "AROUND_BLOCK", blocks[1])
    x, p = cloud(spark, 120)
    d, m = near(x, 5.0)
    alone = {k for k in range(len(x)) if not m[k].any()}
    for share, column, values in ((0.5, "v", np.broadcast_to(x[:, 3], d.shape)), (0.9, None, d)):
        got = {r.i: (r.n, r.q) for r in S.near_quantile(p, 5.0, share, column).collect()}
        assert set(got) == set(range(len(x))) - alone
        for k, (n, q) in got.items():
            assert n == m[k].sum() and q == pytest.approx(np.quantile(values[k][m[k]], share), abs=1e-12)
    got = {r.i: r for r in S.point_walks(p, 5.0, ["v"]).collect()}
    contact = m @ x[:, 3]
    for k, r in got.items():
        assert np.allclose([r.v_contact, r.v_walk2], [contact[k], m[k] @ contact - m[k].sum() * x[k, 3]])


def test_pairs_are_not_rows(spark, sf):
    """Joins of pairs within a radius were the rows of these queries."""
    from tessera import plans

    for name in ("AGG09_walk_sums", "AGG11_neighbour_order_statistics", "AGG12_directional_difference", "FEA11_wall_columns", "FEA20_seam_columns", "GRA06_density_gradient", "GRA07_shape_descriptors", "GRA09_quadric_fit", "DET03_anchored_deformation"):
        plan = plans.loaded().QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "_ra" not in plan and "_home" not in plan, name


def test_null_places_have_no_neighbours(spark):
    _, p = cloud(spark, 20, 1.0)
    p = p.withColumn("px", F.when(F.col("i") > 2, F.col("px")))
    assert {r.i for r in S.near_counts(p, 50.0).collect()} == set(range(3, 20))


def test_rounded_as_sql(spark):
    """F.round goes by decimal digits, and differs from SQL where a product meets the half."""
    import duckdb

    x = [(k + 0.5) / 10.0**7 for k in range(0, 80_000_000, 39_989)] + [0.0, 1.25, 7.99999995, 123456.7, 1e12, 1e300]
    want = [r[0] for r in duckdb.sql(f"SELECT round(unnest({x}::DOUBLE[]), 7)").fetchall()]
    assert want == [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(S.rounded(F.col("x"), 7)).collect()]
    assert want != [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 7)).collect()]


def test_pairs_are_not_rounded_by_decimals(spark, sf):
    from tessera import plans

    for name in ("JON01_radius_join", "JON02_radius_pairs", "JON05_contact_graph", "GRA01_deflated_edges"):
        assert "round(" not in plans.loaded().QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower(), name
