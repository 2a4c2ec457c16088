"""What lies ahead of points, looked up in blocks, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import detectors as D
from tessera.operators import grid as G


def plain(own, other, way, reach, width, sphere):
    o = [other[None, :, j] - own[:, None, j] for j in range(3)]
    along = o[0] * way[0] + o[1] * way[1] + o[2] * way[2]
    d2 = o[0] * o[0] + o[1] * o[1] + o[2] * o[2]
    hit = (along > 0) & (along <= reach) & (d2 - along * along <= width * width)
    return np.where(hit & (d2 <= reach * reach) if sphere else hit, along, np.inf).min(1, initial=np.inf)


def clouds():
    r = np.random.default_rng(4)
    yield r.standard_normal((300, 3)) * 4
    yield np.stack(np.meshgrid(*[np.arange(7.0) * 1.8] * 3), -1).reshape(-1, 3)
    yield np.vstack([r.uniform(0, 60, (200, 3)) + 1e6, np.full((20, 3), 1e6 + 7.0)])
    yield np.array([[0.0, 0, 0], [0, 0, 11]])
    yield np.zeros((1, 3))


@pytest.mark.parametrize("tried", [G.TRIED, 20])
def test_ahead_equals_all_pairs(tried, monkeypatch):
    monkeypatch.setattr(G, "TRIED", tried)
    for x in clouds():
        for way in [*G.directions(7), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)]:
            for reach, width in ((11.0, 1.8), (3.6, 1.8), (5.0, 6.0)):
                for sphere in (False, True):
                    want = plain(x[::2], x, way, reach, width, sphere)
                    assert (G.ahead(x[::2], x, way, reach, width, sphere) == want).all()
                    assert (np.isfinite(G.ahead(x[::2], x, way, reach, width, sphere, nearest=False)) == np.isfinite(want)).all()
    assert np.isinf(G.ahead(x, np.zeros((0, 3)), (0.0, 0.0, 1.0), 11.0, 1.8)).all()


def test_marks_meet_over_blocks(spark, monkeypatch):
    """Blocks of any size give the same; null and odd places and ids are met by none."""
    x = next(clouds())[:90]
    p = spark.createDataFrame([(k % 2, k, *map(float, q)) for k, q in enumerate(x)], "unit int, i long, px double, py double, pz double")
    odd = p.unionByName(spark.createDataFrame([(0, 1000, None, 0.0, 0.0), (0, 1001, float("nan"), 0.0, 0.0), (None, 1002, 0.0, 0.0, 0.0)], p.schema))
    want = {k: sum(np.isfinite(plain(x[[k]], x[k % 2 :: 2], w, 11.0, 1.8, False)[0]) for w in G.directions(30)) / 30 for k in range(len(x))} | {1000: 0.0, 1001: 0.0, 1002: 0.0}
    assert 0 < sum(want.values()) < len(x)
    for sizes in ((1 << 14, 1 << 16), (5, 7)):
        monkeypatch.setattr(G, "OWN_BLOCK", sizes[0])
        monkeypatch.setattr(G, "AROUND_BLOCK", sizes[1])
        got = {r.i: r.buried for r in D.buriedness(odd).collect()}
        assert got == pytest.approx(want, abs=1e-15)


def test_pairs_are_not_turned_as_rows(spark, sf):
    """Each pair within reach was a row, and 30 more with its directions."""
    from tessera import plans

    plan = plans.loaded().QUERIES["GRA19_buriedness"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "_ra" not in plan
    p = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 0.0, 0.0, 5.0)], "unit int, i long, px double, py double, pz double")
    assert "FlatMapCoGroupsInArrow" in D.free_runs(p.withColumn("pz", F.col("pz") + 1))._jdf.queryExecution().optimizedPlan().toString()
