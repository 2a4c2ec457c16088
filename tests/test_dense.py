"""Clusters and void spheres of dense units, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import graph, linear


def plain_linkage(x, tau):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    parts = [[k] for k in range(len(x))]
    while len(parts) > 1:
        far, a, b = min((d[np.ix_(p, q)].max(), a, b) for a, p in enumerate(parts) for b, q in enumerate(parts) if a < b)
        if far > tau:
            break
        parts[a] += parts.pop(b)
    out = np.empty(len(x), int)
    for k, p in enumerate(sorted(parts, key=min)):
        out[p] = k
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_complete_linkage_equals_plain(ties):
    r = np.random.default_rng(8)
    for n in (1, 2, 25, 40):
        x = r.integers(0, 4, (n, 3)).astype(float) if ties else r.random((n, 3)) * 10
        for tau in (0.5, 3.0, 6.0, 100.0):
            assert (graph.complete_linkage(x, tau) == plain_linkage(x, tau)).all()


def test_dense_points_hold_no_void_spheres(spark):
    """Points within are left out; spheres equal those of all points."""
    x = np.random.default_rng(9).standard_normal((500, 3))
    keep = linear.near_voids(x, 1.5)
    assert 20 < keep.sum() < 500
    df = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(x)], "unit int, i long, px double, py double, pz double")
    want = []
    for t in linear.delaunay(x):
        centre, r = linear.sphere(*x[list(t)])
        if 1.5 <= r <= 6:
            want.append(t)
            assert keep[list(t)].all()
    assert sorted((r.a, r.b, r.c, r.d) for r in linear.void_spheres(df, 1.5, 6.0).collect()) == sorted(want)


def test_components_by_cells(spark):
    r = np.random.default_rng(10)
    x = np.vstack([r.random((150, 3)) * 12, r.random((40, 3)) + 30])
    rows = [(k % 2, k, *map(float, p)) for k, p in enumerate(x)]
    rows += [(0, 500, None, 0.0, 0.0), (0, 501, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "unit int, i long, px double, py double, pz double")
    want = {500: 500, 501: 501}
    for u in (0, 1):
        own = [k for k in range(len(x)) if k % 2 == u]
        parent = {k: k for k in own}
        find = lambda k: k if parent[k] == k else find(parent[k])  # noqa: B023, E731
        for a in own:
            for b in own:
                if a < b and ((x[a] - x[b]) ** 2).sum() <= 4:
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
        want |= {k: find(k) for k in own}
    assert len(set(want.values())) > 8
    assert {v.i: v.root for v in graph.near_components(df, 2.0).collect()} == want


def test_components_of_a_zigzag(spark):
    """Labels that rise and fall along a path, longer than rounds of neighbours' minima reach."""
    n = 400
    name = np.random.default_rng(11).permutation(n)
    pairs = spark.createDataFrame([(0, int(name[k]), int(name[k + 1])) for k in range(n - 1)], "unit int, a long, b long")
    nodes = spark.createDataFrame([(0, k) for k in range(n)], "unit int, i long")
    assert {r.root for r in graph.connected(pairs, nodes).collect()} == {0}
