"""Operators that SQL can't express, against plain versions and known cases."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import field
from tessera.operators import align, graph, linear
from tessera.operators.solvers import newton_logistic
from tessera.sources import cif, volumes


def rng():
    return np.random.default_rng(3)


def kruskal(pairs):
    """(unit, src, dst, d) of the forest, ties by (d, src, dst)."""
    parent, out = {}, []
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for d, s, t, u in sorted((d, s, t, u) for u, s, t, d in pairs):
        a, b = root((u, s)), root((u, t))
        if a != b:
            parent[a] = b
            out.append((u, s, t, d))
    return sorted(out)


def test_forest_weight_equals_best_of_all_trees():
    n = 5
    r = rng()
    pairs = list(itertools.combinations(range(n), 2))
    d = r.random(len(pairs))
    best = min(sum(d[list(c)]) for c in itertools.combinations(range(len(pairs)), n - 1) if len(set(graph_roots(n, [pairs[k] for k in c]))) == 1)
    assert sum(e[3] for e in kruskal([(0, *p, w) for p, w in zip(pairs, d, strict=True)])) == pytest.approx(best)


@pytest.mark.parametrize("ties", [False, True])
def test_forest_equals_kruskal(spark, ties):
    r = rng()
    n = 120
    rows = [(u, s, t, float(r.integers(1, 4) if ties else r.random())) for u in (0, 1, 2) for s, t in itertools.combinations(range(n), 2) if r.random() < (0.01, 0.05, 0.3)[u]]
    df = spark.createDataFrame(rows + [(u, t, s, d) for u, s, t, d in rows[::2]], "unit int, src long, dst long, d double")
    assert sorted(map(tuple, graph.forest(df).collect())) == kruskal(rows)
    assert graph.forest(df.filter("false")).count() == 0


def test_forest_of_a_path(spark):
    """Least edges that all point one way make one long chain of pointers."""
    rows = [(0, k, k + 1, 1.0 - k / 1000) for k in range(300)]
    df = spark.createDataFrame(rows, "unit int, src long, dst long, d double")
    assert sorted(map(tuple, graph.forest(df).collect())) == kruskal(rows)


def test_hop_rows(spark):
    r = rng()
    n = 40
    rows = [(u, s, t) for u in (0, 1) for s, t in itertools.combinations(range(n), 2) if r.random() < 0.06]
    df = spark.createDataFrame(rows + [(u, t, s) for u, s, t in rows], "unit int, src long, dst long")
    got = {(x["unit"], x["source"], x["i"]): x["hop"] for x in graph.hop_rows(df, 4).collect()}
    want = {}
    for u in (0, 1):
        a = np.zeros((n, n))
        for v, s, t in rows:
            if v == u:
                a[s, t] = a[t, s] = 1
        for s in np.flatnonzero(a.sum(1)):
            want |= {(u, int(s), k): int(h) for k, h in enumerate(graph.hop_distances(a, s)) if 0 <= h <= 4}
    assert got == want
    assert graph.hop_rows(df.filter("false"), 4).count() == 0


def test_half_neighbourhood_makes_each_pair_once(spark):
    from pyspark.sql import functions as F

    from tessera.operators import spatial as S

    r = rng()
    x = np.round(r.standard_normal((150, 3)) * 6) / 2
    p = spark.createDataFrame(pd.DataFrame({"unit": np.arange(150) % 2, "i": np.arange(150) // 2, "px": x[:, 0], "py": x[:, 1], "pz": x[:, 2], "w": x[:, 0] * 2}))
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    for strict in (False, True):
        want = sorted((a % 2, a // 2, b // 2, x[a, 0] * 2, x[b, 0] * 2) for a in range(150) for b in range(a + 2, 150, 2) if (d2[a, b] < 4 if strict else d2[a, b] <= 4))
        got = S.radius_pairs(p, 2.0, columns=["w"], strict=strict)
        assert sorted(map(tuple, got.select("unit", "a_i", "b_i", "a_w", "b_w").collect())) == want
        assert sorted(map(tuple, S.edges(p, 2.0, ["w"], strict).select("unit", "src", "dst", "s_w", "t_w").collect())) == sorted(want + [(u, b, a, w, v) for u, a, b, v, w in want])
    # what the join makes: half of the ordered pairs of different points in the 27 cubes
    cubes = np.floor(x / 2)
    near = (np.abs(cubes[:, None] - cubes[None]).max(-1) <= 1) & (np.arange(150)[:, None] % 2 == np.arange(150)[None] % 2)
    assert S.candidate_pairs(p, 2.0).count() == (near.sum() - 150) // 2
    assert S.radius_pairs(p.withColumn("px", F.lit(None).cast("double")), 2.0).count() == 0


def graph_roots(n, edges):
    parent = list(range(n))
    for a, b in edges:
        x, y = graph.find(parent, a), graph.find(parent, b)
        parent[max(x, y)] = min(x, y)
    return [graph.find(parent, k) for k in range(n)]


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(0, k, k + 1) for k in range(60) if k != 30], "unit int, a long, b long")
    nodes = spark.createDataFrame([(0, k) for k in range(61)], "unit int, i long")
    got = {r["i"]: r["root"] for r in graph.connected(pairs, nodes).collect()}
    assert got == {k: 0 if k <= 30 else 31 for k in range(61)}


def test_cut_parts_by_removal():
    r = rng()
    for _ in range(20):
        n = 8
        a = np.triu(r.random((n, n)) < 0.25, 1).astype(float)
        a = a + a.T
        parts = lambda m, keep: len({frozenset(np.flatnonzero(graph.hop_distances(m, s) >= 0)) for s in keep})  # noqa: B023, E731
        base = parts(a, range(n))
        bridges = sum(parts(cut(a, x, y), range(n)) > base for x, y in zip(*np.nonzero(np.triu(a)), strict=True))
        joints = 0
        for x in range(n):
            m = a.copy()
            m[x] = m[:, x] = 0
            joints += parts(m, [k for k in range(n) if k != x]) > base - (a[x].sum() == 0)
        assert graph.cut_parts(a) == (bridges, joints)


def cut(a, x, y):
    m = a.copy()
    m[x, y] = m[y, x] = 0
    return m


def test_complete_linkage_bounds_diameter():
    x = rng().random((30, 3)) * 10
    label = graph.complete_linkage(x, 4.0)
    for k in np.unique(label):
        own = x[label == k]
        assert np.sqrt(((own[:, None] - own[None]) ** 2).sum(-1)).max() <= 4.0


def test_delaunay_spheres_are_empty():
    x = np.round(rng().random((25, 3)) * 10, 3)
    tets = linear.delaunay(x)
    assert tets
    for t in tets:
        c, r = linear.sphere(*x[list(t)])
        assert (np.linalg.norm(np.delete(x, t, 0) - c, axis=1) >= r - 1e-6).all()
    volume = sum(abs(np.linalg.det(x[list(t[1:])] - x[t[0]])) / 6 for t in tets)
    assert volume > 0


def test_void_spheres_are_empty_of_all_points(spark):
    x = np.round(rng().random((150, 3)) * 40, 3)
    got = linear.void_spheres(spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(x)], "unit int, i long, px double, py double, pz double"), 3.0, 12.0).collect()
    assert {k for r in got for k in (r.a, r.b, r.c, r.d)} > set(range(60, 150, 10))
    assert all((np.linalg.norm(x - np.array([r.cx, r.cy, r.cz]), axis=1) >= r.radius - 1e-6).all() for r in got)


def test_known_circumradius():
    c, r = linear.sphere(*(np.array(p, float) for p in ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1))))
    assert r == pytest.approx(3**0.5) and np.allclose(c, 0)


def test_superposition_undoes_a_rotation():
    a = rng().random((20, 3))
    q, _ = np.linalg.qr(rng().random((3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert linear.superposed(a, a @ q + 3)[1] == pytest.approx(0, abs=1e-9)


def test_elastic_network_has_six_rigid_modes():
    w = np.linalg.eigvalsh(linear.elastic_hessian(rng().random((12, 3)) * 6, 20.0))
    assert (np.abs(w[:6]) < 1e-9).all() and w[6] > 1e-6


@given(st.text("ABC", max_size=6), st.text("ABC", max_size=6))
@settings(max_examples=60, deadline=None)
def test_alignment_score_by_recursion(a, b):
    def best(i, j):
        if not i or not j:
            return align.GAP * (i + j)
        return max(best(i - 1, j - 1) + (align.MATCH if a[i - 1] == b[j - 1] else align.MISMATCH), best(i - 1, j) + align.GAP, best(i, j - 1) + align.GAP)

    score, pairs = align.align(a, b)
    assert score == best(len(a), len(b))
    assert all(a[i] == b[j] for i, j in pairs)


def test_field_of_four():
    for a, b, c in itertools.product(range(4), repeat=3):
        assert field.times(a, b ^ c) == field.times(a, b) ^ field.times(a, c)
        assert field.times(field.times(a, b), c) == field.times(a, field.times(b, c))
    col = [2, 0, 3, 1, 1]
    x = [1, 2, 3, 0, 2]
    assert field.solved(col, field.toeplitz(col, x)) == x


def test_cif_quotes_and_text_blocks():
    text = "data_a\nloop_\n_atom_site.id\n_atom_site.name\n1 'C A'\n2 \"O'\"\n3\n;two\nlines\n;\n#\n_other.x 5\n"
    assert cif.table_rows(text, "atom_site", ["id", "name", "gone"]) == [{"id": "1", "name": "C A", "gone": None}, {"id": "2", "name": "O'", "gone": None}, {"id": "3", "name": "two\nlines", "gone": None}]


def test_volume_axes_come_back_in_order():
    for axes in itertools.permutations((1, 2, 3)):
        raw = volumes.made((3, 4, 5), axes, 1)
        assert volumes.volume(raw).shape == (3, 4, 5)
        assert np.allclose(volumes.volume(raw), volumes.volume(volumes.made((3, 4, 5), (1, 2, 3), 1)))


def test_newton_logistic_has_no_gradient_left(spark):
    r = rng()
    x = r.standard_normal((300, 2))
    y = (r.random(300) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    beta = newton_logistic(df, ["a", "b"], "y", 1.0, 30)
    full = np.column_stack([np.ones(300), x])
    g = full.T @ (y - 1 / (1 + np.exp(-full @ beta))) - np.array([0, 1, 1]) * beta
    assert np.abs(g).max() < 1e-6


def test_mid_rank_ties_and_radius_join_on_points(spark):
    from tessera.operators.spatial import radius_pairs
    from tessera.operators.windows import quartile_digit

    r = rng()
    x = np.round(r.random((80, 3)) * 20, 1)
    p = spark.createDataFrame(pd.DataFrame({"unit": 0, "i": range(80), "px": x[:, 0], "py": x[:, 1], "pz": x[:, 2]}))
    got = {(a["a_i"], a["b_i"]) for a in radius_pairs(p, 3.0).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert got == {(a, b) for a in range(80) for b in range(a + 1, 80) if d2[a, b] <= 9.0}
    d = [v["d"] for v in spark.createDataFrame([(0, v) for v in (1.0, 1.0, 1.0, 1.0)], "unit int, x double").select(quartile_digit("x").alias("d")).collect()]
    assert len(set(d)) == 1


def points_df(spark, x, unit=0):
    return spark.createDataFrame(pd.DataFrame({"unit": unit, "i": np.arange(len(x)), "px": x[:, 0], "py": x[:, 1], "pz": x[:, 2]}))


@pytest.mark.parametrize("wide", [3.0, 5.0, 9.0, 1e9])
def test_void_spheres_by_cells(spark, wide):
    """Cells give the spheres that the whole unit gives, each once."""
    r = rng()
    x = np.vstack([r.random((140, 3)) * [30, 20, 12], r.random((40, 3)) * [5, 5, 40] - 5])
    want = []
    for t in linear.delaunay(x):
        centre, radius = linear.sphere(*x[list(t)])
        if 1.0 <= radius <= 3.0:
            want.append((*t, *centre, radius))
    got = sorted(tuple(v)[1:] for v in linear.void_spheres(points_df(spark, x), 1.0, 3.0, wide).collect())
    assert len(want) > 50 and [g[:4] for g in got] == [w[:4] for w in sorted(want)]
    assert np.allclose(got, sorted(want))


def test_void_spheres_of_few_or_flat_points(spark):
    for x in (np.zeros((0, 3)), np.zeros((1, 3)), np.eye(3), np.array([[k, k % 3, 0.0] for k in range(9)])):
        df = points_df(spark, x) if len(x) else points_df(spark, np.eye(3)).filter("false")
        assert linear.void_spheres(df, 0.1, 3.0).count() == 0


def hull_sets():
    r = rng()
    grid = np.array(list(itertools.product(range(4), repeat=3)), float)
    ball = r.standard_normal((90, 3))
    shell = ball / np.sqrt((ball**2).sum(1))[:, None] * 7
    return {"ball": ball, "shell": shell, "grid": grid, "repeated": np.vstack([ball[:20], ball[:20]]), "tetra": np.vstack([np.zeros(3), np.eye(3)]), "octahedron": np.vstack([np.eye(3), -np.eye(3), np.zeros((1, 3))]), "prism": np.array([[np.cos(a), np.sin(a), z] for a in range(6) for z in (0, 1, 2)])}


def plain_hull(x):
    """Planes by the definition, over all triples; corners are where three of them meet."""
    planes = {}
    for a, b, c in itertools.combinations(range(len(x)), 3):
        n = np.cross(x[b] - x[a], x[c] - x[a])
        if (size := np.sqrt(n @ n)) < 1e-12:
            continue
        side = (x - x[a]) @ n / size
        for sign in (1, -1):
            if (sign * side <= 1e-9).all():
                planes[tuple(np.round(sign * n / size, 6) + 0.0)] = (sign * n / size, np.flatnonzero(np.abs(side) < 1e-9))
    met = [sum(k in on for _, on in planes.values()) for k in range(len(x))]
    return planes, [k for k in range(len(x)) if met[k] > 2]


@pytest.mark.parametrize("name", hull_sets())
@pytest.mark.parametrize("size", [6, 2048])
def test_hull(spark, name, size):
    from tessera.operators import hull

    x = hull_sets()[name]
    planes, corners = plain_hull(x)
    first = {tuple(v): k for k, v in reversed(list(enumerate(x)))}
    df = points_df(spark, x)
    found = hull.hull_corners(df, size)
    assert sorted(r["i"] for r in found.collect()) == sorted({first[tuple(x[k])] for k in corners})
    got = hull.hull_planes(found).first()["planes"]
    assert {tuple(np.round([e["x"], e["y"], e["z"]], 6) + 0.0) for e in got} == set(planes)
    depth = {r["i"]: r["depth"] for r in hull.hull_depth(df, hull.hull_planes(found)).collect()}
    want = [min(-(x[k] - x[on[0]]) @ n for n, on in planes.values()) for k in range(len(x))]
    assert np.allclose([depth[k] for k in range(len(x))], want, atol=1e-9)


def test_hull_of_flat_or_few_points(spark):
    from tessera.operators import hull

    flat = points_df(spark, np.array([[k % 4, k // 4, 2.0] for k in range(16)]))
    assert hull.hull_corners(flat, 5).count() == 16
    assert {r["depth"] for r in hull.hull_depth(flat, hull.hull_planes(hull.hull_corners(flat))).collect()} == {None}
    none = flat.filter("false")
    assert hull.hull_corners(none).count() == 0 and hull.hull_depth(none, hull.hull_planes(hull.hull_corners(none))).count() == 0


def plain_grid(x, step=1.5):
    """i, place, burial and score of buried free places, by the definition, point by point."""
    lo, hi = x.min(0) - 3, x.max(0) + 3
    axes = [lo[j] + step * np.arange(int(np.ceil((hi[j] + step - lo[j]) / step))) for j in range(3)]
    g = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
    near = np.sqrt(((g[:, None] - x[None]) ** 2).sum(-1).min(1))
    at = np.flatnonzero((near > 2.6) & (near < 6))
    from tessera.operators.grid import directions

    ways = np.array(directions(30))
    assert np.allclose((ways**2).sum(1), 1)
    bur = []
    for p in g[at]:
        off = x - p
        along = off @ ways.T
        bur.append(((along > 0) & (along <= 11) & ((off**2).sum(1)[:, None] - along**2 <= 1.8**2) & ((off**2).sum(1)[:, None] <= 121)).any(0).mean())
    bur = np.array(bur)
    keep = bur >= 0.55
    if not keep.any():
        keep[np.argsort(-bur, kind="stable")[:50]] = True
    at, bur = at[keep], bur[keep]
    n = (((g[at][:, None] - g[at][None]) ** 2).sum(-1) <= 64).sum(1)
    return {int(k): (b, b * np.log1p(c)) for k, b, c in zip(at, bur, n, strict=True)}


def test_pocket_grid(spark):
    from tessera.operators import grid

    r = rng()
    shell = r.standard_normal((400, 3))
    shell = 9 * shell / np.sqrt((shell**2).sum(1))[:, None]
    sets = {0: shell, 1: r.random((30, 3)) * 20, 2: np.zeros((1, 3))}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"unit": u, "i": np.arange(len(x)), "px": x[:, 0], "py": x[:, 1], "pz": x[:, 2]}) for u, x in sets.items()]))
    got = {}
    for v in grid.pocket_scores(df).collect():
        got.setdefault(v["unit"], {})[v["i"]] = (v["buried"], v["score"])
    for u, x in sets.items():
        want = plain_grid(x)
        assert set(got[u]) == set(want)
        assert np.allclose([got[u][k] for k in sorted(want)], [want[k] for k in sorted(want)])
    assert max(b for b, _ in got[0].values()) > 0.55 > max(b for b, _ in got[2].values())
    assert grid.pocket_scores(df.filter("false")).count() == 0


def plain_invariants(a):
    """The fifteen numbers by their definitions, over all subsets."""
    n = len(a)
    hops = lambda m, s: graph.hop_distances(m, s)
    own = [k for k in range(1, n) if a[0, k]]
    common = lambda x, y: sum(a[x, k] and a[y, k] for k in range(n))
    core = max(len(own) and k for k in range(n) if any(0 in c and all(sum(a[x, y] for y in c) >= k for x in c) for m in range(1, n + 1) for c in itertools.combinations(range(n), m)))
    clique = max(m for m in range(1, n + 1) if any(0 in c and all(a[x, y] for x, y in itertools.combinations(c, 2)) for c in itertools.combinations(range(n), m)))
    p4 = sum(a[0, x] and a[x, y] and a[y, z] and not a[0, y] and not a[0, z] and not a[x, z] for x, y, z in itertools.permutations(range(1, n), 3))
    w = a[1:, 1:]
    m = n - 1
    cycles = [k for k in range(3, m + 1) if any(all(w[c[j], c[(j + 1) % k]] for j in range(k)) for c in itertools.permutations(range(m), k))]
    d = [hops(w, s) for s in range(m)]
    parts = lambda g, keep: len({frozenset(np.flatnonzero(hops(g, s) >= 0)) for s in keep})
    base = parts(w, range(m))
    bridges = cuts = 0
    for x, y in itertools.combinations(range(m), 2):
        if w[x, y]:
            g = w.copy()
            g[x, y] = g[y, x] = 0
            bridges += parts(g, range(m)) > base
    for x in range(m):
        g = w.copy()
        g[x] = g[:, x] = 0
        cuts += parts(g, [k for k in range(m) if k != x]) > base - (not w[x].any())
    big = max(range(m), key=lambda s: ((d[s] >= 0).sum(), -s))
    inside = np.flatnonzero(d[big] >= 0)
    odd = any(all(w[c[j], c[(j + 1) % k]] for j in range(k)) for k in range(3, m + 1, 2) for c in itertools.permutations(range(m), k))
    return (
        sum(a[x, y] for x, y in itertools.combinations(own, 2)), sum(common(0, k) * (common(0, k) - 1) // 2 for k in range(1, n) if not a[0, k]), core, max(hops(a, 0)), clique, p4,
        int((hops(a, 0) == 2).sum()), sum(w[x, y] and w[y, z] and w[x, z] for x, y, z in itertools.combinations(range(m), 3)), min(cycles, default=0), max(d[s].max() for s in inside), sum(d[s][d[s] > 0].sum() for s in inside) // 2,
        bridges, cuts, int((w.sum(1) == 1).sum()), int(not odd),
    )


def test_invariants_of_linings_by_definition():
    from tessera.operators import ego

    r = rng()
    for _ in range(40):
        n = int(r.integers(2, 8))
        a = np.triu(r.random((n, n)) < r.choice([0.25, 0.5, 0.8]), 1).astype(int)
        a = a + a.T
        masks = [sum(int(v) << k for k, v in enumerate(row)) for row in a]
        assert ego.invariants(masks) == tuple(map(int, plain_invariants(a))), a


def test_invariants_of_known_graphs():
    from tessera.operators import ego

    named = lambda edges, n: dict(zip(ego.INVARIANTS, ego.invariants([sum(1 << b for a, b in [*edges, *((y, x) for x, y in edges)] if a == k) for k in range(n)]), strict=True))
    wheel = named([(0, k) for k in range(1, 14)] + [(k, k % 13 + 1) for k in range(1, 14)], 14)
    assert (wheel["tri_centre"], wheel["kcore"], wheel["maxclique"], wheel["girth_wall"], wheel["diam_wall"], wheel["bipartite_wall"]) == (13, 3, 3, 0, 6, 0)
    wheel = named([(0, k) for k in range(1, 13)] + [(k, k % 12 + 1) for k in range(1, 13)], 13)
    assert (wheel["girth_wall"], wheel["bipartite_wall"], wheel["wiener_wall"], wheel["bridges_wall"]) == (12, 1, 216, 0)
    full = named(list(itertools.combinations(range(49), 2)), 49)
    assert (full["maxclique"], full["kcore"], full["tri_centre"], full["tri_wall"], full["p4_centre"]) == (49, 48, 48 * 47 // 2, 48 * 47 * 46 // 6, 0)
    path = named([(k, k + 1) for k in range(20)], 21)
    assert (path["ecc_centre"], path["p4_centre"], path["bridges_wall"], path["artic_wall"], path["leaves_wall"], path["diam_wall"]) == (20, 1, 19, 18, 2, 19)


def test_linings(spark):
    """Masks, the cap of 48 and points without neighbours, against distances."""
    from tessera.operators import ego

    r = rng()
    x = np.vstack([r.standard_normal((70, 3)) * 4, [[100, 100, 100]]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    df = points_df(spark, x)
    want = {}
    for k in range(len(x)):
        near = [j for j in range(len(x)) if j != k and d[k, j] <= 10]
        if len(near) > 48:
            near = sorted(near, key=lambda j: (d[k, j], j))[:48]
        s = [k, *near]
        if near:
            want[k] = [sum(1 << b for b, q in enumerate(s) if q != p and d[p, q] <= 7) for p in s]
    assert any(len(v) == 49 for v in want.values()) and any(len(v) < 49 for v in want.values())
    got = {v["i"]: v["masks"] for v in ego.linings(df).collect()}
    assert got == want
    shown = {v["i"]: tuple(v)[2:] for v in ego.lining_spectra(df).collect()}
    for k in range(len(x)):
        if k not in want:
            assert shown[k] == (0, 0, 0, 0, 0)
            continue
        near = sorted((j for j in range(len(x)) if j != k and d[k, j] <= 10), key=lambda j: (d[k, j], j))[:48]
        s = [k, *near]
        a, touch = ((d[np.ix_(s, s)] <= r) & ~np.eye(len(s), dtype=bool) for r in (10, 7))
        w = np.linalg.eigvalsh(np.diag(a.sum(1)) - a.astype(float))
        wall = touch[1:, 1:].astype(float)
        parts = len({frozenset(np.flatnonzero(graph.hop_distances(wall, v) >= 0)) for v in range(len(wall))})
        assert np.allclose(shown[k], (w[1], w[-1], a.sum() / len(s), parts, wall.sum() / 2 - len(wall) + parts), atol=1e-9)
    full = {v["i"]: tuple(v)[2:] for v in ego.lining_invariants(df).collect()}
    assert full == {k: ego.invariants(want[k]) if k in want else (0,) * 15 for k in range(len(x))}
    few = {v["i"]: v.asDict() for v in ego.lining_counts(ego.linings(df)).collect()}
    for k, v in few.items():
        assert all(full[k][ego.INVARIANTS.index(c)] == n for c, n in v.items() if c in ego.INVARIANTS)


@pytest.mark.parametrize("strip,held", [(5, 1), (5, 1 << 20), (64, 1 << 20)])
def test_gram_blocks(spark, monkeypatch, strip, held):
    from tessera.operators import blocks

    monkeypatch.setattr(blocks, "HELD", held)
    r = rng()
    x, y = r.standard_normal((300, 23)) + 3, r.integers(0, 3, 300)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x.tolist()})).repartition(5)
    g = blocks.gram_blocks(df, 23, strip=strip)
    assert g.blocks.count() == 3 * len(g.sizes()) * (len(g.sizes()) + 1) // 2
    got = {(v.y, v.a, v.b): v.s for v in g.scatter().collect()}
    assert len(got) == 3 * 23 * 24 // 2
    for v in range(3):
        own = x[y == v] - x[y == v].mean(0)
        s = own.T @ own
        assert np.allclose([got[v, a, b] for a in range(23) for b in range(a + 1)], [s[a, b] for a in range(23) for b in range(a + 1)])
    vectors = {v: r.standard_normal(24) for v in range(3)}
    full = {v: np.column_stack([np.ones((y == v).sum()), x[y == v]]) for v in range(3)}
    assert np.allclose(g.times(vectors), sum(full[v].T @ (full[v] @ vectors[v]) for v in range(3)))


def test_wide_ridge_equals_a_dense_solve(spark):
    from tessera.operators import blocks

    r = rng()
    x, y = r.standard_normal((200, 40)), r.integers(0, 2, 200)
    x[:, 7] = 5.0
    x[:, 9] = x[:, 8] + 1e-3 * r.standard_normal(200)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x.tolist()}))
    beta = blocks.wide_ridge(blocks.gram_blocks(df, 40, strip=9), {0: 0.0, 1: 1.0}, 0.1)
    sd = x.std(0)
    z = np.where(sd > 1e-9, (x - x.mean(0)) / np.where(sd > 1e-9, sd, 1), 0)
    assert np.allclose(beta, np.linalg.solve(z.T @ z / 200 + 0.1 * np.eye(40), z.T @ (y - y.mean()) / 200), atol=1e-7)
    with pytest.raises(Exception, match="should hold 41 numbers"):
        blocks.gram_blocks(df, 41)


def test_pair_rmsd_from_sums(spark):
    r = rng()
    sets = {u: (r.standard_normal((n, 3)) * 5 + 100, r.standard_normal((n, 3)) * 5 - 40) for u, n in ((0, 40), (1, 3), (2, 2), (3, 60))}
    turn = np.linalg.qr(r.standard_normal((3, 3)))[0]
    sets[4] = (sets[0][0], sets[0][0] @ (turn * np.sign(np.linalg.det(turn))) + 7)
    sets[5] = (sets[0][0], sets[0][0] * [1, 1, -1])
    rows = [(u, k, *map(float, a[k]), *map(float, b[k])) for u, (a, b) in sets.items() for k in range(len(a))]
    got = {v.unit: v for v in linear.pair_rmsd(spark.createDataFrame(rows, "unit int, i long, ax double, ay double, az double, bx double, by double, bz double")).collect()}
    for u, (a, b) in sets.items():
        assert got[u].n == len(a)
        assert got[u].rmsd is None if len(a) < 3 else np.isclose(got[u].rmsd, linear.superposed(a, b)[1], atol=1e-6)


def test_quantiles_and_places(spark):
    from tessera.operators import ordered

    r = rng()
    for x in (np.round(r.standard_normal(501), 1), np.array([3.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(4)
        shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
        assert np.allclose(ordered.quantiles(df, "x", shares), np.quantile(x, shares), atol=1e-12)
    assert ordered.quantiles(df.filter("x > 9"), "x", [0.5]) == []
    rows = spark.createDataFrame([(int(v) % 7, k) for k, v in enumerate(r.permutation(200))], "a int, b int")
    got = sorted((v.at, v.a, v.b) for v in ordered.placed(rows, ["a", "b"], "at").collect())
    assert [g[0] for g in got] == list(range(200)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def plain_voids(x, owner, side, low, high, link, gate, contact, tight, wide):
    """Columns of each owner by loops over spheres and owners; spheres in the order of their corners."""
    from tessera.operators import hull

    r1 = lambda v: int(np.rint(v))
    spheres = []
    for t in linear.delaunay(x):
        centre, r = linear.sphere(*x[list(t)])
        if low <= r <= high:
            spheres.append((t, centre, r))
    n = len(spheres)
    parent = graph_roots(n, [(a, b) for a, b in itertools.combinations(range(n), 2) if np.sqrt(((spheres[a][1] - spheres[b][1]) ** 2).sum()) <= link])
    label = [min(k for k in range(n) if parent[k] == parent[s]) for s in range(n)]
    cent = {o: x[owner == o].mean(0) for o in np.unique(owner)}
    eq = hull.Hull(x).equations()
    depth = lambda p: float(np.min(-(eq[:, :3] @ p + eq[:, 3])))
    voids = {v: [s for s in range(n) if label[s] == v] for v in set(label)}
    res = {v: sorted({int(owner[a]) for s in ss for a in spheres[s][0]}) for v, ss in voids.items()}
    out = {}
    for o in cent:
        row = {"hull_distance_centi": r1(100 * depth(cent[o]))}
        mine = [s for s in range(n) if any(owner[a] == o for a in spheres[s][0])]
        atoms = {a for s in mine for a in spheres[s][0] if owner[a] == o}
        if mine:
            rr = np.array([spheres[s][2] for s in mine])
            row |= {"alpha_spheres": len(mine), "alpha_atoms": len(atoms), "alpha_incidences": sum(int(owner[a] == o) for s in mine for a in spheres[s][0]), "alpha_sc_atoms": sum(bool(side[a]) for a in atoms), "alpha_bb_atoms": sum(not side[a] for a in atoms), "alpha_atom_permille": r1(1000 * len(atoms) / (owner == o).sum()), "alpha_sc_permille": r1(1000 * sum(bool(side[a]) for a in atoms) / len(atoms))}
            row |= {"alpha_r_max_centi": r1(100 * rr.max()), "alpha_r_min_centi": r1(100 * rr.min()), "alpha_r_median_centi": r1(100 * np.median(rr)), "alpha_r_range_centi": r1(100 * (rr.max() - rr.min())), "alpha_n_tight": int((rr < tight).sum()), "alpha_n_open": int((rr > wide).sum())}
            own = sorted({label[s] for s in mine})
            best = max(own, key=lambda v: (len(res[v]), -v))
            ss, lin = voids[best], res[best]
            m = len(lin)
            at = {a for s in ss for a in spheres[s][0]}
            order = sorted(voids, key=lambda v: (-len(res[v]), v))
            span = max(np.sqrt(((spheres[a][1] - spheres[b][1]) ** 2).sum()) for a in ss for b in ss)
            by = sorted(lin, key=lambda j: (-sum(any(owner[a] == j for a in spheres[s][0]) for s in ss), j))
            d = {j: np.sqrt(((cent[j] - cent[o]) ** 2).sum()) for j in cent}
            near = sum(j != o and d[j] <= contact for j in lin)
            hd = [depth(spheres[s][1]) for s in ss]
            ball, close = [j for j in cent if d[j] <= gate], [j for j in cent if d[j] <= contact]
            gin, cin = sum(j in lin for j in ball), sum(j in lin for j in close)
            row |= {"n_voids": len(own), "best_void_residues": m, "best_void_spheres": len(ss), "best_void_atoms": len(at), "min_void_residues": min(len(res[v]) for v in own), "void_residues_total": sum(len(res[v]) for v in own), "best_void_rank_permille": r1(1000 * (order.index(best) + 1) / len(order)), "best_void_share_permille": r1(1000 * len(ss) / n)}
            row |= {"rank_in_void_permille": r1(1000 * (by.index(o) + 1) / m), "void_neighbours": near, "void_neighbour_permille": r1(1000 * near / m), "void_span_centi": r1(100 * span), "void_span_per_residue_centi": r1(100 * span / m), "void_spheres_per_residue_centi": r1(100 * len(ss) / m), "void_r_max_centi": r1(100 * max(spheres[s][2] for s in ss)), "void_r_mean_centi": r1(100 * np.mean([spheres[s][2] for s in ss])), "void_sc_permille": r1(1000 * sum(bool(side[a]) for a in at) / len(at))}
            row |= {"void_seq_segments": 1 + int((np.diff(lin) > 1).sum()), "void_seq_span": lin[-1] - lin[0], "void_seq_span_per_residue_centi": r1(100 * (lin[-1] - lin[0]) / m), "own_seq_offset_permille": r1(1000 * abs(o - np.median(lin)) / (lin[-1] - lin[0])) if lin[-1] > lin[0] else 0}
            row |= {"ball_gate_residues": len(ball), "ball_gate_in_void": gin, "ball_gate_purity_permille": r1(1000 * gin / len(ball)), "ball_contact_purity_permille": r1(1000 * cin / len(close)), "purity_gain_permille": r1(1000 * cin / len(close)) - r1(1000 * gin / len(ball)), "void_hull_min_centi": r1(100 * min(hd)), "void_hull_max_centi": r1(100 * max(hd)), "void_hull_range_centi": r1(100 * (max(hd) - min(hd)))}
            rim = {j for j in lin if sum(any(owner[a] == j for a in spheres[s][0]) for s in ss) == 1}
            seen, front, hop = {o}, {o}, 0
            while rim and not front & rim and front:
                front = {k for j in front for k in lin if k not in seen and np.sqrt(((cent[j] - cent[k]) ** 2).sum()) <= contact}
                seen |= front
                hop += 1
            row |= {"depth_in_void": hop, "is_void_core": int(hop >= 2)}
        out[int(o)] = row
    return out


def test_void_columns(spark):
    from pyspark.sql import functions as F

    from tessera.operators import voids

    r = rng()
    x = r.random((150, 3)) * [16, 14, 12]
    owner, side = np.arange(150) // 4, np.arange(150) % 3 == 0
    df = points_df(spark, x).withColumn("owner", F.floor(F.col("i") / 4)).withColumn("side", F.col("i") % 3 == 0)
    args = (1.5, 3.0, 1.0, 8.0, 4.0, 1.8, 2.4)
    got = {v["owner"]: v.asDict() for v in voids.void_columns(df, *args).collect()}
    want = plain_voids(x, owner, side, *args)
    assert set(got) == set(want) and len(next(iter(got.values()))) == 2 + 45
    assert sum("n_voids" in w for w in want.values()) > 20 and max(w.get("depth_in_void", 0) for w in want.values()) > 1
    for o, row in got.items():
        for c, v in row.items():
            if c not in ("unit", "owner"):
                assert v == want[o].get(c, 0), (o, c)
    assert voids.void_columns(df.filter("false")).count() == 0


def test_depths_in_a_void(spark):
    """A path from a rim, a part without a rim, an owner alone, and a void without any rim."""
    from tessera.operators import voids

    lining = spark.createDataFrame([(0, 5, o, 1 if o == 0 else 3) for o in range(9)] + [(0, 6, 0, 2), (0, 6, 1, 2)], "unit int, void long, owner long, spheres long")
    touch = [(0, 1), (1, 2), (2, 3), (5, 6), (6, 7)]
    pairs = spark.createDataFrame([(0, a, b) for x in touch for a, b in (x, x[::-1])] + [(0, o, o) for o in range(9)], "unit int, owner long, other long")
    got = {(r.void, r.owner): r.depth_in_void for r in voids.depths(lining, pairs).collect()}
    assert got == {(5, 0): 0, (5, 1): 1, (5, 2): 2, (5, 3): 3, (5, 4): 1, (5, 5): 3, (5, 6): 2, (5, 7): 3, (5, 8): 1, (6, 0): 0, (6, 1): 0}


def test_local_shapes_from_sums(spark):
    """Spread and quadric of each neighbourhood against a fit to its points."""
    from tessera.operators.local import local_shapes

    r = rng()
    flat = np.column_stack([r.random((60, 2)) * 12, np.zeros(60)])
    flat[:, 2] = 0.05 * flat[:, 0] ** 2 - 0.02 * flat[:, 0] * flat[:, 1] + 0.1 * r.standard_normal(60)
    x = np.vstack([r.standard_normal((80, 3)) * 4 + 50, flat, [[-90, 0, 0]], [[-80, 0, 0], [-79, 0, 0]]])
    got = {v.i: v.asDict() for v in local_shapes(points_df(spark, x), (4.0, 7.0)).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert len(got) == len(x)
    fitted = 0
    for k in range(len(x)):
        for radius in (4.0, 7.0):
            near = x[d[k] <= radius] - x[k]
            w, v = np.linalg.eigh(np.cov(near.T, bias=True)) if len(near) > 1 else (np.zeros(3), np.eye(3))
            total = max(w.sum(), 1e-12)
            row = [got[k][f"{c}{radius:g}"] for c in ("flat", "long", "gauss", "mean")]
            assert np.allclose(row[:2], (w[0] / total, w[2] / total), atol=1e-7)
            if len(near) < 6:
                assert row[2:] == [0, 0]
            elif len(near) > 8:  # fewer points fix the quadric badly, in either way of solving it
                fitted += 1
                q = near @ v[:, ::-1]
                m = np.column_stack([q[:, 0] ** 2, q[:, 0] * q[:, 1], q[:, 1] ** 2, q[:, 0], q[:, 1], np.ones(len(q))])
                c = np.linalg.lstsq(m, q[:, 2], rcond=None)[0]
                k1, k2 = np.linalg.eigvalsh([[2 * c[0], c[1]], [c[1], 2 * c[2]]])
                assert np.allclose(row[2:], (abs(k1 * k2), abs(k1 + k2) / 2), rtol=1e-5, atol=1e-7)
    assert fitted > 100
    assert local_shapes(points_df(spark, x).filter("false")).count() == 0


def test_nearest_within_in_blocks(spark, monkeypatch):
    """Blocks of any size give the plain nearest ones, ties by index; only they leave a task, so linings hold no window over pairs."""
    from tessera.operators import ego
    from tessera.operators import spatial as S

    monkeypatch.setattr(S, "OWN_BLOCK", 5)
    monkeypatch.setattr(S, "AROUND_BLOCK", 7)
    r = np.random.default_rng(3)
    rows = [(u, k, *map(float, np.round(x) + 0.25)) for u in range(2) for k, x in enumerate(r.normal(0, 3, (60, 3)))]
    rows += [(2, 7, 0.0, 0.0, 0.0), (3, 1, 1.0, 1.0, 1.0), (3, 2, 1.0, 1.0, 1.0), (3, 3, 1.0, 6.0, 1.0)]
    df = spark.createDataFrame(rows, "unit int, i long, px double, py double, pz double")
    want = {}
    for u, i, *x in rows:
        near = sorted((float(np.sqrt(sum((np.array(y) - x) ** 2))), j) for v, j, *y in rows if v == u and j != i and float(sum((np.array(y) - x) ** 2)) <= 25)
        if near:
            want[u, i] = (len(near), [j for _, j in near[:6]])
    got = {(x.unit, x.i): (x.n, [m.dst for m in x.near]) for x in S.nearest_within(df, 5.0, 6).collect()}
    assert got == want
    assert "Window" not in ego.linings(df)._jdf.queryExecution().optimizedPlan().toString()


def test_number_lags_by_range_frames(spark):
    """Repeated and missing numbers and nulls as by definition; rows aren't repeated for each lag."""
    from tessera.operators import windows

    rows = [(1, 1, 1.0), (1, 2, 4.0), (1, 2, 6.0), (1, 5, None), (1, 6, 2.0), (1, 8, 9.0), (2, 2, 5.0), (None, 1, 1.0), (None, 2, 3.0), (1, None, 1.0)]
    df = spark.createDataFrame(rows, "unit int, i long, x double")
    want = {}
    for u, i in {r[:2] for r in rows}:
        off = lambda k: [abs(x - y) for v, j, x in rows for o, m, y in rows if (v, j) == (u, i) and None not in (v, j, m, x, y) and v == o and abs(j - m) == k]  # noqa: B023, E731
        want[u, i] = tuple(sum(d) / len(d) if d else None for d in map(off, (1, 2)))
    out = windows.number_lags(df, "x", (1, 2))
    assert {(r.unit, r.i): (r.lag1, r.lag2) for r in out.collect()} == want
    assert not {"Generate", "Join"} & set(out._jdf.queryExecution().optimizedPlan().toString().split())
