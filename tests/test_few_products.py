"""Lowest modes take few products with the matrix, since the part of the points with few others about them is solved whole."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import graph, linear


def counted(monkeypatch, module):
    """What each product takes: its number of columns."""
    columns, lowest = [], module.lowest

    def counting(times, *rest, **more):
        def one(v):
            columns.append(v.shape[1])
            return times(v)

        return lowest(one, *rest, **more)

    monkeypatch.setattr(module, "lowest", counting)
    return columns


def cloud(n):
    return np.random.default_rng(7).standard_normal((n, 3)) * 3.75


def test_low_modes_take_few_products(monkeypatch):
    monkeypatch.setattr(graph, "WHOLE", 0)
    columns = counted(monkeypatch, graph)
    graph.low_modes(cloud(2000), 10.0, 8)
    assert len(columns) < 25 and sum(columns) < 250


def test_soft_modes_take_few_products(monkeypatch):
    columns = counted(monkeypatch, linear)
    linear.soft_modes(cloud(1000), 6, 14.0)
    assert len(columns) < 80 and sum(columns) < 800


@pytest.mark.parametrize("r", [0.4, 1.0, 6.0])
def test_parts_are_those_of_single_links(r):
    x = cloud(300)
    x[40:60] += 90
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= r * r
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.where(near, label[None], len(x)).min(1)
    assert (graph.connected_parts(x, r) == np.unique(label, return_inverse=True)[1]).all()
    assert len(graph.connected_parts(x[:0], r)) == 0
