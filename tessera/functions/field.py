"""Vectors over the field of four elements (0, 1, w, w + 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def times(a: int, b: int) -> int:
    return 0 if not a or not b else (a + b - 2) % 3 + 1


def inverse(a: int) -> int:
    return (0, 1, 3, 2)[a]


def toeplitz(column: list[int], x: list[int]) -> list[int]:
    """Lower triangular Toeplitz times x."""
    out = []
    for i in range(len(x)):
        s = 0
        for j in range(i + 1):
            s ^= times(column[i - j], x[j])
        out.append(s)
    return out


def solved(column: list[int], y: list[int]) -> list[int]:
    """x with toeplitz(column, x) = y, by forward steps; column[0] must not be 0."""
    x: list[int] = []
    for i in range(len(y)):
        s = y[i]
        for j in range(i):
            s ^= times(column[i - j], x[j])
        x.append(times(inverse(column[0]), s))
    return x


def solve_rows(rows: DataFrame, seed: int = 0) -> DataFrame:
    """unit, y = T x and x solved back from y, for a seeded T. rows: unit, x (digits 0 to 3)."""

    def run(batches):
        for b in batches:
            rng = np.random.default_rng(seed)
            column = [1 + int(v) % 3 if k == 0 else int(v) for k, v in enumerate(rng.integers(0, 4, 256))]
            xs = [[int(v) for v in x] for x in b.column("x").to_pylist()]
            ys = [toeplitz(column, x) for x in xs]
            yield pa.RecordBatch.from_arrays([b.column("unit").cast(pa.int64()), pa.array(ys, pa.list_(pa.int32())), pa.array([solved(column, y) for y in ys], pa.list_(pa.int32()))], ["unit", "y", "x"])

    return rows.mapInArrow(run, "unit bigint, y array<int>, x array<int>")
