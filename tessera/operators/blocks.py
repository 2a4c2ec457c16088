"""Gram matrices too wide for one task or the driver: square blocks as rows.

A table has a class y and an array x of K numbers a row, to which a leading 1 is
added, so that counts and sums are entries too. A block (y, a, b), a <= b, holds
the products of the columns of strips a and b, as the bytes of doubles. Tasks add
up blocks over their own rows; strips go in passes, so that a task holds at most
HELD bytes of blocks whatever K is, and rows are never shuffled. Systems are
solved by conjugate gradients: each step multiplies the stored blocks by a vector
of K numbers, and only such vectors meet the driver.

Rows whose x is null or of another length raise; a null number in x makes the
entries of its column NaN.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored

HELD = 64 << 20
BLOCKS = "y bigint, a int, b int, data binary"


def _columns(lists: pa.Array, width: int) -> np.ndarray:
    """A leading 1 and the numbers of each row; a row of another length raises."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(x) != len(lists) * width:
        raise ValueError(f"rows of x should hold {width} numbers")
    return np.column_stack([np.ones(len(lists)), x.reshape(len(lists), width)])


def _partial(width: int, strip: int, rows: range):
    """Sums of products of the strips in rows with all strips from them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, y = _columns(batch.column("x"), width), batch.column("y").to_numpy(zero_copy_only=False)
            for v in np.unique(y):
                own = x[y == v]
                for a in rows:
                    g = own[:, a * strip : (a + 1) * strip].T @ own[:, a * strip :]
                    key = int(v), a
                    held[key] = held[key] + g if key in held else g
        for (v, a), g in held.items():
            for at in range(0, g.shape[1], strip):
                data = np.ascontiguousarray(g[:, at : at + strip]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()), pa.array([a], pa.int32()), pa.array([a + at // strip], pa.int32()), pa.array([data], pa.binary())], ["y", "a", "b", "data"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: one block a key, the sum of its parts, one part in memory at a time."""
    key, total = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), *(pa.array([k], pa.int32()) for k in key[1:]), pa.array([total.tobytes()], pa.binary())], ["y", "a", "b", "data"])

    for batch in batches:
        for v, a, b, data in zip(*(batch.column(c).to_pylist() for c in ("y", "a", "b", "data")), strict=True):
            if (v, a, b) != key:
                if key:
                    yield out()
                key, total = (v, a, b), np.zeros(len(data) // 8)
            total += np.frombuffer(data)
    if key:
        yield out()


@dataclass
class Gram:
    """Blocks of each class, stored; width counts the columns without the leading 1."""

    blocks: DataFrame
    width: int
    strip: int

    def sizes(self) -> list[int]:
        """Columns in each strip, the leading 1 counted."""
        return [min(self.strip, self.width + 1 - at) for at in range(0, self.width + 1, self.strip)]

    def first_rows(self) -> dict[int, np.ndarray]:
        """Count and sums of each class: K + 1 numbers a class."""
        sizes, out = self.sizes(), {}
        for r in self.blocks.filter("a = 0").collect():
            row = out.setdefault(r["y"], np.zeros(self.width + 1))
            row[r["b"] * self.strip :][: sizes[r["b"]]] = np.frombuffer(r["data"]).reshape(sizes[0], -1)[0]
        return out

    def scatter(self) -> DataFrame:
        """y, a, b, s for columns a >= b, counted from 0: sums of products of differences from the class means."""
        first, sizes, strip = self.first_rows(), self.sizes(), self.strip

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for v, a, b, data in zip(*(batch.column(c).to_pylist() for c in ("y", "a", "b", "data")), strict=True):
                    g, s = np.frombuffer(data).reshape(sizes[a], sizes[b]), first[v]
                    i, j = a * strip + np.arange(sizes[a])[:, None] - 1, b * strip + np.arange(sizes[b])[None] - 1
                    value = g - np.outer(s[i + 1].ravel(), s[j + 1].ravel()) / s[0]
                    at = np.nonzero((i >= 0) & (j >= i))
                    i, j = (np.broadcast_to(k, g.shape)[at] for k in (i, j))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), v), pa.int64()), pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(value[at])], ["y", "a", "b", "s"])

        return self.blocks.mapInArrow(run, "y bigint, a int, b int, s double")

    def times(self, vectors: dict[int, np.ndarray]) -> np.ndarray:
        """Sum over classes of the class's Gram matrix times its vector: one pass over the stored blocks."""
        sizes, strip, width = self.sizes(), self.strip, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width + 1)
            for batch in batches:
                for v, a, b, data in zip(*(batch.column(c).to_pylist() for c in ("y", "a", "b", "data")), strict=True):
                    g, x = np.frombuffer(data).reshape(sizes[a], sizes[b]), vectors[v]
                    total[a * strip :][: sizes[a]] += g @ x[b * strip :][: sizes[b]]
                    if a != b:
                        total[b * strip :][: sizes[b]] += x[a * strip :][: sizes[a]] @ g
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        parts = self.blocks.mapInArrow(run, "part binary").collect()
        return reduce(np.add, (np.frombuffer(p["part"]) for p in parts), np.zeros(width + 1))


def gram_blocks(df: DataFrame, width: int, y: str = "y", x: str = "x", strip: int = 256) -> Gram:
    """The Gram matrix of each class of df, in blocks of strip columns."""
    rows = df.select(F.col(y).cast("long").alias("y"), F.col(x).cast("array<double>").alias("x"))
    n = -(-(width + 1) // strip)
    each = max(1, HELD // (8 * strip * (width + 1)))
    parts = [rows.mapInArrow(_partial(width, strip, range(at, min(at + each, n))), BLOCKS) for at in range(0, n, each)]
    by_key = reduce(DataFrame.unionByName, parts).repartition("y", "a", "b").sortWithinPartitions("y", "a", "b")
    return Gram(stored(by_key.mapInArrow(_added, BLOCKS), "gram"), width, strip)


def conjugate_gradients(times, right: np.ndarray, tolerance: float = 1e-10, most: int = 1000) -> np.ndarray:
    """x with A x = right for a symmetric positive A, given by its products with vectors."""
    x, left = np.zeros_like(right), right.copy()
    way, size = left.copy(), left @ left
    for _ in range(most):
        if np.sqrt(size) <= tolerance * np.sqrt(right @ right):
            return x
        image = times(way)
        step = size / (way @ image)
        x, left = x + step * way, left - step * image
        before, size = size, left @ left
        way = left + size / before * way
    raise RuntimeError(f"no solution within {most} steps")


def wide_ridge(gram: Gram, right: dict[int, float], ridge: float) -> np.ndarray:
    """Coefficients of a ridge regression of a value by class (right) on standardised columns; constant columns get 0.

    The correlation matrix comes from the blocks as they are multiplied: no
    matrix of K x K numbers is ever made whole.
    """
    first = gram.first_rows()
    n = sum(r[0] for r in first.values())
    mean = sum(r[1:] for r in first.values()) / n
    value = sum(right[v] * r[0] for v, r in first.items()) / n
    square = _diagonal(gram) / n
    sd = np.sqrt(np.maximum(square - mean**2, 0))
    live = sd > 1e-9 * np.sqrt(np.maximum(square, 1e-300))
    scale = np.where(live, 1 / np.where(live, sd, 1), 0)
    cross = sum((right[v] - value) * r[1:] for v, r in first.items()) / n * scale

    def times(w: np.ndarray) -> np.ndarray:
        u = scale * w
        x = np.append(0.0, u)
        got = gram.times(dict.fromkeys(first, x))[1:] / n - mean * (mean @ u)
        return scale * got + ridge * w

    return conjugate_gradients(times, cross)


def _diagonal(gram: Gram) -> np.ndarray:
    """Sums of squares of the columns over all classes."""
    sizes, strip = gram.sizes(), gram.strip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, data in zip(batch.column("a").to_pylist(), batch.column("data").to_pylist(), strict=True):
                g = np.frombuffer(data).reshape(sizes[a], sizes[a])
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([np.diag(g).tobytes()], pa.binary())], ["a", "d"])

    out = np.zeros(gram.width + 1)
    for r in gram.blocks.filter("a = b").mapInArrow(run, "a int, d binary").collect():
        out[r["a"] * strip :][: sizes[r["a"]]] += np.frombuffer(r["d"])
    return out[1:]
