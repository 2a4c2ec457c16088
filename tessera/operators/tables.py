"""Count-table models: addresses, cells, read-outs, folds, small driver-side solvers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_pairs(spark, weights: DataFrame, most: int) -> DataFrame:
    """Disjoint pairs by descending weight. weights: a, b, weight over at most `most` items, checked."""
    rows = weights.select("a", "b", "weight").limit(most * most + 1).collect()
    if len(rows) > most * most:
        raise ValueError("more pairs than the bound allows")
    used: set = set()
    out = []
    for r in sorted(rows, key=lambda r: (-r["weight"], r["a"], r["b"])):
        if not used & {r["a"], r["b"]}:
            used |= {r["a"], r["b"]}
            out.append((r["a"], r["b"], r["weight"]))
    return spark.createDataFrame(out, weights.select("a", "b", "weight").schema)


def random_pairs(n: int, seed: int, rounds: int) -> list[tuple[int, int]]:
    """Pairs from seeded permutations of n wires; the odd one of a round is left out."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rounds):
        p = rng.permutation(n).tolist()
        out += [(p[k], p[k + 1]) for k in range(0, n - 1, 2)]
    return out


def address(digits: Column, base: int = 4) -> Column:
    """A word of digits, first digit lowest, as a number."""
    return F.aggregate(F.reverse(digits), F.lit(0).cast("long"), lambda a, x: a * base + x)


def unpacked(address_: Column, width: int, base: int = 4) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.pmod(F.floor(address_ / F.pow(F.lit(float(base)), k)), F.lit(base)).cast("int"))


def orbit_address(digits: Column, levels: int) -> Column:
    """The same for all orders of the digits."""
    return F.aggregate(F.array_sort(digits), F.lit(0).cast("long"), lambda a, x: a * levels + x)


def table_addresses(df: DataFrame, tables: list[tuple[str, str]], keep: list[str], base: int = 4) -> DataFrame:
    """Rows (keep..., t, addr) for each pair of digit columns."""
    entry = F.array(*[F.struct(F.lit(t).alias("t"), (F.col(a) + base * F.col(b)).cast("int").alias("addr")) for t, (a, b) in enumerate(tables)])
    return df.select(*keep, F.inline(entry))


def cells(addresses: DataFrame, y: str = "y", keys: tuple[str, ...] = ("t", "addr")) -> DataFrame:
    """Counts per occupied cell. Integer sums, partial before the shuffle: no cell is too full."""
    return addresses.groupBy(*keys).agg(F.count(F.lit(1)).alias("tot"), F.sum(y).alias("pos"))


def score_rows(addresses: DataFrame, cell: DataFrame, keys: list[str], base_rate: Column, weight: Column | None = None) -> DataFrame:
    """Sum over tables of weight * pos/tot; the base rate where a cell is empty. cell: small against the rows."""
    frac = F.coalesce(F.col("pos") / F.col("tot"), base_rate)
    j = addresses.join(cell, ["t", "addr"], "left")
    return j.groupBy(*keys).agg(F.sum(frac * (weight if weight is not None else F.lit(1.0))).alias("score"))


def gram(df: DataFrame, columns: list[str], y: str) -> dict:
    """Per class the count, means and scatter of columns, from one partial Gram per task, added in a tree.

    Returns numpy arrays {class: (n, mean, scatter)}; the driver sees one
    K x K matrix per class.
    """
    k = len(columns)

    def partial(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *(b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns)])
            label = b.column(y).to_numpy(zero_copy_only=False)
            for v in np.unique(label):
                own = x[label == v]
                total[int(v)] = total.get(int(v), 0) + own.T @ own
        yield pa.RecordBatch.from_pydict({"y": pa.array(list(total), pa.int64()), "at": pa.array([list(range((k + 1) ** 2))] * len(total), pa.list_(pa.int32())), "g": pa.array([g.ravel().tolist() for g in total.values()], pa.list_(pa.float64()))})

    parts = df.select(y, *columns).mapInArrow(partial, "y bigint, at array<int>, g array<double>")
    sums = parts.select("y", F.explode(F.arrays_zip("at", "g")).alias("e")).groupBy("y", "e.at").agg(F.sum("e.g").alias("g")).collect()  # (K + 1)^2 numbers a class
    out: dict = {}
    for r in sums:
        out.setdefault(r["y"], np.zeros((k + 1) ** 2))[r["at"]] = r["g"]
    done = {}
    for v, g in out.items():
        m = g.reshape(k + 1, k + 1)
        n, s = m[0, 0], m[0, 1:]
        done[v] = (n, s / n, m[1:, 1:] - np.outer(s, s) / n)
    return done


def fan_out(parts: dict, ridge: float, peak: int = 32) -> np.ndarray:
    """Integer weights: ridge discriminant of class 1 against 0, scaled to the peak, halves to even."""
    (n0, m0, s0), (n1, m1, s1) = parts[0], parts[1]
    s = (s0 + s1) / (n0 + n1)
    k = len(m0)
    w = np.linalg.solve(s + ridge * np.trace(s) / k * np.eye(k), m1 - m0)
    return np.rint(peak * w / np.abs(w).max()).astype(int)
