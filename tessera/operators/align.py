"""Global alignment of string pairs, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MATCH, MISMATCH, GAP = 2, -1, -3
OUT = "key bigint, score int, n_pairs int, identity double, at_a array<int>, at_b array<int>"


def align(a: str, b: str) -> tuple[int, list[tuple[int, int]]]:
    """Score of the best global alignment and its identical pairs; ties prefer a pair, then a gap in b."""
    rows = [[GAP * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        up, own = rows[-1], [GAP * i]
        for j, y in enumerate(b, 1):
            own.append(max(up[j - 1] + (MATCH if x == y else MISMATCH), up[j] + GAP, own[j - 1] + GAP))
        rows.append(own)
    i, j, same = len(a), len(b), []
    while i and j:
        step = MATCH if a[i - 1] == b[j - 1] else MISMATCH
        if rows[i][j] == rows[i - 1][j - 1] + step:
            i, j = i - 1, j - 1
            if step == MATCH:
                same.append((i, j))
        elif rows[i][j] == rows[i - 1][j] + GAP:
            i -= 1
        else:
            j -= 1
    return rows[-1][-1], same[::-1]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        found = [align(a or "", b or "") + (min(len(a or ""), len(b or "")),) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([x.column("key").cast(pa.int64()), pa.array([f[0] for f in found], pa.int32()), pa.array([len(f[1]) for f in found], pa.int32()), pa.array([len(f[1]) / f[2] if f[2] else None for f in found], pa.float64()), pa.array([[p[0] for p in f[1]] for f in found], pa.list_(pa.int32())), pa.array([[p[1] for p in f[1]] for f in found], pa.list_(pa.int32()))], ["key", "score", "n_pairs", "identity", "at_a", "at_b"])


def alignments(pairs: DataFrame) -> DataFrame:
    """key, score, n_pairs, identity (pairs over the shorter length; null if that is 0), places of the pairs. pairs: key, a, b."""
    return pairs.select("key", "a", "b").mapInArrow(_run, OUT)
