"""Density volumes with a 1024-byte header, from binary columns (binaryFile or made)."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {0: "<i1", 1: "<i2", 2: "<f4", 6: "<u2"}
HEADER = "unit string, nx int, ny int, nz int, mode int, mapc int, mapr int, maps int, voxel double, crystallographic boolean"


def header(raw: bytes) -> dict:
    if len(raw) < 1024 or raw[208:212] not in (b"MAP ", b"MAP\0"):
        raise ValueError("not a density volume")
    n = struct.unpack("<10i", raw[:40])
    size = struct.unpack("<3f", raw[40:52])
    axes = struct.unpack("<3i", raw[64:76])
    return {"n": n[:3], "mode": n[3], "grid": n[7:10], "size": size, "axes": axes, "extra": struct.unpack("<i", raw[92:96])[0]}


def volume(raw: bytes) -> np.ndarray:
    """The values, axes in the order x, y, z."""
    h = header(raw)
    data = np.frombuffer(raw, KINDS[h["mode"]], int(np.prod(h["n"])), 1024 + h["extra"]).reshape(h["n"][::-1])
    return np.transpose(data, [2 - h["axes"].index(k) for k in (1, 2, 3)])


def opened(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def _rows(f, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([f(u, opened(c)) for u, c in zip(b.column("unit").to_pylist(), b.column("content").to_pylist(), strict=True)], schema)

    return run


def headers(files: DataFrame, fine: float = 0.7) -> DataFrame:
    """Header fields; crystallographic: a fine voxel or axes out of their usual order. files: unit, content."""

    def of(unit, raw):
        h = header(raw)
        voxel = h["size"][0] / max(h["grid"][0], 1)
        return {"unit": unit, "nx": h["n"][0], "ny": h["n"][1], "nz": h["n"][2], "mode": h["mode"], "mapc": h["axes"][0], "mapr": h["axes"][1], "maps": h["axes"][2], "voxel": voxel, "crystallographic": voxel < fine or h["axes"] != (1, 2, 3)}

    schema = pa.schema([("unit", pa.string()), *((c, pa.int32()) for c in ("nx", "ny", "nz", "mode", "mapc", "mapr", "maps")), ("voxel", pa.float64()), ("crystallographic", pa.bool_())])
    return files.selectExpr("cast(unit as string) unit", "content").mapInArrow(_rows(of, schema), HEADER)


def summaries(files: DataFrame) -> DataFrame:
    """Mean, spread and extremes of each volume."""

    def of(unit, raw):
        v = volume(raw).astype(float)
        return {"unit": unit, "n": v.size, "mean": v.mean(), "sd": v.std(), "low": v.min(), "high": v.max(), "corner": v[0, 0, -1]}

    schema = pa.schema([("unit", pa.string()), ("n", pa.int64()), *((c, pa.float64()) for c in ("mean", "sd", "low", "high", "corner"))])
    return files.selectExpr("cast(unit as string) unit", "content").mapInArrow(_rows(of, schema), "unit string, n long, mean double, sd double, low double, high double, corner double")


def made(shape: tuple[int, int, int], axes: tuple[int, int, int], seed: int, voxel: float = 1.0) -> bytes:
    """A small volume for tests and examples."""
    head = bytearray(1024)
    n = tuple(shape[a - 1] for a in axes)
    head[:40] = struct.pack("<10i", *n, 2, 0, 0, 0, *shape)
    head[40:52] = struct.pack("<3f", *(s * voxel for s in shape))
    head[64:76] = struct.pack("<3i", *axes)
    head[208:212] = b"MAP "
    x = np.random.default_rng(seed).standard_normal(shape).astype("<f4")
    return bytes(head) + np.ascontiguousarray(np.transpose(x, [axes[2] - 1, axes[1] - 1, axes[0] - 1])).tobytes()
