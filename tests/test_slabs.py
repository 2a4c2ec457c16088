"""Volumes read from files in slabs."""

from __future__ import annotations

import gzip
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.session import shared_dir
from tessera.sources import slabs, volumes

SHAPE = (4, 5, 6)


@pytest.fixture(scope="module")
def folder(spark):
    """Six gzipped volumes, each with other axes, one plain one, and files of other kinds."""
    r = np.random.default_rng(1)
    values = {f"v{k}": np.round(r.standard_normal(SHAPE), 3).astype(np.float32) for k in range(6)}
    rows = [(u, int(x), int(y), int(z), float(v[x, y, z]), int(u[1]), 1.0) for u, v in values.items() for x, y, z in np.ndindex(SHAPE)]
    path = shared_dir(spark, "slabs")
    df = spark.createDataFrame(rows, "unit string, x int, y int, z int, value float, turn int, voxel double")
    assert slabs.write_volumes(df, path, SHAPE).count() == 6
    local = Path(path.removeprefix("file://"))
    (local / "plain.mrc").write_bytes(gzip.decompress(slabs.encoded(values["v0"], (2, 3, 1), 0.5)))
    (local / "notes.txt").write_text("no volume")
    return path, values | {"plain": values["v0"]}


@pytest.mark.parametrize("n", [1, 2, 4, 50])
def test_voxels(spark, folder, n):
    path, values = folder
    got = {(r.unit, r.x, r.y, r.z): r.value for r in slabs.density(spark, path, slabs=n).collect()}
    assert got == {(u, *at): float(v[at]) for u, v in values.items() for at in np.ndindex(SHAPE)}


def test_files_hold_what_the_other_reader_finds(folder):
    path, values = folder
    for f in Path(path.removeprefix("file://")).glob("*.map.gz"):
        assert np.array_equal(volumes.volume(gzip.decompress(f.read_bytes())), values[f.name.split(".")[0]])


@pytest.mark.parametrize("where", ["z >= 2 and z < 4", "unit = 'v3'", "unit in ('v1', 'plain') and y = 3", "x > 1 and x <= 2", "z = 9", "z < 0", "unit = 'none'", "value > 0 and z > 1 and z > 2"])
def test_filters_choose_rows(spark, folder, where):
    path, _ = folder
    every = slabs.density(spark, path)
    kept = every.filter(where)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, spark.createDataFrame(every.collect(), every.schema).filter(where).collect()))


def test_filters_spare_files_and_sections(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    path, values = folder
    reader = slabs.DensityReader(path, 3, False)
    assert len(reader.partitions()) == 3 * len(values)
    asked = [EqualTo(("unit",), "v0"), GreaterThanOrEqual(("z",), 2), LessThan(("z",), 3)]
    assert list(reader.pushFilters(asked)) == asked
    parts = reader.partitions()
    assert {p.unit for p in parts} == {"v0"} and len(parts) == 3
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == SHAPE[0] * SHAPE[1]  # v0's slowest axis is z


def test_headers(spark, folder):
    path, _ = folder
    got = {r.unit: r for r in slabs.density(spark, path, "header").collect()}
    assert (got["v0"].nx, got["v0"].mapc, got["v0"].crystallographic, got["v0"].voxel) == (4, 1, False, 1.0)
    assert (got["v1"].nx, got["v1"].maps, got["v1"].crystallographic) == (6, 1, True)
    assert got["plain"].voxel == 0.5 and len(got) == 7


def test_damaged_files_raise(spark):
    path = shared_dir(spark, "damaged")
    local = Path(path.removeprefix("file://"))
    local.mkdir(parents=True)
    whole = gzip.decompress(slabs.encoded(np.zeros(SHAPE, np.float32), (1, 2, 3), 1.0))
    (local / "short.map").write_bytes(whole[:-7])
    with pytest.raises(Exception, match="ends before its last section"):
        slabs.density(spark, path).collect()
    (local / "short.map").write_bytes(b"x" * 2000)
    with pytest.raises(Exception, match="not a density volume"):
        slabs.density(spark, path).agg(F.sum("value")).collect()
