"""A data source for folders of density volumes, plain or gzipped, read in slabs of sections.

    spark.read.format("density").option("slabs", 8).load(folder)

gives a row a voxel: unit (the file's name without its endings), x, y, z (places
along the physical axes) and value. With option("what", "header") it gives a row a
file. A partition is one slab of one file: its task reads the header, works out
which sections are its own, skips those before (a gzipped file has to be read from
its start, in small pieces) and yields the others one at a time, so no file is
held whole. Only names are listed on the driver. Filters on unit choose files, and
bounds on x, y and z choose sections where the file's slowest axis is that one.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tessera.sources.volumes import HEADER, KINDS, header

ENDINGS = (".map", ".map.gz", ".mrc", ".mrc.gz")
VOXELS = "unit string, x int, y int, z int, value double"
PIECE = 1 << 20


@dataclass
class Slab(InputPartition):
    unit: str
    path: str
    number: int


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else "file://" + uri)


def unit_of(name: str) -> str | None:
    return next((name[: -len(e)] for e in sorted(ENDINGS, key=len, reverse=True) if name.endswith(e)), None)


class DensityReader(DataSourceReader):
    def __init__(self, path: str, slabs: int, heads: bool):
        self.path, self.slabs, self.heads = path, slabs, heads
        self.units: set[str] | None = None
        self.bounds: dict[str, list[int | None]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes what can spare files or sections; Spark still applies every filter to the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("unit",):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.units = found if self.units is None else self.units & found
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("x",), ("y",), ("z",)):
                low, high = self.bounds.setdefault(f.attribute[0], [None, None])
                least = f.value + isinstance(f, GreaterThan) if not isinstance(f, (LessThan, LessThanOrEqual)) else None
                most = f.value - isinstance(f, LessThan) if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else None
                self.bounds[f.attribute[0]] = [max((v for v in (low, least) if v is not None), default=None), min((v for v in (high, most) if v is not None), default=None)]
            yield f

    def partitions(self) -> list[Slab]:
        store, folder = place(self.path)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and unit_of(f.base_name) is not None)
        named = [(unit_of(f.rpartition("/")[2]), f) for f in files]
        return [Slab(u, f, k) for u, f in named if self.units is None or u in self.units for k in range(1 if self.heads else self.slabs)]

    def read(self, part: Slab | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file is left to read
            return
        store, _ = place(self.path)
        with store.open_input_stream(part.path, compression=None) as raw:
            f = gzip.GzipFile(fileobj=raw) if part.path.endswith(".gz") else raw
            head = f.read(1024)
            yield from self._header(part, head) if self.heads else self._sections(part, head, f)

    def _header(self, part: Slab, head: bytes) -> Iterator[pa.RecordBatch]:
        h = header(head)
        voxel = h["size"][0] / max(h["grid"][0], 1)
        row = [part.unit, *h["n"], h["mode"], *h["axes"], voxel, voxel < 0.7 or h["axes"] != (1, 2, 3)]
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        names, types = zip(*(c.split() for c in HEADER.split(", ")), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, t in zip(row, types, strict=True)], list(names))

    def _sections(self, part: Slab, head: bytes, f) -> Iterator[pa.RecordBatch]:
        h = header(head)
        columns, rows, sections = h["n"]
        kind = np.dtype(KINDS[h["mode"]])
        size = columns * rows * kind.itemsize
        first, last = part.number * sections // self.slabs, (part.number + 1) * sections // self.slabs
        names = ["xyz"[a - 1] for a in h["axes"]]
        low, high = self.bounds.get(names[2], [None, None])
        first, last = max(first, low or 0), last if high is None else min(last, high + 1)
        if first >= last:
            return
        skip = h["extra"] + first * size
        while skip > 0:
            skip -= len(f.read(min(PIECE, skip)) or exhausted(part))
        row, column = (v.ravel().astype(np.int32) for v in np.mgrid[0:rows, 0:columns])
        for section in range(first, last):
            data = b""
            while len(data) < size:
                data += f.read(size - len(data)) or exhausted(part)
            at = {names[0]: column, names[1]: row, names[2]: np.full(len(row), section, np.int32)}
            yield pa.RecordBatch.from_arrays([pa.array([part.unit] * len(row)), *(pa.array(at[c]) for c in "xyz"), pa.array(np.frombuffer(data, kind).astype(float))], ["unit", "x", "y", "z", "value"])


def exhausted(part: Slab) -> bytes:
    raise ValueError(f"{part.path} ends before its last section")


class DensitySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "density"

    def schema(self) -> str:
        return HEADER if self.options.get("what") == "header" else VOXELS

    def reader(self, schema) -> DensityReader:
        return DensityReader(self.options["path"], int(self.options.get("slabs", 4)), self.options.get("what") == "header")


def density(spark: SparkSession, folder: str, what: str = "voxels", slabs: int = 4) -> DataFrame:
    """Voxels or headers of the volumes in a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DensitySource)
    return spark.read.format("density").option("what", what).option("slabs", slabs).load(folder)


def encoded(values: np.ndarray, axes: tuple[int, int, int], voxel: float) -> bytes:
    """A gzipped volume of float values with places x, y, z; axes say which of those is the file's fastest, middle and slowest."""
    head = bytearray(1024)
    n = [values.shape[a - 1] for a in axes]
    head[:40] = struct.pack("<10i", *n, 2, 0, 0, 0, *values.shape)
    head[40:52] = struct.pack("<3f", *(s * voxel for s in values.shape))
    head[64:76] = struct.pack("<3i", *axes)
    head[208:212] = b"MAP "
    body = np.ascontiguousarray(np.transpose(values.astype("<f4"), [axes[2] - 1, axes[1] - 1, axes[0] - 1]))
    return gzip.compress(bytes(head) + body.tobytes(), mtime=0)


def write_volumes(rows: DataFrame, folder: str, shape: tuple[int, int, int]) -> DataFrame:
    """Writes one file a unit from rows (unit, x, y, z, value, turn, voxel): turn picks the order of axes, places without a row are NaN.

    A unit's rows are at most the voxels of its shape. Files get their names when
    they are complete. Returns unit and file.
    """
    turns = ((1, 2, 3), (3, 2, 1), (2, 1, 3), (1, 3, 2), (2, 3, 1), (3, 1, 2))

    def of(key, p):
        import pandas as pd

        v = np.full(shape, np.nan, np.float32)
        v[p.x, p.y, p.z] = p.value
        store, path = place(folder)
        store.create_dir(path, recursive=True)
        name, part = f"{path}/{key[0]}.map.gz", f"{path}/.{key[0]}.{np.random.default_rng().integers(2**62)}"
        with store.open_output_stream(part, compression=None) as out:
            out.write(encoded(v, turns[int(p.turn.iloc[0]) % 6], float(p.voxel.iloc[0])))
        store.move(part, name)
        return pd.DataFrame({"unit": [key[0]], "file": [name]})

    return rows.groupBy("unit").applyInPandas(of, "unit string, file string")
