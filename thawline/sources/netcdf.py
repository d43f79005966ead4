"""Gridded files in the classic NetCDF-3 format, as a Spark data source.

``spark.read.format("netcdf3").load(path)`` gives a row a value: (variable, time, lat, lon, value, path), coordinates as
double, missing values null. A path is a file, a folder or a glob in a folder that all executors share (the format is read by seeking in
open files). Partitions are planned on the driver from the headers alone: a range of records of a variable in a file.
Filters on variable and time are pushed: other variables' and records' bytes aren't read. A partition reads and
yields blocks of bounded size.

``df.write.format("netcdf3").save(folder)`` writes a file a variable and task. Each task writes a file of its own under a
temporary name, and the driver's commit renames them, so that repeated or failed tasks leave nothing behind. The files of
a folder are read as one table, so rows need not be gathered before they are written.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

SCHEMA = T.StructType(
    [T.StructField("variable", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("time", "lat", "lon", "value")], T.StructField("path", T.StringType())]
)
#: Fixed values of the format: tags of the header's lists, and the types of values by number.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
FILL = {1: -127, 3: -32767, 4: -2147483647, 5: 9.9692099683868690e36, 6: 9.9692099683868690e36}
NAMES = {"time": ("time", "year"), "lat": ("lat", "latitude"), "lon": ("lon", "longitude")}
#: Values that a partition holds at once.
BLOCK = 1 << 18


@dataclass
class Variable:
    """dims: names; kind: number of the type; begin: place of the first value; record: whether it has a part in each record."""

    name: str
    dims: list[str]
    attributes: dict[str, object]
    kind: int
    size: int
    begin: int
    record: bool


@dataclass
class Header:
    dims: dict[str, int]  # 0: the records' dimension
    records: int
    variables: dict[str, Variable]
    record_size: int


class _Bytes:
    def __init__(self, f):
        self.f = f

    def number(self, kind: str = ">i4"):
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.f.read(size), kind)[0].item()

    def padded(self, n: int) -> bytes:
        data = self.f.read(n)
        self.f.read(-n % 4)
        return data

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def items(self, tag: int) -> range:
        found, n = self.number(), self.number()
        if found not in (0, tag):
            raise ValueError(f"list {tag} expected in the header, {found} found")
        return range(n if found else 0)

    def attributes(self) -> dict[str, object]:
        out = {}
        for _ in self.items(ATTRIBUTES):
            name, kind, n = self.name(), self.number(), self.number()
            data = self.padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = data.decode() if kind == 2 else np.frombuffer(data, TYPES[kind]).tolist()
        return out


def header(path: str) -> Header:
    """What a file's header says; versions 1 and 2 (64-bit places)."""
    with open(path, "rb") as f:
        b = _Bytes(f)
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError(f"{path} is no NetCDF-3 file")
        records = max(0, b.number())  # -1: unknown, of a stream
        dims = [(b.name(), b.number()) for _ in b.items(DIMENSIONS)]
        b.attributes()
        variables = {}
        for _ in b.items(VARIABLES):
            name, n = b.name(), b.number()
            ids = [b.number() for _ in range(n)]
            attributes, kind, size = b.attributes(), b.number(), b.number(">u4")
            begin = b.number(">i8" if magic[3] == 2 else ">i4")
            variables[name] = Variable(name, [dims[i][0] for i in ids], attributes, kind, size, begin, bool(ids) and dims[ids[0]][1] == 0)
        in_records = [v for v in variables.values() if v.record]
        of_dims = dict(dims)
        if len(in_records) == 1:  # one variable's records aren't padded
            v = in_records[0]
            v.size = int(np.prod([of_dims[d] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize
        return Header(of_dims, records, variables, sum(v.size for v in in_records))


def values(path: str, h: Header, v: Variable, first: int, last: int) -> np.ndarray:
    """Values of ``first`` to ``last`` (exclusive) along the first dimension, missing ones NaN; other bytes aren't read."""
    kind = np.dtype(TYPES[v.kind])
    shape = [h.dims[d] or h.records for d in v.dims]
    one = int(np.prod(shape[1:], dtype=np.int64))
    with open(path, "rb") as f:
        if v.record:
            parts = []
            for r in range(first, last):
                f.seek(v.begin + r * h.record_size)
                parts.append(np.frombuffer(f.read(one * kind.itemsize), kind))
            raw = np.concatenate(parts) if parts else np.zeros(0, kind)
        else:
            f.seek(v.begin + first * one * kind.itemsize)
            raw = np.frombuffer(f.read((last - first) * one * kind.itemsize), kind)
    out = raw.astype(np.float64)
    for missing in [FILL.get(v.kind), *v.attributes.get("_FillValue", []), *v.attributes.get("missing_value", [])]:
        if missing is not None:
            out[raw == np.array(missing).astype(kind)] = np.nan
    return (out * v.attributes.get("scale_factor", [1.0])[0] + v.attributes.get("add_offset", [0.0])[0]).reshape(last - first, *shape[1:])


def axis_names(h: Header) -> dict[str, str]:
    """The file's names of time, latitude and longitude; ValueError where one is missing."""
    out = {}
    for axis, names in NAMES.items():
        found = next((n for n in names if n in h.dims), None)
        if found is None:
            raise ValueError(f"no dimension {' or '.join(names)}")
        out[axis] = found
    return out


def axis(path: str, h: Header, name: str) -> np.ndarray:
    """A dimension's coordinates, or its places where the file has none."""
    n = h.dims[name] or h.records
    v = h.variables.get(name)
    return values(path, h, v, 0, n) if v is not None and v.dims == [name] else np.arange(float(n))


@dataclass
class Records(InputPartition):
    path: str
    variable: str
    first: int
    last: int


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(f for f in glob.glob(f"{glob.escape(path)}/**/*.nc", recursive=True) if not os.path.basename(f).startswith(("_", ".")))
    return sorted(glob.glob(path))


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("values", 1 << 22))
        self.only: set[str] | None = None
        self.low, self.high = -np.inf, np.inf

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Those on variable and time choose what is read; all are applied again by Spark."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("variable",) and isinstance(f, EqualTo | In):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.only = wanted if self.only is None else self.only & wanted
            elif name == ("time",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low = max(self.low, float(f.value))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high = min(self.high, float(f.value))
            yield f

    def partitions(self) -> list[Records]:
        """Ranges of records of about ``values`` values each, from the headers and time axes."""
        out = []
        for path in _files(self.path):
            h = header(path)
            names = axis_names(h)
            t = axis(path, h, names["time"])
            inside = np.flatnonzero((t >= self.low) & (t <= self.high))
            for v in h.variables.values():
                if len(inside) and v.dims[:1] == [names["time"]] and set(v.dims) >= set(names.values()) and (self.only is None or v.name in self.only):
                    one = int(np.prod([h.dims[d] or h.records for d in v.dims[1:]]))
                    step = max(1, self.most // max(1, one))
                    out += [Records(path, v.name, a, min(a + step, int(inside[-1]) + 1)) for a in range(int(inside[0]), int(inside[-1]) + 1, step)]
        return out or [Records("", "", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        h = header(partition.path)
        names, v = axis_names(h), h.variables[partition.variable]
        t, lat, lon = (axis(partition.path, h, names[a]) for a in ("time", "lat", "lon"))
        one = int(np.prod([h.dims[d] or h.records for d in v.dims[1:]]))
        step = max(1, BLOCK // max(1, one))
        for a in range(partition.first, partition.last, step):
            b = min(a + step, partition.last)
            x = values(partition.path, h, v, a, b)
            order = [names["time"], names["lat"], names["lon"]]
            for d in [d for d in v.dims if d not in order]:  # of other dimensions, as members, the first
                x = np.take(x, 0, v.dims.index(d) if x.ndim == len(v.dims) else [y for y in v.dims if y in order or y == d].index(d))
            kept = [d for d in v.dims if d in order]
            x = np.transpose(x, [kept.index(d) for d in order])
            inside = (t[a:b] >= self.low) & (t[a:b] <= self.high)
            x, at = x[inside], t[a:b][inside]
            n = x.size
            grid = np.broadcast_arrays(at[:, None, None], lat[None, :, None], lon[None, None, :])
            flat = x.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.name] * n, pa.string()), *(pa.array(g.ravel()) for g in grid), pa.array(flat, mask=np.isnan(flat)), pa.array([partition.path] * n, pa.string())], names=SCHEMA.names
            )


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def encode(name: str, time: np.ndarray, lat: np.ndarray, lon: np.ndarray, x: np.ndarray) -> bytes:
    """A file of one variable (time, lat, lon) with records along time; missing values are the format's fill."""
    text = lambda s: struct.pack(">i", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    dims = [("time", 0), ("lat", len(lat)), ("lon", len(lon))]
    listed = [("lat", [1], lat), ("lon", [2], lon)]
    record = 8 + 8 * len(lat) * len(lon)

    def head(begins: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", len(time)) + struct.pack(">ii", DIMENSIONS, 3) + b"".join(text(n) + struct.pack(">i", k) for n, k in dims) + struct.pack(">ii", 0, 0)
        out += struct.pack(">ii", VARIABLES, 4)
        for (n, ids, size), begin in zip([("lat", [1], 8 * len(lat)), ("lon", [2], 8 * len(lon)), ("time", [0], 8), (name, [0, 1, 2], record - 8)], begins, strict=True):
            out += text(n) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + struct.pack(">ii", 0, 0) + struct.pack(">iIq", 6, min(size, 2**32 - 1), begin)
        return out

    at = len(head([0] * 4))
    begins = [at, at + 8 * len(lat), at + 8 * len(lat) + 8 * len(lon), at + 8 * len(lat) + 8 * len(lon) + 8]
    body = np.empty((len(time), 1 + len(lat) * len(lon)), ">f8")
    body[:, 0], body[:, 1:] = time, np.where(np.isnan(x), FILL[6], x).reshape(len(time), -1)
    return head(begins) + b"".join(v.astype(">f8").tobytes() for _, _, v in listed) + body.tobytes()


class Writer(DataSourceArrowWriter):
    """One file a variable and task, which holds its rows. Rows without coordinates are refused; a cell that a task has no row for is missing in its file."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"].removeprefix("file://"), schema, overwrite
        missing = {"variable", "time", "lat", "lon", "value"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names = ["variable", "time", "lat", "lon", "value"]
        rows = pa.Table.from_batches([b.select(names) for b in iterator]) if (iterator := list(iterator)) else None
        files = []
        if rows is None or not rows.num_rows:
            return Written(files)
        if any(rows.column(c).null_count for c in names[:-1]):
            raise ValueError("variable, time, lat and lon can't be null")
        os.makedirs(self.path, exist_ok=True)
        for name in rows.column("variable").unique().to_pylist():
            mine = rows.filter(pc.equal(rows.column("variable"), name))
            t, lat, lon, x = (mine.column(c).cast(pa.float64()).to_numpy() for c in names[1:])  # null is NaN
            (times, i), (lats, j), (lons, k) = (np.unique(c, return_inverse=True) for c in (t, lat, lon))
            grid = np.full((len(times), len(lats), len(lons)), np.nan)
            grid[i, j, k] = x
            final = f"{self.path}/{name}-{uuid.uuid4().hex}.nc"
            temporary = f"{self.path}/_{os.path.basename(final)}"
            with open(temporary, "wb") as f:
                f.write(encode(name, times, lats, lons, grid))
            files.append((temporary, final))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        new = {final for m in messages if m for _, final in m.files}
        old = [f for f in _files(self.path) if f not in new] if self.overwrite else []
        for m in messages:
            for temporary, final in m.files if m else ():
                os.rename(temporary, final)
        for f in old:
            os.remove(f)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for temporary, _ in m.files if m else ():
                if os.path.exists(temporary):
                    os.remove(temporary)


class NetCDF3(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("netcdf3")`` known to a session, filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetCDF3)


def write_fields(fields: DataFrame, path: str, mode: str = "append") -> None:
    """Write (variable, time, lat, lon, value) under ``path``, a few time steps of a variable to a file, so that its grid is full."""
    rows = fields.selectExpr("variable", *[f"cast({c} as double) as {c}" for c in ("time", "lat", "lon", "value")])
    rows.repartitionByRange("variable", "time").write.format("netcdf3").mode(mode).save(path)
