"""Gridded files: layout, partitions, pushed filters, commits."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from thawline.sources import netcdf

ROWS = [(v, float(t), float(lat), float(lon), None if (t, lat) == (3, 30) else t + lat / 100 + lon + (v == "pr") * 1000) for v in ("tas", "pr") for t in range(8) for lat in (-30, 30) for lon in (0, 120, 240)]
DDL = "variable string, time double, lat double, lon double, value double"


@pytest.fixture
def cube(spark):
    netcdf.register(spark)
    return spark.createDataFrame(ROWS, DDL)


def as_set(df):
    return {tuple(r) for r in df.select("variable", "time", "lat", "lon", "value").collect()}


def test_written_fields_are_read_back(spark, cube, tmp_path):
    path = str(tmp_path / "fields")
    netcdf.write_fields(cube, path)
    assert as_set(spark.read.format("netcdf3").load(path)) == set(ROWS)
    netcdf.write_fields(cube.where("time < 2"), path, "overwrite")
    assert as_set(spark.read.format("netcdf3").load(path)) == {r for r in ROWS if r[1] < 2}
    assert not [f for f in os.listdir(path) if f.startswith("_")]
    netcdf.write_fields(cube.limit(0), str(tmp_path / "none"))
    assert spark.read.format("netcdf3").load(str(tmp_path / "none")).count() == 0


def test_failed_tasks_leave_nothing(spark, cube, tmp_path):
    path = str(tmp_path / "failed")
    with pytest.raises(Exception, match="can't be null"):
        netcdf.write_fields(cube.withColumn("lat", F.when(F.col("time") < 7, F.col("lat"))), path)
    assert spark.read.format("netcdf3").load(path).count() == 0
    with pytest.raises(Exception, match="no column value"):
        cube.drop("value").write.format("netcdf3").mode("append").save(path)


def test_filters_choose_variables_and_records(tmp_path):
    for v in ("tas", "pr"):
        x = np.arange(5 * 2 * 3.0).reshape(5, 2, 3)
        (tmp_path / f"{v}.nc").write_bytes(netcdf.encode(v, np.arange(10.0, 15.0), np.array([-30.0, 30.0]), np.array([0.0, 120.0, 240.0]), x))
    reader = netcdf.Reader({"path": str(tmp_path), "values": "12"})
    assert len(reader.partitions()) == 6  # two records each
    list(reader.pushFilters([EqualTo(("variable",), "pr"), GreaterThanOrEqual(("time",), 12.0), LessThan(("time",), 14.0)]))
    parts = reader.partitions()
    assert {p.variable for p in parts} == {"pr"} and min(p.first for p in parts) == 2 and sum(p.last - p.first for p in parts) <= 3
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted({r["time"] for r in got}) == [12.0, 13.0, 14.0] and got[0]["value"] == 12.0 and got[5] == {"variable": "pr", "time": 12.0, "lat": 30.0, "lon": 240.0, "value": 17.0, "path": str(tmp_path / "pr.nc")}


def other_program(path, names=("year", "latitude", "longitude")):
    """A version 1 file with fixed dimensions, packed shorts and members, as other programs write them."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = [(names[0], 2), ("ens", 2), (names[1], 2), (names[2], 1)]
    x = np.array([[[1, 2], [7, 7]], [[3, -99], [7, 7]]], ">i2")
    attributes = struct.pack(">ii", 12, 3) + text("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + text("add_offset") + struct.pack(">iid", 6, 1, 10.0) + text("_FillValue") + struct.pack(">iihh", 3, 1, -99, 0)

    def head(a, b):
        out = b"CDF\x01" + struct.pack(">iii", 0, 10, 4) + b"".join(text(n) + struct.pack(">i", k) for n, k in dims) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2)
        out += text(names[0]) + struct.pack(">iiii", 1, 0, 0, 0) + struct.pack(">iii", 4, 8, a)
        return out + text("tas") + struct.pack(">iiiii", 4, 0, 1, 2, 3) + attributes + struct.pack(">iii", 3, 16, b)

    at = len(head(0, 0))
    path.write_bytes(head(at, at + 8) + struct.pack(">ii", 1850, 1851) + x.tobytes())


def test_files_of_other_programs(spark, tmp_path):
    netcdf.register(spark)
    other_program(tmp_path / "a.nc")
    got = spark.read.format("netcdf3").load(str(tmp_path)).orderBy("time", "lat").collect()
    assert [(r.time, r.lat, r.lon, r.value) for r in got] == [(1850.0, 0.0, 0.0, 10.5), (1850.0, 1.0, 0.0, 11.0), (1851.0, 0.0, 0.0, 11.5), (1851.0, 1.0, 0.0, None)]
    other_program(tmp_path / "b.nc", ("seconds", "lat", "lon"))
    with pytest.raises(ValueError, match="time or year"):
        netcdf.axis_names(netcdf.header(str(tmp_path / "b.nc")))
    (tmp_path / "c.nc").write_bytes(b"no such file")
    with pytest.raises(ValueError, match="no NetCDF-3"):
        netcdf.header(str(tmp_path / "c.nc"))
