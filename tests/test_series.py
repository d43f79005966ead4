"""Fields as one row a cell."""

import numpy as np
from pyspark.sql import functions as F

from thawline.operators import response, series


def test_cell_series(spark, tmp_path):
    rng = np.random.RandomState(4)
    x = rng.randn(2, 3, 6)
    rows = [(e, "tas", s, c, 10.0 * c, 0.0, float(x[i, c, s])) for i, e in enumerate(("base", "co2x2")) for c in range(3) for s in range(6) if (i, c, s) != (0, 1, 4)]
    rows += [("co2x2", "tas", 2, 0, 0.0, 0.0, -99.0), ("co2x2", "tas", 9, 2, 20.0, 0.0, 7.0), ("base", "tas", 3, 5, 50.0, 0.0, None)]
    spark.createDataFrame(rows, "expt string, variable string, step int, cell int, lat double, lon double, value double").write.parquet(str(tmp_path / "cube"))
    cube = spark.read.parquet(str(tmp_path / "cube"))
    packed = series.pack(cube, spark.createDataFrame([(6,)], "n_steps long"))
    got = {(r.expt, r.cell): r.xs for r in packed.collect()}
    assert got["co2x2", 0] == list(x[1, 0]) and got["co2x2", 2] == list(x[1, 2]) and got["base", 1][4] is None and got["base", 5] == [None] * 6
    steps = spark.range(6).select(F.col("id").cast("int").alias("step"))
    basis = response.exp_basis(steps, response.fixed_params(steps))
    projected = series.project_series(packed, response.projection_weights(basis))
    u = np.array([[s * (1 - np.exp(-k / t)) for _, s, t in response.FIXED] for k in range(6)])
    v = {(r.expt, r.cell, r.mode): r.v for r in series.patterns_of(projected).collect()}
    assert len(v) == 14 and v["base", 1, 0] is None and v["base", 5, 1] is None
    again = {(r.expt, r.cell, r.step): r.value for r in series.unpack(series.reconstruct_series(projected, basis)).collect()}
    assert len(again) == 42 and again["base", 1, 0] is None
    for i, e in enumerate(("base", "co2x2")):
        for c in range(3):
            if (i, c) != (0, 1):
                expect = np.linalg.pinv(u) @ x[i, c]
                np.testing.assert_allclose([v[e, c, m] for m in (0, 1)], expect, atol=1e-6)
                np.testing.assert_allclose([again[e, c, k] for k in range(6)], u @ expect, atol=1e-8)


def test_packing_is_the_only_exchange_of_cells(spark, tmp_path):
    cube = spark.range(600).selectExpr("'base' expt", "'tas' variable", "cast(id % 6 as int) step", "cast(id div 6 as int) cell", "0D lat", "0D lon", "cast(id as double) value")
    cube.write.parquet(str(tmp_path / "cube"))
    basis = response.exp_basis(spark.range(6).selectExpr("cast(id as int) step"), response.fixed_params(cube))
    for name, table in (("w", response.projection_weights(basis)), ("b", basis)):
        table.write.parquet(str(tmp_path / name))
    packed = series.pack(spark.read.parquet(str(tmp_path / "cube")), spark.createDataFrame([(6,)], "n_steps long"))
    projected = series.project_series(packed, spark.read.parquet(str(tmp_path / "w")))
    plan = series.unpack(series.reconstruct_series(projected, spark.read.parquet(str(tmp_path / "b"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(expt") == 1 and "SortMergeJoin" not in plan
