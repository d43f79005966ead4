"""Fields as one row a cell: an array of values by step. Projection and reconstruction then need no exchange.

Packing is the one exchange. The basis and its pseudo-inverse, some numbers a step and mode, come as one row of arrays; a
cell's array is as long as the training window, which bounds what a row holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("expt", "variable", "cell", "lat", "lon")


def pack(fields: DataFrame, n_steps: DataFrame) -> DataFrame:
    """(expt, variable, cell, lat, lon, xs): values by step from 0, null where a step has none; n_steps: one row (n_steps).

    Of two values of one step the greater counts.
    """
    cells = fields.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("seen"))
    held = cells.join(F.broadcast(n_steps))
    last = F.filter("seen", lambda x, i: (i == F.size("seen") - 1) | (F.get("seen", i + 1)["step"] > x["step"]))
    held = held.withColumn("seen", last).withColumn("at", F.map_from_arrays("seen.step", "seen.value"))
    steps = F.sequence(F.lit(0), F.col("n_steps").cast("int") - 1)
    return held.select(*CELL, F.transform(steps, lambda i: F.try_element_at("at", i)).alias("xs"))


def rows_of(table: DataFrame, value: str) -> DataFrame:
    """One row (modes): array of (mode, ws), the values of (step, mode, ``value``) in order of step; modes ascend."""
    by_mode = table.groupBy("mode").agg(F.array_sort(F.collect_list(F.struct("step", value))).alias("w"))
    return by_mode.agg(F.array_sort(F.collect_list(F.struct("mode", F.col(f"w.{value}").alias("ws")))).alias("modes"))


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def project_series(packed: DataFrame, weights: DataFrame) -> DataFrame:
    """(expt, variable, cell, lat, lon, vs): each mode's pattern by weights (step, mode, w). A cell that lacks any step is null in all modes."""
    vs = F.transform("modes", lambda m: F.struct(m["mode"].alias("mode"), _product(m["ws"], F.col("xs")).alias("v")))  # a null makes the sum null
    return packed.join(F.broadcast(rows_of(weights, "w"))).select(*CELL, vs.alias("vs"))


def patterns_of(projected: DataFrame) -> DataFrame:
    """(expt, variable, mode, cell, lat, lon, v), a row a mode."""
    return projected.select(*CELL, F.explode("vs").alias("x")).select("expt", "variable", "x.mode", "cell", "lat", "lon", "x.v")


def reconstruct_series(projected: DataFrame, basis: DataFrame) -> DataFrame:
    """(expt, variable, cell, lat, lon, xs): sum over modes of u * v by step, for a basis (step, mode, u) of the same modes."""
    by_step = basis.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("mode", "u"))).alias("us"))
    rows = by_step.agg(F.array_sort(F.collect_list(F.struct("step", F.col("us.u").alias("us")))).alias("steps"))
    xs = F.transform("steps", lambda s: _product(s["us"], F.col("vs.v")))
    return projected.join(F.broadcast(rows)).select(*CELL, xs.alias("xs"))


def unpack(packed: DataFrame) -> DataFrame:
    """(expt, variable, step, cell, lat, lon, value), a row a step."""
    return packed.select(*CELL, F.posexplode("xs").alias("step", "value")).select("expt", "variable", "step", "cell", "lat", "lon", "value")
