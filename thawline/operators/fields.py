"""Gridded training fields: members, climatology, anomalies, first steps and gaps.

Fields are long: (expt, variable, time, cell, lat, lon, value); null is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["variable", "cell"]


def time_name(df: DataFrame) -> str:
    return _first(df, ("time", "year"), "time")


def lat_name(df: DataFrame) -> str:
    return _first(df, ("lat", "latitude"), "latitude")


def _first(df: DataFrame, names: tuple[str, ...], kind: str) -> str:
    for n in names:
        if n in df.columns:
            return n
    raise RuntimeError(f"Couldn't find a {kind} coordinate")


def ensemble_first(fields: DataFrame) -> DataFrame:
    """First member only."""
    return fields.where("ens = 0").drop("ens")


def control_climatology(fields: DataFrame, control: str = "base") -> DataFrame:
    """Mean over all times of the control, missing values skipped."""
    return fields.where(F.col("expt") == control).groupBy(*CELL).agg(F.avg("value").alias("climatology"))


def anomaly(fields: DataFrame, control: str = "base") -> DataFrame:
    """Every experiment less the control's climatology; cells without one are null."""
    return fields.join(control_climatology(fields, control), CELL, "left").withColumn("value", F.col("value") - F.col("climatology")).drop("climatology")


def make_anom(experiment: DataFrame, control: DataFrame, fill: bool = True) -> DataFrame:
    """(expt, variable, time, lat, lon, value): an experiment less a control's mean, on cells that both have.

    ``fill``: every cell of their grid has a row, gaps filled from the nearest value along latitudes, then longitudes.
    """
    mean = control.groupBy(*CELL).agg(F.avg("value").alias("climatology"))
    out = experiment.join(mean, CELL).withColumn("value", F.col("value") - F.col("climatology"))
    out = out.select("expt", "variable", "time", "lat", "lon", "value")
    return nearest_fill(nearest_fill(on_full_grid(out), "lat"), "lon") if fill else out


def time_axis(fields: DataFrame) -> DataFrame:
    """(time, step): position of each time on the axis of all experiments, from 0. A row a time."""
    return fields.select("time").distinct().withColumn("step", F.row_number().over(Window.orderBy("time")) - 1)


def first_steps(fields: DataFrame, most: int = 100) -> DataFrame:
    """The first steps by position on the time axis, with ``step``."""
    return fields.join(time_axis(fields), "time").where(F.col("step") < most)


def field_gate(fields: DataFrame, most: int = 100) -> DataFrame:
    """(expt, variable, n_values) of fields with any value in the first steps."""
    return first_steps(fields, most).groupBy("expt", "variable").agg(F.count("value").alias("n_values")).where("n_values > 0")


def on_full_grid(fields: DataFrame) -> DataFrame:
    """Fields with a row, if null, for each cell at each time of the experiment."""
    keys = ["expt", "variable"]
    lats, lons = fields.select("lat").distinct(), fields.select("lon").distinct()
    grid = fields.select(*keys, "time").distinct().join(F.broadcast(lats)).join(F.broadcast(lons))  # the axes of one grid
    return grid.join(fields.select(*keys, "time", "lat", "lon", "value"), [*keys, "time", "lat", "lon"], "left")


def nearest_fill(grid: DataFrame, along: str) -> DataFrame:
    """Fill nulls from the nearest value along an axis between known values; ties from the lower side, none outside."""
    others = [c for c in ("expt", "variable", "time", "lat", "lon") if c != along]
    w = Window.partitionBy(*others).orderBy(along)
    known = F.when(F.col("value").isNotNull(), F.struct(F.col(along).alias("at"), F.col("value").alias("x")))
    before = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = grid.withColumns({"_b": before, "_a": after})
    near = F.when(F.col(along) - F.col("_b.at") <= F.col("_a.at") - F.col(along), F.col("_b.x")).otherwise(F.col("_a.x"))
    return df.withColumn("value", F.when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), near)).drop("_a", "_b")
