"""Area weights and means over the globe. The three means differ where cells are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thawline.functions.columns import area_weight, floored_weight

SERIES = ["expt", "variable", "time"]


def weights(fields: DataFrame) -> DataFrame:
    return fields.select("lat").distinct().withColumn("weight", area_weight("lat"))


def weights_2d(fields: DataFrame) -> DataFrame:
    return fields.select("lat", "lon").distinct().withColumn("weight", floored_weight("lat"))


def weights_3d(fields: DataFrame) -> DataFrame:
    return weights_2d(fields).join(F.broadcast(fields.select("time").distinct()))  # one axis


def _mean_weight(fields: DataFrame) -> DataFrame:
    """One row: mean weight over the grid's latitudes."""
    return weights(fields).agg(F.avg("weight").alias("mean_weight"))


def _normalised(fields: DataFrame) -> DataFrame:
    return fields.join(F.broadcast(_mean_weight(fields))).withColumn("x", F.col("value") * area_weight("lat") / F.col("mean_weight"))


def fit_mean(fields: DataFrame) -> DataFrame:
    """Weighted, mean over latitudes for each longitude, then over longitudes."""
    by_lon = _normalised(fields).groupBy(*SERIES, "lon").agg(F.avg("x").alias("x"))
    return by_lon.groupBy(*SERIES).agg(F.avg("x").alias("value"))


def global_mean(fields: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Weighted by weights that average 1 over the latitudes, then a plain mean over all cells; ``keep``: further keys."""
    return _normalised(fields).groupBy(*SERIES, *keep).agg(F.avg("x").alias("value"))


def weighted_mean(fields: DataFrame) -> DataFrame:
    """Weights count only where there is a value."""
    w = area_weight("lat")
    known = F.when(F.col("value").isNotNull(), w)
    return fields.groupBy(*SERIES).agg((F.sum(F.col("value") * w) / F.sum(known)).alias("value"))


def amplitude_guess(fields: DataFrame) -> DataFrame:
    """Unweighted: mean over latitudes, then longitudes, then times."""
    by_lon = fields.groupBy(*SERIES, "lon").agg(F.avg("value").alias("x"))
    by_time = by_lon.groupBy(*SERIES).agg(F.avg("x").alias("x"))
    return by_time.groupBy("expt", "variable").agg(F.avg("x").alias("amplitude"))
