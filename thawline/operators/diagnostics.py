"""Diagnostic series as tidy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thawline.functions.columns import area_weight


def labelled(**series: DataFrame) -> DataFrame:
    """Series of equal columns under one another, with ``series`` naming each."""
    out = None
    for name, df in series.items():
        part = df.withColumn("series", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def mean_of_reconstruction(basis: DataFrame, patterns: DataFrame) -> DataFrame:
    """(expt, variable, step, value): weighted mean of a reconstruction without making its cube.

    The mean of a sum over modes is the sum of the patterns' means; patterns that lack cells are null.
    """
    w = area_weight("lat")
    means = patterns.groupBy("expt", "variable", "mode").agg(F.when(F.count("v") == F.count("*"), F.sum(F.col("v") * w) / F.sum(w)).alias("m"))
    both = means.join(F.broadcast(basis), "mode")
    return both.groupBy("expt", "variable", "step").agg(F.when(F.count("m") == F.count("*"), F.sum(F.col("u") * F.col("m"))).alias("value"))


def period_change(fields: DataFrame, last: tuple[int, int], first: tuple[int, int]) -> DataFrame:
    """(expt, variable, cell, change): mean over steps ``last`` less mean over ``first``, both inclusive; fields with step."""
    mean = lambda p: F.avg(F.when(F.col("step").between(*p), F.col("value")))
    return fields.groupBy("expt", "variable", "cell").agg((mean(last) - mean(first)).alias("change"))


def anchored(series: DataFrame, order: str, keys: tuple[str, ...] = (), anchor: Column | None = None) -> DataFrame:
    """Values less the first one, or less the first of the rows where ``anchor`` holds."""
    rows = F.col("value") if anchor is None else F.when(anchor, F.col("value"))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return series.withColumn("value", F.col("value") - F.first(rows, ignorenulls=anchor is not None).over(w))
