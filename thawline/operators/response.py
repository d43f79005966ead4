"""Exponential response series: basis, convolution with forcing, projection of fields and reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thawline.functions.columns import faded_sums, response

#: Parameters used where none were fitted: mode, amplitude, time scale.
FIXED = ((0, 3.0, 10.0), (1, 1.5, 100.0))


def fixed_params(df: DataFrame) -> DataFrame:
    """(mode, s, tau) from constants."""
    return df.sparkSession.createDataFrame(list(FIXED), "mode int, s double, tau double")


def exp_basis(steps: DataFrame, params: DataFrame) -> DataFrame:
    """(step, mode, u): each mode's response at each step; other columns of ``params`` stay. Parameters are a few rows a field."""
    return steps.join(F.broadcast(params)).withColumn("u", response(F.col("step").cast("double"), "s", "tau")).drop("s", "tau")


def exp_sum(steps: DataFrame, params: DataFrame) -> DataFrame:
    """(step, total): the modes' sum."""
    return exp_basis(steps, params).groupBy("step").agg(F.sum("u").alias("total"))


def weighted_residual(data: DataFrame, params: DataFrame, weights: Column) -> DataFrame:
    """``data`` (step, mode, value and others) with the residual from the basis, weighted by mode, in place of the value."""
    basis = exp_basis(data.select("step").distinct(), params)
    return data.join(basis, ["step", "mode"]).withColumn("residual", weights * (F.col("value") - F.col("u"))).drop("value", "u")


def forcing_increments(forcing: DataFrame, step: float | Column = 7.41, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, d): change to the next point over the forcing step; 0 at the end. A step of 0 gives null.

    k counts points from 0 in the order of the given k.
    """
    w = Window.partitionBy(*keys).orderBy("k")
    size = F.lit(step) if isinstance(step, float) else step
    change = F.coalesce(F.lead("f").over(w) - F.col("f"), F.lit(0.0))
    return forcing.select(*keys, (F.row_number().over(w) - 1).alias("k"), F.try_divide(change, size).alias("d"))


def pc_convolution(increments: DataFrame, params: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, mode, y): sum over j <= k of d_j times the mode's response at k - j. A join on the range j <= k.

    ``params`` may carry the keys too; its other columns stay.
    """
    given = [c for c in params.columns if c not in ("s", "tau")]
    kernel = increments.select(*keys, F.col("k").alias("j"), "d")
    points = increments.select(*keys, "k")
    pairs = points.join(kernel, [*keys] or F.lit(True)).where("j <= k")
    shared = [c for c in keys if c in params.columns]
    both = pairs.join(F.broadcast(params), shared) if shared else pairs.join(F.broadcast(params))
    term = F.col("d") * response((F.col("k") - F.col("j")).cast("double"), "s", "tau")
    return both.groupBy(*keys, *[c for c in given if c not in keys], "k").agg(F.sum(term).alias("y"))


def pc_recursion(increments: DataFrame, params: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same in n * log2(n) steps for n points, one array a series: z = (z + s * d) * exp(-1 / tau), y = s * sum(d) - z."""
    w = Window.partitionBy(*keys).orderBy("k")
    begun, unknown = F.row_number().over(w) > 1, F.col("d").isNull()
    zero = F.when(unknown, F.lit(None).cast("double")).otherwise(0.0)
    held = increments.withColumns(
        {"x": F.when(begun, F.lag("d").over(w)).otherwise(zero), "sum": F.when(begun, F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1))).otherwise(zero)}
    )
    point = F.struct(F.col("k").cast("double").alias("t"), "x", "sum")
    series = held.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("points"))
    shared = [c for c in keys if c in params.columns]
    both = series.join(F.broadcast(params), shared) if shared else series.join(F.broadcast(params))
    moved = F.transform("points", lambda p: F.struct(p.t.alias("t"), (F.col("s") * p.x * F.exp(-1 / F.col("tau"))).alias("x")))
    both = both.withColumn("z", faded_sums(moved, "tau"))
    y = F.zip_with("points", "z", lambda p, z: F.col("s") * p.sum - z.x)
    return both.select(*keys, *[c for c in params.columns if c not in (*keys, "s", "tau")], F.posexplode(y).alias("k", "y"))


def projection_weights(basis: DataFrame) -> DataFrame:
    """(step, mode, w): rows of the pseudo-inverse of a basis of one or two modes, by its normal equations."""
    wide = basis.groupBy("step").agg(*[F.coalesce(F.max(F.when(F.col("mode") == m, F.col("u"))), F.lit(0.0)).alias(f"u{m}") for m in (0, 1)])
    gram = wide.agg(F.sum(F.col("u0") * F.col("u0")).alias("a"), F.sum(F.col("u0") * F.col("u1")).alias("b"), F.sum(F.col("u1") * F.col("u1")).alias("c"))
    both = wide.join(F.broadcast(gram))  # one row
    two = F.col("c") > 0
    det = F.when(two, F.col("a") * F.col("c") - F.col("b") * F.col("b")).otherwise(F.col("a"))
    w0 = F.when(two, F.col("c") * F.col("u0") - F.col("b") * F.col("u1")).otherwise(F.col("u0")) / det
    w1 = F.when(two, (F.col("a") * F.col("u1") - F.col("b") * F.col("u0")) / det)
    out = both.select("step", F.explode(F.array(F.struct(F.lit(0).alias("mode"), w0.alias("w")), F.struct(F.lit(1).alias("mode"), w1.alias("w")))).alias("x"))
    return out.select("step", "x.mode", "x.w").where("w is not null")


def project(fields: DataFrame, weights: DataFrame, n_steps: Column | int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Patterns (expt, variable, mode, cell, lat, lon, v) of fields with ``step``. A cell that lacks any step is null in all modes."""
    both = fields.join(F.broadcast(weights), ["step", *keys])
    n = n_steps if isinstance(n_steps, Column) else F.lit(n_steps)
    whole = F.count("value") == n
    return both.groupBy("expt", "variable", "mode", "cell", "lat", "lon").agg(F.when(whole, F.sum(F.col("w") * F.col("value"))).alias("v"))


def reconstruct(basis: DataFrame, patterns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(expt, variable, step, cell, lat, lon, value): sum over modes of u * v; ``keys``: what basis and patterns share besides mode."""
    both = patterns.join(F.broadcast(basis), ["mode", *keys])
    return both.groupBy("expt", "variable", "step", "cell", "lat", "lon").agg(_all(F.col("u") * F.col("v")).alias("value"))


def _all(x: Column) -> Column:
    """Sum, null if any term is."""
    return F.when(F.count(x) == F.count("*"), F.sum(x))


def pattern_map(patterns: DataFrame, most: int = 20) -> DataFrame:
    """The first modes' patterns."""
    return patterns.where(F.col("mode") < most)


def quadratic_forcing(forcing: DataFrame, a: float, b: float) -> DataFrame:
    """Forcing replaced by a * f + b * f^2."""
    return forcing.withColumn("f", a * F.col("f") + b * F.col("f") * F.col("f"))
