"""Column expressions of area weights, responses, fading sums and experiment names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def area_weight(lat: Column | str) -> Column:
    """Cosine of the latitude in degrees."""
    return F.cos(F.radians(_c(lat)))


def floored_weight(lat: Column | str) -> Column:
    """The same, from 0.01 at the poles to 1."""
    return area_weight(lat) * 0.99 + 0.01


def response(t: Column | str, s: Column | str, tau: Column | str) -> Column:
    """Saturating exponential s * (1 - exp(-t / tau)): 0 at t = 0."""
    return _c(s) * (F.lit(1.0) - F.exp(-_c(t) / _c(tau)))


def species_of(expt: Column | str, sulphate: str = "SUL") -> Column:
    """Species that an experiment such as co2x2 perturbs; SUL stands for SO2 unless ``sulphate`` is empty."""
    name = F.upper(F.element_at(F.split(_c(expt), "x"), 1))
    return F.when(name == "SUL", "SO2").otherwise(name) if sulphate else name


def multiplier_of(expt: Column | str) -> Column:
    """Whole-number factor of the perturbation; a name without one raises, as does one that isn't whole."""
    return F.element_at(F.split(_c(expt), "x"), 2).cast("int")


def faded_sums(points: Column | str, tau: Column | str) -> Column:
    """Of an array of (t, x), ascending in t: with each t the sum of all x so far, faded by exp(-(time since) / tau).

    By doubling: after each round a sum reaches twice as many points back, so n points take n * log2(n) steps and no
    array grows.
    """
    points, size = _c(points), F.size(_c(points))
    rounds = F.ceil(F.log2(size.cast("double"))).cast("int")

    def doubled(z: Column, s: Column) -> Column:
        back = F.pow(F.lit(2.0), s).cast("int")

        def one(p: Column, i: Column) -> Column:
            q = F.get(z, i - back)
            more = p.x + q.x * F.exp((q.t - p.t) / _c(tau))
            return F.when(i >= back, F.struct(p.t.alias("t"), more.alias("x"))).otherwise(p)

        return F.transform(z, one)

    return F.when(size > 1, F.aggregate(F.sequence(F.lit(0), rounds - 1), points, doubled)).otherwise(points)
