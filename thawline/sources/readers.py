"""Files: fields of experiments, gas tables and emission scenarios."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("gas", "em_unit", "conc_unit")]
    + [T.StructField(c, T.DoubleType()) for c in ("beta", "alpha", "tau1", "tau2", "tau3", "natural_emissions", "sarf_to_erf")]
)


def read_gas_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated gas parameters with a header; ``-`` and ``X`` units mark species without that input."""
    return spark.read.csv(path, sep="\t", header=True, schema=GAS_SCHEMA)


def melt_scenario(wide: DataFrame, index: str = "k") -> DataFrame:
    """(index, species, value) from one column a species."""
    return wide.unpivot([index], [c for c in wide.columns if c != index], "species", "value")


def read_scenario(spark: SparkSession, path: str, index: str = "year") -> DataFrame:
    """A wide tab-separated scenario, molten."""
    wide = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    return melt_scenario(wide.withColumnRenamed(wide.columns[0], index), index)


def stack_experiments(spark: SparkSession, experiments: list[str], path_of: Callable[[str], str], form: str = "parquet") -> DataFrame:
    """Fields of several experiments, each at the path that ``path_of`` gives for its name, with ``expt`` and its place in the list.

    ``form``: the files' format, as ``parquet`` or ``netcdf3`` (see :mod:`thawline.sources.netcdf`).

    Not a number becomes null, the one kind of missing value from here on.
    """
    parts = []
    for i, e in enumerate(experiments):
        df = spark.read.format(form).load(path_of(e))
        numbers = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
        parts.append(df.withColumns({**numbers, "expt": F.lit(e), "expt_idx": F.lit(i)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
