"""The given star-schema tables, and gridded fields, forcing and emissions made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Experiment of a return flag; species of an order priority.
EXPERIMENTS = {"N": "base", "A": "co2x2", "R": "sulx5"}
SPECIES = {"1-URGENT": "CO2", "2-HIGH": "SO2", "3-MEDIUM": "BC", "4-NOT SPECIFIED": "OC", "5-LOW": "CH4"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(names: dict[str, str], column: str) -> Column:
    pairs = list(names.items())
    out = F.when(F.col(column) == pairs[0][0], pairs[0][1])
    for k, v in pairs[1:]:
        out = out.when(F.col(column) == k, v)
    return out


def month_index(date: str) -> Column:
    return ((F.year(date) - 1995) * 12 + F.month(date) - 1).cast("int")


STEPS = {
    "monthly": lambda: month_index("l_shipdate"),
    "annual": lambda: (F.year("l_shipdate") - 1995).cast("int"),
    "weekly": lambda: F.floor(F.datediff("l_shipdate", F.lit("1995-01-02").cast("date")) / 7).cast("int"),
}


def fields(spark: SparkSession, sf_dir: str, step: str = "monthly", members: bool = False) -> DataFrame:
    """Gridded fields (expt, variable[, ens], time, cell, lat, lon, value): mean quantity and price by flag, time and nation.

    One aggregation of the line items, partial before the shuffle; suppliers and nations are dimension tables.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_extendedprice")
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    places = places.select("s_suppkey", F.col("n_regionkey").alias("row"), F.floor(F.col("n_nationkey") / F.lit(5.0)).cast("int").alias("col"))
    keys = ["expt", *(["ens"] if members else []), "time", "cell", "lat", "lon"]
    rows = lines.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        _named(EXPERIMENTS, "l_returnflag").alias("expt"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("ens"),
        STEPS[step]().alias("time"),
        (F.col("row") * 5 + F.col("col")).cast("int").alias("cell"),
        (F.col("row") * 30.0 - 60.0).cast("double").alias("lat"),
        (F.col("col") * 72.0).cast("double").alias("lon"),
        "l_quantity",
        "l_extendedprice",
    )
    cube = rows.groupBy(*keys).agg(F.avg("l_quantity").alias("tas"), F.avg("l_extendedprice").alias("pr"))
    return cube.unpivot(keys, ["tas", "pr"], "variable", "value")


def forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forcing series (k, f): mean order total by month."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(month_index("o_orderdate").alias("k")).agg((F.avg("o_totalprice") / 1e5).alias("f"))


def species_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forcing series of species (species, k, f), zero where a month has none."""
    orders = table(spark, sf_dir, "orders").select(_named(SPECIES, "o_orderpriority").alias("species"), month_index("o_orderdate").alias("k"), "o_totalprice")
    known = orders.groupBy("species", "k").agg((F.avg("o_totalprice") / 1e5).alias("f"))
    every = known.select("species").distinct().join(known.select("k").distinct())
    return every.join(known, ["species", "k"], "left").select("species", "k", F.coalesce("f", F.lit(0.0)).alias("f"))


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions, wide: (k, a column a species), zero where a month has none."""
    orders = table(spark, sf_dir, "orders").select(_named(SPECIES, "o_orderpriority").alias("species"), month_index("o_orderdate").alias("k"), "o_totalprice")
    wide = orders.groupBy("k").pivot("species", list(SPECIES.values())).agg(F.sum("o_totalprice"))
    return wide.fillna(0.0)


def concentrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentrations (species, k, value) of the species that have one: by mean order total of a month."""
    orders = table(spark, sf_dir, "orders").select(_named(SPECIES, "o_orderpriority").alias("species"), month_index("o_orderdate").alias("k"), "o_totalprice")
    return orders.where(F.col("species").isin("CO2", "CH4")).groupBy("species", "k").agg((F.avg("o_totalprice") / 1e4 + 250.0).alias("value"))


def gases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of gases in the form of a gas file, its parameters from sizes and prices of parts."""
    kinds = F.array(*[F.lit(x) for x in SPECIES.values()])
    parts = table(spark, sf_dir, "part").select(F.get(kinds, F.col("p_size").cast("int") % 5).alias("gas"), "p_size", "p_retailprice")
    means = parts.groupBy("gas").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))
    zero, aerosol = F.lit(0.0), F.col("gas").isin("SO2", "BC", "OC")
    return means.select(
        "gas", F.lit("Tg").alias("em_unit"), F.when(aerosol, "-").otherwise("ppm").alias("conc_unit"), (F.col("price") / 500).alias("beta"), zero.alias("alpha"),
        F.col("size").cast("double").alias("tau1"), zero.alias("tau2"), zero.alias("tau3"), F.lit(1.5).alias("natural_emissions"), (F.col("size") / 25).alias("sarf_to_erf"),
    )


def noise_free_fields(spark: SparkSession, sf_dir: str, tau: float = 6.0) -> DataFrame:
    """Annual fields of a control that stays at each cell's mean, and of an experiment that adds a response of one time scale to it."""
    f = fields(spark, sf_dir, "annual").where("expt = 'base'")
    amplitude = f.groupBy("variable", "cell", "lat", "lon").agg(F.avg("value").alias("a"))
    steps = f.select("time").distinct()
    both = amplitude.join(F.broadcast(steps))  # one axis
    first = steps.agg(F.min("time").alias("first"))
    both = both.join(F.broadcast(first)).withColumn("rise", F.col("a") * (1 - F.exp((F.col("first") - F.col("time")) / F.lit(tau))))
    own = lambda e, x: both.select(F.lit(e).alias("expt"), "variable", "time", "cell", "lat", "lon", x.alias("value"))
    return own("base", F.col("a")).unionByName(own("co2x2", F.col("a") + F.col("rise")))
