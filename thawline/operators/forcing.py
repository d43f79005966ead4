"""Forcing of species from emissions and concentrations.

Any table (species, k, f) can take the place of these. ``species_forcing`` is a plain one-box approximation: emissions
decay with one time scale and act with one efficiency, CO2 by the logarithm. ``gas_forcing`` takes the boxes from a table
of gases and concentrations where they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thawline.functions.columns import faded_sums

TOTAL = "Total_forcing"

#: species: (time scale in steps, efficiency a unit of the box). Round numbers for illustration.
BOXES = {"CO2": (100.0, 5.35), "CH4": (12.0, 0.4), "SO2": (1.0, -0.3), "BC": (1.0, 0.1), "OC": (1.0, -0.05)}


def natural_emissions(years: DataFrame, ch4: float = 242.09, n2o: float = 242.09) -> DataFrame:
    """(k, species, value): constant natural emissions. Both defaults are the same number."""
    return years.select("k").distinct().select("k", F.explode(F.create_map(F.lit("CH4"), F.lit(ch4), F.lit("N2O"), F.lit(n2o))).alias("species", "value"))


def species_forcing(emissions: DataFrame, keys: tuple[str, ...] = (), boxes: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(keys, species, k, f) from (keys, species, k, value); species without a box are left out."""
    rows = [(s, *x) for s, x in (boxes or BOXES).items()]
    known = emissions.join(F.broadcast(emissions.sparkSession.createDataFrame(rows, "species string, tau double, power double")), "species")
    own = [*keys, "species"]
    box = faded_sums("points", "tau")
    point = F.struct(F.col("k").cast("double").alias("t"), F.col("value").cast("double").alias("x"))
    held = known.groupBy(*own, "tau", "power").agg(F.array_sort(F.collect_list(point)).alias("points"))
    held = held.select(*own, "power", F.explode(box).alias("p")).select(*own, F.col("p.t").cast("int").alias("k"), "power", F.col("p.x").alias("box"))
    f = F.when(F.col("species") == "CO2", F.col("power") * F.log1p(F.col("box"))).otherwise(F.col("power") * F.col("box"))
    return held.select(*own, "k", f.alias("f"))


#: Species without a concentration: forcing a unit of emissions. Round numbers for illustration.
LINEAR = {"SO2": -0.3, "BC": 0.1, "OC": -0.05}


def gas_forcing(
    emissions: DataFrame, concentrations: DataFrame, gases: DataFrame, keys: tuple[str, ...] = (), emission_steps: int = 100, conc_run: bool = False,
    natural: DataFrame | None = None, linear: dict[str, float] | None = None,
) -> DataFrame:
    """(keys, species, k, f) from emissions and concentrations (keys, species, k, value) and ``gases`` as ``read_gas_table`` gives them.

    Concentrations drive the first ``emission_steps`` steps of a series, all with ``conc_run``; from then on a box of the
    gas's time scale goes on from the last concentration, filled by emissions and ``natural`` ones (species, k, value; else
    the gas table's). Forcing is that since the first step: by the logarithm for CO2, by the square root for CH4 and N2O
    (the usual simple expressions), by ``alpha`` for other gases, in proportion to emissions for species of ``linear``,
    each times ``sarf_to_erf``. Other species, and steps without what drives them, are left out. A step is a year.
    """
    session, own = emissions.sparkSession, [*keys, "species"]
    given = emissions.select(*own, "k", F.col("value").alias("e")).join(concentrations.select(*own, "k", F.col("value").alias("c")), [*own, "k"], "full")
    rows = given.join(gases.withColumnRenamed("gas", "species"), "species")
    if natural is not None:
        rows = rows.join(natural.select("species", "k", F.col("value").alias("n")), ["species", "k"], "left")
    else:
        rows = rows.withColumn("n", F.lit(None).cast("double"))
    factors = session.createDataFrame(list((linear or LINEAR).items()), "species string, factor double")
    rows = rows.join(F.broadcast(factors), "species", "left")
    begin = F.min("k").over(Window.partitionBy(*own))
    rows = rows.withColumn("driven", F.lit(conc_run) | (F.col("k") < begin + emission_steps)).withColumn("last", F.col("k") == begin + emission_steps - 1)
    fade = 1 - F.exp(-1 / F.col("tau1"))
    inflow = F.try_divide(F.coalesce("e", F.lit(0.0)) + F.coalesce("n", "natural_emissions", F.lit(0.0)), F.col("beta")) * F.col("tau1") * fade
    x = F.when(F.col("last"), F.coalesce("c", F.lit(0.0))).when(F.col("driven"), 0.0).otherwise(F.coalesce(inflow, F.lit(0.0)))
    rows = rows.withColumn("p", F.struct(F.col("k").cast("double").alias("t"), x.alias("x"), "e", "c", "driven"))
    told = ["conc_unit", "alpha", "sarf_to_erf", "tau1", "factor"]
    held = rows.groupBy(*own).agg(F.array_sort(F.collect_list("p")).alias("ps"), *[F.first(c).alias(c) for c in told])
    held = held.withColumn("box", faded_sums(F.transform("ps", lambda p: F.struct(p.t.alias("t"), p.x.alias("x"))), F.greatest("tau1", F.lit(1e-9))))
    c = F.zip_with("ps", "box", lambda p, b: F.struct(p.t.cast("int").alias("k"), p.e.alias("e"), F.when(p.driven, p.c).otherwise(b.x).alias("c")))
    at = held.withColumn("s", c).withColumn("c0", F.get("s", F.lit(0)).c).withColumn("e0", F.get("s", F.lit(0)).e)
    at = at.select(*own, *told, "c0", "e0", F.explode("s").alias("p")).select("*", "p.k", F.col("p.e").alias("e"), F.col("p.c").alias("c")).drop("p")
    is_gas, root = F.col("conc_unit") != "-", F.sqrt("c") - F.sqrt("c0")
    f = (
        F.when(is_gas & (F.col("species") == "CO2"), 5.35 * F.log(F.col("c") / F.col("c0"))).when(is_gas & (F.col("species") == "CH4"), 0.036 * root)
        .when(is_gas & (F.col("species") == "N2O"), 0.12 * root).when(is_gas & (F.col("alpha") > 0), F.col("alpha") * (F.col("c") - F.col("c0")))
        .when(~is_gas & F.col("factor").isNotNull(), F.col("factor") * (F.col("e") - F.col("e0")))
    )
    return at.select(*own, "k", (f * F.col("sarf_to_erf")).alias("f")).where("f is not null")


def with_total(forcing: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    total = forcing.groupBy(*keys, "k").agg(F.sum("f").alias("f")).withColumn("species", F.lit(TOTAL))
    return forcing.select(*keys, "species", "k", "f").unionByName(total)


def forcing_stack(forcing: DataFrame, species: list[str]) -> DataFrame:
    """One column a species, all but the last of ``species``, and the row's total of them."""
    kept = species[:-1]
    wide = forcing.where(F.col("species").isin(kept)).groupBy("k").pivot("species", kept).agg(F.sum("f"))
    return wide.withColumn("stack", sum((F.coalesce(F.col(s), F.lit(0.0)) for s in kept), F.lit(0.0)))
