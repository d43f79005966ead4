"""Experiments, the species they perturb, and the forcing that belongs to each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thawline.functions.columns import multiplier_of, species_of
from thawline.operators.forcing import TOTAL, gas_forcing

AEROSOLS = ("SO2", "BC", "OC")
#: Aerosol components and the precursor that stands for each.
COMPONENTS = {"SO4_IND": "SO2", "BMB_AEROS_BC": "BC", "BMB_AEROS_OC": "OC"}


def parse_experiments(names: DataFrame, expt: str = "expt", control: str = "base") -> DataFrame:
    """Add species and multiplier; null for the control."""
    perturbed = F.col(expt) != control
    return names.withColumns({"species": F.when(perturbed, species_of(expt)), "multiplier": F.when(perturbed, multiplier_of(expt))})


def experiment_labels(lists: DataFrame, expts: str = "expts") -> DataFrame:
    """Add label (CO2+BC) and title (Pattern with co2 and bc) of a list whose first entry is the control."""
    names = F.transform(F.slice(expts, 2, F.greatest(F.size(expts) - 1, F.lit(0))), lambda x: F.element_at(F.split(x, "x"), 1))
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    title = F.when(n > 1, F.concat(head, F.lit(" and "), F.element_at(names, -1))).otherwise(F.array_join(names, ""))
    return lists.withColumns({"label": F.upper(F.array_join(names, "+")), "title": F.concat(F.lit("Pattern with "), title)})


def plateau(series: DataFrame, start: int, length: int = 7, by: tuple[str, ...] = ("species",)) -> DataFrame:
    """Values of ``start`` and the next years set to that of ``start``; series (by, k, value)."""
    at = F.max(F.when(F.col("k") == start, F.col("value"))).over(Window.partitionBy(*by))
    return series.withColumn("value", F.when(F.col("k").between(start, start + length - 1), at).otherwise(F.col("value")))


def plateau_from(series: DataFrame, start: DataFrame, length: int = 7, by: tuple[str, ...] = ("species",)) -> DataFrame:
    """The same for a start that is known as one row (start)."""
    both = series.join(F.broadcast(start))
    at = F.max(F.when(F.col("k") == F.col("start"), F.col("value"))).over(Window.partitionBy(*by))
    inside = F.col("k").between(F.col("start"), F.col("start") + length - 1)
    return both.withColumn("value", F.when(inside, at).otherwise(F.col("value"))).drop("start")


def perturb(series: DataFrame, experiments: DataFrame, start: int, length: int = 7) -> DataFrame:
    """(expt, species, k, value): the series under each experiment.

    The experiment's species has its value of ``start`` times the multiplier for ``length`` years; others, and
    species that the series lack, are unchanged.
    """
    runs = parse_experiments(experiments.select("expt")).withColumnRenamed("species", "target")
    both = series.join(F.broadcast(runs))  # a few experiments
    at = F.max(F.when(F.col("k") == start, F.col("value"))).over(Window.partitionBy("expt", "species"))
    hit = (F.col("species") == F.col("target")) & F.col("k").between(start, start + length - 1)
    return both.withColumn("value", F.when(hit, at * F.col("multiplier")).otherwise(F.col("value"))).select("expt", "species", "k", "value")


def run_scaling(
    emissions: DataFrame, concentrations: DataFrame, gases: DataFrame, names: list[str], start: int, length: int = 7, control: str = "base"
) -> DataFrame:
    """(expt, scaling) of experiments by name: the total forcing that each's perturbation adds in the last step.

    Emissions and concentrations (species, k, value) of all species are held at their value of ``start`` for ``length`` years;
    those of an experiment's own species at that value times the multiplier. All runs, in one plan keyed by experiment,
    are driven by concentrations and end at ``start`` + 5, so that a run differs from the control by its multiplier alone.
    """
    runs = emissions.sparkSession.createDataFrame([(e,) for e in names], "expt string")
    until = lambda df: perturb(plateau(df, start, length), runs, start, length).where(F.col("k") <= start + 5)
    forcing = gas_forcing(until(emissions), until(concentrations), gases, ("expt",), conc_run=True)
    return step_scaling(forcing.groupBy("expt", "k").agg(F.sum("f").alias("f")), control)


def step_scaling(totals: DataFrame, control: str = "base") -> DataFrame:
    """(expt, scaling): last total less the control's last; totals (expt, k, f). 0 for the control."""
    last = totals.groupBy("expt").agg(F.max_by("f", "k").alias("last"))
    base = last.where(F.col("expt") == control).select(F.col("last").alias("base"))
    return last.join(F.broadcast(base)).select("expt", (F.col("last") - F.col("base")).alias("scaling"))


def _stand_in(present: Column) -> Column:
    has = lambda x: F.array_contains(present, x)
    return F.when(has("BC"), "BC").when(has("OC"), "OC").when(has("SO2"), "SO2").otherwise("CO2")


def aerosol_mapping(groups: DataFrame, present: str = "present") -> DataFrame:
    """Rows (other columns, component, target): which species' experiment an aerosol component goes with.

    A component goes with its precursor if that is present, else with black carbon, organic carbon, sulphur dioxide,
    whichever is there first, else with CO2; precursors that aren't present go the same way.
    """
    has = lambda x: F.array_contains(present, x)
    own = [F.struct(F.lit(c).alias("component"), F.when(has(p), p).otherwise(_stand_in(F.col(present))).alias("target")) for c, p in COMPONENTS.items()]
    extra = [F.when(~has(p), F.struct(F.lit(p).alias("component"), _stand_in(F.col(present)).alias("target"))) for p in AEROSOLS]
    rows = groups.withColumn("_m", F.explode(F.array_compact(F.array(*own, *extra))))
    return rows.select(*[c for c in groups.columns if c != present], "_m.component", "_m.target")


def check_experiments(experiments: list[str], control: str = "base") -> None:
    names = [e.split("x")[0].upper() for e in experiments]
    if control.upper() not in names:
        raise ValueError(f"no control experiment {control}")
    if names.count("CO2") != 1:
        raise ValueError("one CO2 experiment is needed, to which all other forcing goes")


def attribution_targets(session: SparkSession, experiments: list[str], fix_sul_alias: bool = False) -> DataFrame:
    """(species, expt): the experiment that a species' forcing goes to; species that stay with CO2 are left out.

    The first experiment of a species gets it. An experiment named ``sul`` gets none unless ``fix_sul_alias``.
    """
    check_experiments(experiments)
    names = [e.split("x")[0].upper() for e in experiments]
    if fix_sul_alias:
        names = ["SO2" if n == "SUL" else n for n in names]
    own = session.createDataFrame([(n, experiments[names.index(n)]) for n in dict.fromkeys(names)], "species string, expt string")
    present = session.createDataFrame([([n for n in names if n in AEROSOLS],)], "present array<string>")
    mapped = aerosol_mapping(present).join(own.withColumnRenamed("species", "target"), "target").select(F.col("component").alias("species"), "expt")
    return own.unionByName(mapped.join(own, "species", "left_anti"))


def attribute_forcing(forcing: DataFrame, experiments: list[str], fix_sul_alias: bool = False) -> DataFrame:
    """(expt, k, f): forcing of each experiment's species; what no experiment claims stays with the CO2 experiment.

    ``forcing``: (species, k, f) with or without the total. The experiments' sum is the total at every k.
    """
    co2 = next((e for e in experiments if e.split("x")[0].upper() == "CO2"), None)
    parts = forcing.where(F.col("species") != TOTAL)
    targets = attribution_targets(forcing.sparkSession, experiments, fix_sul_alias)  # some rows an experiment
    expt = F.coalesce(F.col("expt"), F.lit(co2))
    got = parts.join(F.broadcast(targets), "species", "left").groupBy(expt.alias("expt"), "k").agg(F.sum("f").alias("f"))
    every = forcing.select("k").distinct().withColumn("expt", F.explode(F.array(*[F.lit(e) for e in experiments])))
    return every.join(got, ["expt", "k"], "left").select("expt", "k", F.coalesce("f", F.lit(0.0)).alias("f"))
