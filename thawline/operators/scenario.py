"""The pattern model: train on gridded experiments, predict fields for forcing series and scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thawline.operators import area, experiments, fields, fit, forcing, response

FIELD = ("expt", "variable")


@dataclass
class PatternModel:
    """params (expt, variable, mode, s, tau, ...), patterns (expt, variable, mode, cell, lat, lon, v), steps (expt, step_size)."""

    params: DataFrame
    patterns: DataFrame
    steps: DataFrame

    @classmethod
    def fit(cls, cubes: DataFrame, modes: DataFrame, steps: DataFrame, control: str = "base", max_steps: int = 100, loss: str = "quartic") -> PatternModel:
        """Train on ``cubes`` (expt, variable, time, cell, lat, lon, value) for ``modes`` (variable, n_modes).

        Fields without any value in the first ``max_steps`` steps are left out.
        """
        if cubes.where(F.col("expt") == control).isEmpty():
            raise ValueError(f"no control experiment {control}")
        kept = fields.first_steps(fields.anomaly(cubes, control), max_steps).join(F.broadcast(modes.select("variable")), "variable", "left_semi")
        kept = kept.join(fields.field_gate(kept.drop("step"), max_steps).select(*FIELD), list(FIELD), "left_semi")
        axis = fields.time_axis(cubes).where(F.col("step") < max_steps)
        series = area.fit_mean(kept).join(F.broadcast(axis), "time").select(*FIELD, "step", "value")
        params = fit.fit_timescales(series, area.amplitude_guess(kept), modes, loss)
        basis = response.exp_basis(axis.select("step"), params.select(*FIELD, "mode", "s", "tau"))
        n = axis.agg(F.count("*").alias("n_steps"))
        both = kept.join(F.broadcast(n)).join(fit.pseudo_inverse(basis), [*FIELD, "step"])
        whole = F.count("value") == F.first("n_steps")
        patterns = both.groupBy(*FIELD, "mode", "cell", "lat", "lon").agg(F.when(whole, F.sum(F.col("w") * F.col("value"))).alias("v"))
        return cls(params, patterns, steps)

    @classmethod
    def train(
        cls, cubes: DataFrame, modes: DataFrame, names: list[str], emissions: DataFrame, concentrations: DataFrame, gases: DataFrame, start: int, control: str = "base", **fitting
    ) -> PatternModel:
        """Train on the experiments ``names`` of ``cubes``; the step that each was forced by comes from a run of its name's perturbation.

        An experiment that changes no species of the emissions or concentrations has a step of 0, and null predictions.
        """
        experiments.check_experiments(names, control)
        steps = experiments.run_scaling(emissions, concentrations, gases, names, start, control=control).withColumnRenamed("scaling", "step_size")
        return cls.fit(cubes.where(F.col("expt").isin(names)), modes, steps, control, **fitting)

    def save(self, path: str) -> PatternModel:
        """Write the model's tables under ``path``; the one returned reads them, so that nothing is fitted again."""
        for name in ("params", "patterns", "steps"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return PatternModel.load(self.params.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PatternModel:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("params", "patterns", "steps")))

    def predict(self, forcing: DataFrame, variable: str, expt: str, year_0: int = 1850) -> DataFrame:
        """(expt, variable, time, cell, lat, lon, value) for a forcing series (k, f) that acts as ``expt`` does."""
        rows = self._predict(forcing.withColumn("expt", F.lit(expt)), [variable])
        return rows.withColumn("time", F.col("k") + year_0).drop("k")

    def predict_scenario(self, forcing: DataFrame, names: list[str], variables: list[str], control: str = "base", year_0: int = 1850) -> DataFrame:
        """(variable, time, cell, lat, lon, value): sum over experiments for species forcing (species, k, f) of a scenario."""
        experiments.check_experiments(names, control)
        shares = experiments.attribute_forcing(forcing, names).where(F.col("expt") != control)
        out = self._predict(shares, variables, ("variable",))
        return out.withColumn("time", year_stamp(F.col("k") + year_0)).drop("k")

    def predict_emissions(
        self, emissions: DataFrame, concentrations: DataFrame, gases: DataFrame, names: list[str], variables: list[str], conc_run: bool = False,
        emission_steps: int = 100, last: int = 2100, control: str = "base", year_0: int = 1850,
    ) -> DataFrame:
        """(variable, time, cell, lat, lon, value) of a scenario of emissions and concentrations (species, k, value) up to step ``last``.

        Concentrations drive the first ``emission_steps`` steps. With ``conc_run`` they drive all, and from there on both
        stay at their value for seven steps.
        """
        until = lambda df: df.where(F.col("k") <= last)
        emissions, concentrations = until(emissions), until(concentrations)
        if conc_run:
            begin = emissions.agg((F.min("k") + emission_steps).alias("start"))  # one row
            emissions, concentrations = (experiments.plateau_from(df, begin) for df in (emissions, concentrations))
        shares = forcing.gas_forcing(emissions, concentrations, gases, emission_steps=emission_steps, conc_run=conc_run)
        return self.predict_scenario(shares, names, variables, control, year_0)

    def _predict(self, forcing: DataFrame, variables: list[str], by: tuple[str, ...] = FIELD) -> DataFrame:
        own = lambda df: df.where(F.col("variable").isin(variables))
        return predict(forcing, own(self.params).select(*FIELD, "mode", "s", "tau"), own(self.patterns), self.steps, by)


def predict(forcing: DataFrame, params: DataFrame, patterns: DataFrame, steps: DataFrame, by: tuple[str, ...] = FIELD) -> DataFrame:
    """(by, k, cell, lat, lon, value) for forcing (expt, k, f), steps (expt, step_size); ``by``: what is told apart, (variable) adds experiments up.

    Series are convolved before cells come in, so the cube is made once, by one join and one sum over modes, and
    experiments where they are added up. A value is null where any part of it is; a step size of 0 gives null.
    """
    sized = forcing.join(F.broadcast(steps), "expt")
    moved = response.forcing_increments(sized, F.col("step_size"), ("expt",))
    pcs = response.pc_recursion(moved, params, ("expt",)).withColumnRenamed("y", "u")
    both = pcs.join(patterns, ["expt", "variable", "mode"])
    return both.groupBy(*by, "k", "cell", "lat", "lon").agg(response._all(F.col("u") * F.col("v")).alias("value"))


def year_stamp(year: Column) -> Column:
    one = F.lit(1)
    return F.make_timestamp(year.cast("int"), one, one, F.lit(0), F.lit(0), F.lit(0).cast("double"))
