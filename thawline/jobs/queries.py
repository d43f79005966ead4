"""One query for each operator, over fields, forcing and emissions made of the given tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thawline.functions.columns import response
from thawline.operators import area, diagnostics, experiments, fields, fit, forcing, scenario, series
from thawline.operators import response as resp
from thawline.sources import netcdf, readers, tables

FORCING_STEP = 4.08
STEP_SIZES = (("co2x2", 4.08), ("sulx5", -2.5))
MODES = (("tas", 2), ("pr", 3))
EXPERIMENTS = ["base", "co2x2", "sulx5"]
START = 40


def _r(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def _modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODES), "variable string, n_modes int")


def ensemble_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fields.ensemble_first(tables.fields(spark, sf_dir, members=True)), "value", digits=6)


def control_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fields.control_climatology(tables.fields(spark, sf_dir)), "climatology")


def anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fields.anomaly(tables.fields(spark, sf_dir)), "value").select("expt", "variable", "time", "cell", "value")


def first_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fields.first_steps(tables.fields(spark, sf_dir, "weekly")), "value", digits=6).select("expt", "variable", "step", "cell", "value")


def field_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.field_gate(tables.fields(spark, sf_dir, "weekly"))


def make_anom(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.fields(spark, sf_dir)
    return _r(fields.make_anom(f.where("expt <> 'base'"), f.where("expt = 'base'")), "value").select("expt", "variable", "time", "lat", "lon", "value")


def nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = fields.on_full_grid(tables.fields(spark, sf_dir))
    out = fields.nearest_fill(fields.nearest_fill(grid, "lat"), "lon")
    return _r(out, "value", digits=6).select("expt", "variable", "time", "lat", "lon", "value")


def area_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(area.weights(tables.fields(spark, sf_dir)), "weight", digits=6)


def area_weight_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(area.weights_2d(tables.fields(spark, sf_dir)), "weight", digits=6)


def area_weight_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(area.weights_3d(tables.fields(spark, sf_dir)), "weight", digits=6)


def fit_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(area.fit_mean(tables.fields(spark, sf_dir)), "value")


def global_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(area.global_mean(tables.fields(spark, sf_dir, members=True), ("ens",)), "value")


def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(area.weighted_mean(tables.fields(spark, sf_dir)), "value")


def amplitude_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(area.amplitude_guess(tables.fields(spark, sf_dir)), "amplitude")


def initial_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fit.initial_params(area.amplitude_guess(tables.fields(spark, sf_dir)), _modes(spark)), "s")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.time_axis(tables.fields(spark, sf_dir)).select("step")


def exp_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("step").cast("double")
    return _steps(spark, sf_dir).select("step", F.round(response(t, F.lit(5.0), F.lit(25.0)), 6).alias("value"))


def exp_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    return _r(resp.exp_basis(steps, resp.fixed_params(steps)), "u", digits=6)


def exp_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    return _r(resp.exp_sum(steps, resp.fixed_params(steps)), "total", digits=6)


def weighted_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.fields(spark, sf_dir)
    series = area.fit_mean(f).join(F.broadcast(fields.time_axis(f)), "time")
    data = series.select("expt", "variable", "step", F.explode(F.array(F.lit(0), F.lit(1))).alias("mode"), "value")
    out = resp.weighted_residual(data, resp.fixed_params(f), F.lit(1.0) / (F.col("mode") + 1))
    return _r(out, "residual").select("expt", "variable", "step", "mode", "residual")


def synthetic_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.forcing(spark, sf_dir).select("k")
    top = k.agg(F.max("k").alias("top"))
    gauss = 5 * F.exp(-(F.col("k") - 40) * (F.col("k") - 40) / F.lit(500.0))
    return k.join(F.broadcast(top)).select("k", F.round(gauss, 6).alias("gaussian"), F.round(F.col("k") * 2.0 / F.col("top"), 6).alias("ramp"))


def _increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resp.forcing_increments(tables.forcing(spark, sf_dir), FORCING_STEP)


def forcing_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_increments(spark, sf_dir), "d", digits=6)


def pc_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _increments(spark, sf_dir)
    return _r(resp.pc_convolution(d, resp.fixed_params(d)), "y", digits=6).select("k", "mode", "y")


def pc_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _increments(spark, sf_dir)
    return _r(resp.pc_recursion(d, resp.fixed_params(d)), "y", digits=6).select("k", "mode", "y")


def quadratic_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(resp.quadratic_forcing(tables.forcing(spark, sf_dir), 0.9, 0.1), "f", digits=6)


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annual anomalies with step, the fixed basis on their axis, and the patterns."""
    f = tables.fields(spark, sf_dir, "annual")
    steps = fields.time_axis(f).select("step")
    basis = resp.exp_basis(steps, resp.fixed_params(f))
    kept = fields.first_steps(fields.anomaly(f))
    counted = kept.join(F.broadcast(steps.agg(F.count("*").alias("n_steps"))))
    patterns = resp.project(counted, resp.projection_weights(basis), F.first("n_steps"))
    return kept, basis, patterns


def pattern_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_trained(spark, sf_dir)[2], "v").select("expt", "variable", "mode", "cell", "v")


def pattern_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(resp.pattern_map(_trained(spark, sf_dir)[2], 1), "v").select("expt", "variable", "mode", "lat", "lon", "v")


def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, basis, patterns = _trained(spark, sf_dir)
    return _r(resp.reconstruct(basis, patterns), "value").select("expt", "variable", "step", "cell", "value")


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Annual anomalies' patterns, a row a cell, and the basis."""
    f = tables.fields(spark, sf_dir, "annual")
    steps = fields.time_axis(f).select("step")
    basis = resp.exp_basis(steps, resp.fixed_params(f))
    packed = series.pack(fields.first_steps(fields.anomaly(f)), steps.agg(F.count("*").alias("n_steps")))
    return series.project_series(packed, resp.projection_weights(basis)), basis


def series_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of fields kept as one row a cell."""
    return _r(series.patterns_of(_packed(spark, sf_dir)[0]), "v").select("expt", "variable", "mode", "cell", "v")


def series_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields made again of patterns kept as one row a cell."""
    out = series.unpack(series.reconstruct_series(*_packed(spark, sf_dir)))
    return _r(out, "value").select("expt", "variable", "step", "cell", "value")


def _model(spark: SparkSession, sf_dir: str) -> scenario.PatternModel:
    patterns = _trained(spark, sf_dir)[2]
    rows = [(e, v, *p) for e in EXPERIMENTS for v, _ in MODES for p in resp.FIXED]
    params = spark.createDataFrame(rows, "expt string, variable string, mode int, s double, tau double")
    return scenario.PatternModel(params, patterns, spark.createDataFrame(list(STEP_SIZES), "expt string, step_size double"))


def predict_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _model(spark, sf_dir).predict(tables.forcing(spark, sf_dir), "tas", "co2x2")
    return _r(out, "value").select("variable", F.col("time").cast("int").alias("time"), "cell", "value")


def predict_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _model(spark, sf_dir).predict_scenario(tables.species_forcing(spark, sf_dir), EXPERIMENTS, ["tas", "pr"])
    return _r(out, "value", digits=3).select("variable", F.year("time").alias("year"), "cell", "value")


def fit_timescales(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.fields(spark, sf_dir)
    kept = fields.first_steps(fields.anomaly(f))
    series = area.fit_mean(kept).join(F.broadcast(fields.time_axis(f)), "time").select("expt", "variable", "step", "value")
    return fit.fit_timescales(series, area.amplitude_guess(kept), _modes(spark))


def _noise_free(spark: SparkSession, sf_dir: str) -> scenario.PatternModel:
    one = spark.createDataFrame([("tas", 1), ("pr", 1)], "variable string, n_modes int")
    steps = spark.createDataFrame(list(STEP_SIZES), "expt string, step_size double")
    return scenario.PatternModel.fit(tables.noise_free_fields(spark, sf_dir), one, steps)


def trained_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _noise_free(spark, sf_dir).params.where("expt <> 'base'")
    return _r(out, "s", "tau", digits=2).select("expt", "variable", "mode", "s", "tau", "tau_max")


def trained_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _noise_free(spark, sf_dir).patterns.where("expt <> 'base'")
    return _r(out, "v", digits=3).select("expt", "variable", "mode", "cell", "v")


def trained_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _noise_free(spark, sf_dir).predict(tables.forcing(spark, sf_dir), "tas", "co2x2")
    return _r(out, "value", digits=2).select("variable", F.col("time").cast("int").alias("time"), "cell", "value")


def named_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained from the experiments' names, the step by a run of the doubling, and predicted for a forcing series."""
    one = spark.createDataFrame([("tas", 1), ("pr", 1)], "variable string, n_modes int")
    emitted, held, gases = _scenario(spark, sf_dir)
    start = held.where("species = 'CO2'").select("k").orderBy("k").limit(2).collect()[-1][0]  # a month with a value after the first: small tables lack some
    model = scenario.PatternModel.train(tables.noise_free_fields(spark, sf_dir), one, ["base", "co2x2"], emitted, held, gases, start)
    out = model.predict(tables.forcing(spark, sf_dir), "tas", "co2x2")
    return _r(out, "value", digits=2).select("variable", F.col("time").cast("int").alias("time"), "cell", "value")


def model_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted to the fields themselves, several modes each, and predicted for a scenario of emissions."""
    steps = spark.createDataFrame(list(STEP_SIZES), "expt string, step_size double")
    model = scenario.PatternModel.fit(tables.fields(spark, sf_dir, "annual"), _modes(spark), steps)
    return _from_emissions(spark, sf_dir, model, False)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, expt): experiment names from priorities and months of orders."""
    orders = tables.table(spark, sf_dir, "orders")
    kind = tables._named({p: {"SO2": "sul"}.get(s, s.lower()) for p, s in tables.SPECIES.items()}, "o_orderpriority")
    factor = (F.month("o_orderdate") % 4 + 2).cast("string")
    return orders.select(F.year("o_orderdate").alias("year"), F.concat(kind, F.lit("x"), factor).alias("expt")).distinct()


def parse_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.parse_experiments(_names(spark, sf_dir).select("expt").distinct())


def experiment_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _names(spark, sf_dir).groupBy("year").agg(F.concat(F.array(F.lit("base")), F.array_sort(F.collect_list("expt"))).alias("expts"))
    return experiments.experiment_labels(lists).select("year", "label", "title")


def _emissions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.melt_scenario(tables.emissions(spark, sf_dir))


def emissions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_emissions_long(spark, sf_dir), "value", digits=2)


def plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(experiments.plateau(_emissions_long(spark, sf_dir), START), "value", digits=2)


def _perturbed(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    series = _emissions_long(spark, sf_dir).withColumn("value", F.col("value") / scale)
    runs = spark.createDataFrame([(e,) for e in ["base", "co2x2", "bcx10", "sulx7"]], "expt string")
    return experiments.perturb(series, runs, START)


def perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_perturbed(spark, sf_dir), "value", digits=2)


def step_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _perturbed(spark, sf_dir, 1e6).where(F.col("k") <= START + 5)
    totals = forcing.species_forcing(runs, ("expt",)).groupBy("expt", "k").agg(F.sum("f").alias("f"))
    return _r(experiments.step_scaling(totals), "scaling")


def gas_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(tables.gases(spark, sf_dir), "beta", "tau1", "sarf_to_erf", digits=6)


def _scenario(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    emissions = _emissions_long(spark, sf_dir).withColumn("value", F.col("value") / 1e6)
    return emissions, tables.concentrations(spark, sf_dir), tables.gases(spark, sf_dir)


def gas_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [forcing.gas_forcing(*_scenario(spark, sf_dir), emission_steps=START, conc_run=x).withColumn("conc_run", F.lit(x)) for x in (False, True)]
    return _r(out[0].unionByName(out[1]), "f", digits=5).select("conc_run", "species", "k", "f")


def run_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(experiments.run_scaling(*_scenario(spark, sf_dir), ["base", "co2x2", "bcx10", "sulx7"], START), "scaling")


def _from_emissions(spark: SparkSession, sf_dir: str, model: scenario.PatternModel, conc_run: bool) -> DataFrame:
    return model.predict_emissions(*_scenario(spark, sf_dir), EXPERIMENTS, ["tas", "pr"], conc_run, emission_steps=START)


def predict_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir)
    out = [_from_emissions(spark, sf_dir, model, x).withColumn("conc_run", F.lit(x)) for x in (False, True)]
    return _r(out[0].unionByName(out[1]), "value", digits=3).select("conc_run", "variable", F.year("time").alias("year"), "cell", "value")


def stack_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables read by a path callback, one under the other: rows and balances of each."""
    out = readers.stack_experiments(spark, ["supplier", "customer"], lambda e: f"{sf_dir}/{e}.parquet")
    return out.groupBy("expt", "expt_idx").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("s_acctbal", "c_acctbal")), 4).alias("balance"), F.count("s_suppkey").alias("n_suppliers"))


def _shared(spark: SparkSession) -> str:
    """A new folder that the driver and all executors reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-')}/thawline/{uuid.uuid4().hex}"


def gridded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields written as gridded files, a folder an experiment, stacked by a path callback, one variable and period read again."""
    netcdf.register(spark)
    folder, all_fields = _shared(spark), tables.fields(spark, sf_dir)
    for e in EXPERIMENTS:
        netcdf.write_fields(all_fields.where(F.col("expt") == e), f"{folder}/{e}")
    out = readers.stack_experiments(spark, EXPERIMENTS, lambda e: f"{folder}/{e}", "netcdf3")
    out = out.where("variable = 'tas' and time >= 12 and time < 60 and value is not null")
    return _r(out, "value", digits=6).select("expt", "expt_idx", F.col("time").cast("int").alias("time"), "lat", "lon", "value")


def aerosol_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders")
    species = tables._named(tables.SPECIES, "o_orderpriority")
    present = orders.groupBy("o_custkey").agg(F.collect_set(F.when(species.isin(*experiments.AEROSOLS), species)).alias("present"))
    return experiments.aerosol_mapping(present)


def forcer_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.species_forcing(spark, sf_dir)
    names = [*EXPERIMENTS, "bcx10"]
    out = [experiments.attribute_forcing(f, names, x).withColumn("sul_is_so2", F.lit(x)) for x in (False, True)]
    return _r(out[0].unionByName(out[1]), "f", digits=6)


def natural_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forcing.natural_emissions(tables.emissions(spark, sf_dir))


def species_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _emissions_long(spark, sf_dir).withColumn("value", F.col("value") / 1e6)
    return _r(forcing.with_total(forcing.species_forcing(scaled)), "f")


def forcing_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = list(tables.SPECIES.values())
    return _r(forcing.forcing_stack(tables.species_forcing(spark, sf_dir), kept), *kept[:-1], "stack", digits=6)


def diag_prediction_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _model(spark, sf_dir).predict(tables.forcing(spark, sf_dir), "tas", "co2x2")
    return _r(area.weighted_mean(out), "value").select(F.col("time").cast("int").alias("time"), "value")


def _three(spark: SparkSession, sf_dir: str, mean) -> DataFrame:
    kept, basis, patterns = _trained(spark, sf_dir)
    made = mean(resp.reconstruct(basis, patterns).withColumnRenamed("step", "time"))
    return diagnostics.labelled(data=mean(kept.drop("time").withColumnRenamed("step", "time")), eof=made, fit=made)


def diag_global_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_three(spark, sf_dir, area.global_mean), "value")


def diag_weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_three(spark, sf_dir, area.weighted_mean), "value")


def diag_fast_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, basis, patterns = _trained(spark, sf_dir)
    return _r(diagnostics.mean_of_reconstruction(basis, patterns), "value")


def period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fields.first_steps(tables.fields(spark, sf_dir))
    return _r(diagnostics.period_change(kept, (60, 79), (0, 19)), "change")


def anchored_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two periods under one another, both less the first value of the earlier one."""
    series = area.fit_mean(tables.fields(spark, sf_dir)).select("expt", "variable", "time", "value")
    past = series.where(F.col("time") < START).withColumn("period", F.lit("past"))
    later = series.where(F.col("time") >= START).withColumn("period", F.lit("scenario"))
    earlier: Column = F.col("period") == "past"
    return _r(diagnostics.anchored(past.unionByName(later), "time", ("expt", "variable"), earlier), "value")


QUERIES = {
    f.__name__: f
    for f in (
        ensemble_first, control_climatology, anomaly, first_100, field_gate, make_anom, nearest_fill, area_weight, area_weight_2d,
        area_weight_3d, fit_mean, global_mean, weighted_mean, amplitude_guess, initial_params, exp_response, exp_basis, exp_sum,
        weighted_residual, synthetic_forcing, forcing_increments, pc_convolution, pc_recursion, quadratic_forcing, pattern_projection,
        pattern_map, reconstruct, series_projection, series_reconstruction, predict_forcing, predict_combined, fit_timescales, parse_experiment, experiment_label, emissions_long,
        plateau, perturbation, step_scaling, aerosol_mapping, forcer_attribution, natural_emissions, species_forcing, forcing_stack,
        diag_prediction_mean, diag_global_means, diag_weighted_means, diag_fast_means, period_change, anchored_series,
        trained_params, trained_patterns, trained_prediction, named_training, model_prediction, gas_parameters, gas_forcing, run_scaling, predict_emissions, stack_experiments, gridded_files,
    )
}
