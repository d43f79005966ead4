"""Operators of the climate part against numpy and by their invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thawline.functions.columns import faded_sums
from thawline.operators import area, diagnostics, experiments, fields, fit, forcing, response, scenario
from thawline.sources import readers


def cube(spark, values, expt="base", variable="tas", lats=(-90.0, 0.0, 90.0), lons=(0.0, 120.0, 240.0)):
    rows = [
        (expt, variable, t, i * len(lons) + j, lats[i], lons[j], None if values[t][i][j] is None else float(values[t][i][j]))
        for t in range(len(values)) for i in range(len(lats)) for j in range(len(lons))
    ]
    return spark.createDataFrame(rows, "expt string, variable string, time int, cell int, lat double, lon double, value double")


def test_anomaly_of_zero_control_is_the_input(spark):
    v = np.random.RandomState(1).rand(3, 3, 3)
    got = fields.make_anom(cube(spark, v, "co2x2"), cube(spark, np.zeros((3, 3, 3)))).toPandas().sort_values(["time", "lat", "lon"])
    np.testing.assert_allclose(got.value.to_numpy().reshape(3, 3, 3), v)


def test_gaps_of_anomalies_are_filled_from_the_nearest_along_latitudes_then_longitudes(spark):
    v = np.random.RandomState(11).rand(1, 3, 3).tolist()
    v[0][1][1] = None
    fill = fields.make_anom(cube(spark, v, "co2x2"), cube(spark, np.ones((2, 3, 3)))).toPandas().sort_values(["lat", "lon"]).value.to_numpy()
    plain = np.array([x for row in v[0] for x in row], float) - 1
    plain[4] = plain[1]  # as near as the other side, which is higher
    np.testing.assert_allclose(fill, plain)
    v[0][0] = [None] * 3  # no value below: nothing to fill between
    bare = fields.make_anom(cube(spark, v, "co2x2"), cube(spark, np.ones((2, 3, 3)))).toPandas().sort_values(["lat", "lon"]).value.to_numpy()
    np.testing.assert_allclose(bare, [np.nan] * 3 + [v[0][1][0] - 1, v[0][1][0] - 1, v[0][1][2] - 1] + [x - 1 for x in v[0][2]])


def test_control_anomalies_average_to_zero_and_a_missing_value_is_skipped(spark):
    v = np.random.RandomState(2).rand(4, 3, 3).tolist()
    v[1][0][0] = None
    got = fields.anomaly(cube(spark, v)).groupBy("cell").agg(F.avg("value").alias("m"), F.count("value").alias("n")).toPandas()
    assert np.abs(got.m).max() < 1e-12 and sorted(got.n)[0] == 3


def test_weights(spark):
    c = cube(spark, np.zeros((2, 3, 3)))
    one = area.weights(c).orderBy("lat").toPandas().weight
    np.testing.assert_allclose(one, [0, 1, 0], atol=1e-12)
    assert area.weights_3d(c).count() == 18
    np.testing.assert_allclose(area.weights_2d(c).orderBy("lat", "lon").toPandas().weight, [0.01] * 3 + [1] * 3 + [0.01] * 3, atol=1e-12)


def test_names_of_coordinates(spark):
    df = spark.createDataFrame([(1, 1.0)], "year int, latitude double")
    assert fields.time_name(df) == "year" and fields.lat_name(df) == "latitude"
    with pytest.raises(RuntimeError, match="Couldn't find a time coordinate"):
        fields.time_name(df.withColumnRenamed("year", "seconds"))
    with pytest.raises(RuntimeError, match="Couldn't find a latitude coordinate"):
        fields.lat_name(df.withColumnRenamed("latitude", "deg_NS"))


def test_three_means_agree_without_gaps_and_differ_with_them(spark):
    v = np.random.RandomState(3).rand(2, 3, 3).tolist()
    pick = lambda f, c: f(c).orderBy("time").toPandas().value.to_numpy()
    full = cube(spark, v, lats=(-60.0, 0.0, 60.0))
    np.testing.assert_allclose(pick(area.fit_mean, full), pick(area.global_mean, full))
    np.testing.assert_allclose(pick(area.fit_mean, full), pick(area.weighted_mean, full))
    v[0][0][0] = None
    gap = cube(spark, v, lats=(-60.0, 0.0, 60.0))
    a, b, c = (pick(f, gap)[0] for f in (area.fit_mean, area.global_mean, area.weighted_mean))
    assert len({round(x, 9) for x in (a, b, c)}) == 3


def test_nearest_fill_between_known_values_only(spark):
    v = [[[None, 1, None], [2, None, None], [None, 5, None]]]
    got = fields.nearest_fill(cube(spark, v), "lat").orderBy("lat", "lon").toPandas().value.tolist()
    assert [None if math.isnan(x) else x for x in got] == [None, 1, None, 2, 1, None, None, 5, None]


def test_first_steps_count_positions(spark):
    c = cube(spark, np.zeros((4, 1, 1)), lats=(0.0,), lons=(0.0,)).withColumn("time", F.col("time") * 10 + 7)
    assert sorted(r.step for r in fields.first_steps(c, 3).collect()) == [0, 1, 2]
    assert fields.field_gate(c.withColumn("value", F.lit(None).cast("double"))).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(f=st.lists(st.floats(-5, 5), min_size=2, max_size=30))
def test_convolution_matches_numpy_and_the_recursion(spark, f):
    series = spark.createDataFrame(list(enumerate(map(float, f))), "k int, f double")
    d = response.forcing_increments(series, 4.08)
    p = response.fixed_params(series)
    y = response.pc_convolution(d, p).toPandas().sort_values(["mode", "k"]).y.to_numpy().reshape(2, -1)
    z = response.pc_recursion(d, p).toPandas().sort_values(["mode", "k"]).y.to_numpy().reshape(2, -1)
    inc = np.append(np.diff(f), 0) / 4.08
    for m, s, tau in response.FIXED:
        expect = np.convolve(s * (1 - np.exp(-np.arange(len(f)) / tau)), inc)[: len(f)]
        np.testing.assert_allclose(y[m], expect, atol=1e-9)
        np.testing.assert_allclose(z[m], expect, atol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_fading_sums_of_any_length_and_spacing(spark, n):
    rng = np.random.RandomState(n)
    t, x = np.cumsum(rng.randint(1, 4, n)).astype(float), rng.randn(n)
    frame = spark.createDataFrame([([(float(a), float(b)) for a, b in zip(t, x)], 7.0)], "points array<struct<t:double,x:double>>, tau double")
    got = frame.select(faded_sums("points", "tau").alias("y")).first().y
    z, expect = 0.0, []
    for i in range(n):
        z = x[i] + (z * np.exp(-(t[i] - t[i - 1]) / 7) if i else 0.0)
        expect.append(z)
    np.testing.assert_allclose([p.x for p in got], expect, atol=1e-9)
    assert [p.t for p in got] == t.tolist()


def test_constant_forcing_gives_zero_and_a_step_of_zero_null(spark):
    flat = spark.createDataFrame([(k, 3.0) for k in range(5)], "k int, f double")
    assert response.pc_convolution(response.forcing_increments(flat, 2.0), response.fixed_params(flat)).where("abs(y) > 0").count() == 0
    none = response.forcing_increments(flat, 0.0)
    assert none.where("d is not null").count() == 0
    for convolved in (response.pc_convolution, response.pc_recursion):
        assert convolved(none, response.fixed_params(flat)).where("y is not null").count() == 0


def test_projection_returns_the_patterns_and_poisons_gaps(spark):
    n, rng = 12, np.random.RandomState(4)
    u = np.column_stack([s * (1 - np.exp(-np.arange(n) / tau)) for _, s, tau in response.FIXED])
    v = rng.randn(2, 4)
    x = (u @ v).reshape(n, 2, 2).tolist()
    steps = spark.range(n).select(F.col("id").cast("int").alias("step"))
    basis = response.exp_basis(steps, response.fixed_params(steps))
    w = response.projection_weights(basis)
    data = cube(spark, x, lats=(0.0, 30.0), lons=(0.0, 72.0)).withColumnRenamed("time", "step")
    got = response.project(data, w, n).toPandas().sort_values(["mode", "cell"]).v.to_numpy().reshape(2, 4)
    np.testing.assert_allclose(got, v, atol=1e-8)
    wide = w.toPandas().pivot(index="mode", columns="step", values="w").to_numpy()
    np.testing.assert_allclose(wide, np.linalg.pinv(u), atol=1e-8)
    made = response.reconstruct(basis, response.project(data, w, n)).toPandas().sort_values(["step", "cell"]).value.to_numpy()
    np.testing.assert_allclose(made, (u @ v).ravel(), atol=1e-8)
    whole = response.reconstruct(basis, response.project(data, w, n)).withColumnRenamed("step", "time")
    fast = diagnostics.mean_of_reconstruction(basis, response.project(data, w, n)).orderBy("step").toPandas().value
    np.testing.assert_allclose(fast, area.weighted_mean(whole).orderBy("time").toPandas().value, atol=1e-8)
    x[3][0][0] = None
    holes = response.project(cube(spark, x, lats=(0.0, 30.0), lons=(0.0, 72.0)).withColumnRenamed("time", "step"), w, n)
    assert sorted(r.cell for r in holes.where("v is null").collect()) == [0, 0]


def test_fit_recovers_noise_free_parameters_and_beats_truth_with_noise():
    t = np.arange(100)
    clean = 2 * (1 - np.exp(-t / 4)) + 1.5 * (1 - np.exp(-t / 120))
    s, tau, cost, _ = fit.fit_series(clean, 1.0, 2)
    np.testing.assert_allclose(np.concatenate((s, tau)), [2, 1.5, 4, 120], rtol=1e-6)
    assert cost < 1e-30
    noisy = clean + np.random.RandomState(0).randn(100) * 0.05
    assert fit.fit_series(noisy, 1.0, 2)[2] <= ((noisy - clean) ** 4).sum()
    with pytest.raises(ValueError):
        fit.fit_series(clean[:3], 1.0, 2)
    with pytest.raises(ValueError):
        fit.fit_series(clean, 1.0, 19)


def test_forcing_by_a_table_of_gases(spark):
    years = range(2000, 2012)
    rng = np.random.RandomState(9)
    e = {s: rng.rand(12) * 5 for s in ("CO2", "CH4", "N2O", "HFC23", "SO2", "XX")}
    c = {s: 100 + rng.rand(12) for s in ("CO2", "CH4", "N2O", "HFC23")}
    long = lambda d: spark.createDataFrame([(s, y, float(v)) for s, x in d.items() for y, v in zip(years, x)], "species string, k int, value double")
    gases = [
        ("CO2", "Pg", "ppm", 2.1, 0.0, 150.0, 0.0, 1.05), ("CH4", "Tg", "ppb", 2.8, 0.0, 9.6, 275.0, 0.9), ("N2O", "Tg", "ppb", 4.8, 0.0, 121.0, 9.5, 1.07),
        ("HFC23", "Gg", "ppt", 12.4, 0.0002, 228.0, 0.0, 1.0), ("SO2", "Tg", "-", 11.0, 0.0, 0.02, 0.0, 1.0), ("XX", "X", "-", 0.0, 0.0, 0.0, 0.0, 1.0),
    ]
    table = spark.createDataFrame(gases, "gas string, em_unit string, conc_unit string, beta double, alpha double, tau1 double, natural_emissions double, sarf_to_erf double")
    natural = spark.createDataFrame([("CH4", y, 240.0) for y in years], "species string, k int, value double")
    for conc_run in (False, True):
        for own in (None, natural):
            got = {(r.species, r.k): r.f for r in forcing.gas_forcing(long(e), long(c), table, emission_steps=5, conc_run=conc_run, natural=own).collect()}
            assert {s for s, _ in got} == {"CO2", "CH4", "N2O", "HFC23", "SO2"}
            for gas, _, unit, beta, alpha, tau, nat, erf in gases[:5]:
                at, held = c.get(gas, e[gas])[4], []
                for i in range(12):
                    if unit == "-":
                        held.append(-0.3 * (e[gas][i] - e[gas][0]))
                        continue
                    if i < 5 or conc_run:
                        x = c[gas][i]
                    else:
                        n = 240.0 if own is not None and gas == "CH4" else nat
                        x = at = at * np.exp(-1 / tau) + (e[gas][i] + n) / beta * tau * (1 - np.exp(-1 / tau))
                    c0 = c[gas][0]
                    held.append(erf * {"CO2": 5.35 * np.log(x / c0), "CH4": 0.036 * (x**0.5 - c0**0.5), "N2O": 0.12 * (x**0.5 - c0**0.5)}.get(gas, alpha * (x - c0)))
                np.testing.assert_allclose([got[gas, y] for y in years], held, atol=1e-9)
    names = ["base", "co2x2", "sulx5", "bcx10"]
    scaling = {r.expt: r.scaling for r in experiments.run_scaling(long(e), long(c), table, names, 2003).collect()}
    assert scaling["base"] == 0 and scaling["bcx10"] == 0  # BC isn't among the emissions
    np.testing.assert_allclose([scaling["co2x2"], scaling["sulx5"]], [1.05 * 5.35 * np.log(2), -0.3 * 4 * e["SO2"][3]], atol=1e-9)  # of the multiplier alone


def test_model_predicts_from_emissions_and_survives_saving(spark, tmp_path):
    n = 20
    u = 3 * (1 - np.exp(-np.arange(n) / 6))
    base = cube(spark, np.full((n, 2, 2), 5.0), lats=(-30.0, 30.0), lons=(0.0, 72.0))
    warm = cube(spark, 5 + u[:, None, None] * np.array([[1.0, 2.0], [3.0, 4.0]]), "co2x2", lats=(-30.0, 30.0), lons=(0.0, 72.0))
    modes = spark.createDataFrame([("tas", 1)], "variable string, n_modes int")
    model = scenario.PatternModel.fit(base.unionByName(warm), modes, spark.createDataFrame([("co2x2", 4.0)], "expt string, step_size double"))
    model = model.save(str(tmp_path / "model"))
    e = spark.createDataFrame([("CO2", k, 1.0 + k) for k in range(30)], "species string, k int, value double")
    c = spark.createDataFrame([("CO2", k, 300.0 + 10 * k) for k in range(30)], "species string, k int, value double")
    gases = spark.createDataFrame([("CO2", "Pg", "ppm", 2.1, 0.0, 150.0, 0.0, 1.05)], "gas string, em_unit string, conc_unit string, beta double, alpha double, tau1 double, natural_emissions double, sarf_to_erf double")
    again = scenario.PatternModel.load(spark, str(tmp_path / "model"))
    for conc_run in (False, True):
        got = again.predict_emissions(e, c, gases, ["base", "co2x2"], ["tas"], conc_run, emission_steps=10, last=24).toPandas()
        assert len(got) == 25 * 4 and got.time.dt.year.min() == 1850
        flat = np.where((np.arange(30) >= 10) & (np.arange(30) < 17) & conc_run, 400.0, 300.0 + 10 * np.arange(30))[:25]
        box = flat.copy()
        for k in range(10, 25) if not conc_run else ():
            box[k] = box[k - 1] * np.exp(-1 / 150) + (1.0 + k) / 2.1 * 150 * (1 - np.exp(-1 / 150))
        f = 1.05 * 5.35 * np.log(box / 300)
        y = np.convolve(1 - np.exp(-np.arange(25) / 6), np.append(np.diff(f), 0) / 4.0)[:25]
        value = got.sort_values(["time", "cell"]).value.to_numpy().reshape(25, 4)
        np.testing.assert_allclose(value, np.outer(y, 3 * np.array([1, 2, 3, 4])), atol=0.02)


def test_model_trains_and_predicts(spark):
    n = 30
    u = 3 * (1 - np.exp(-np.arange(n) / 6))
    base = cube(spark, np.full((n, 2, 2), 5.0), lats=(-30.0, 30.0), lons=(0.0, 72.0))
    warm = cube(spark, 5 + u[:, None, None] * np.array([[1.0, 2.0], [3.0, 4.0]]), "co2x2", lats=(-30.0, 30.0), lons=(0.0, 72.0))
    modes = spark.createDataFrame([("tas", 1)], "variable string, n_modes int")
    model = scenario.PatternModel.fit(base.unionByName(warm), modes, spark.createDataFrame([("co2x2", 4.0)], "expt string, step_size double"))
    jump = spark.createDataFrame([(k, 0.0 if k == 0 else 4.0) for k in range(n)], "k int, f double")
    got = model.predict(jump, "tas", "co2x2").toPandas().sort_values(["time", "cell"])
    assert got.time.min() == 1850 and len(got) == n * 4
    np.testing.assert_allclose(got.value.to_numpy().reshape(n, 4)[1:], np.outer(u[1:], [1, 2, 3, 4]), atol=0.02)
    species = jump.withColumn("species", F.lit("CO2")).unionByName(jump.withColumn("species", F.lit("CH4")))
    both = model.predict_scenario(species, ["base", "co2x2"], ["tas"]).toPandas()
    assert str(both.time.dtype).startswith("datetime64") and np.isclose(both.value.max(), 2 * got.value.max())
    with pytest.raises(ValueError):
        model.predict_scenario(species, ["base", "bcx10"], ["tas"])
    with pytest.raises(ValueError):
        scenario.PatternModel.fit(warm, modes, jump)


@pytest.mark.parametrize(
    "present, expect",
    [
        ([], ["CO2", "CO2", "CO2"]), (["SO2"], ["SO2"] * 3), (["BC"], ["BC"] * 3), (["OC"], ["OC"] * 3), (["SO2", "BC"], ["SO2", "BC", "BC"]),
        (["SO2", "OC"], ["SO2", "OC", "OC"]), (["BC", "OC"], ["BC", "BC", "OC"]), (["SO2", "BC", "OC"], ["SO2", "BC", "OC"]),
    ],
)
def test_aerosols_go_with_what_is_there(spark, present, expect):
    got = {r.component: r.target for r in experiments.aerosol_mapping(spark.createDataFrame([(present,)], "present array<string>")).collect()}
    assert [got[c] for c in ("SO4_IND", "BMB_AEROS_BC", "BMB_AEROS_OC")] == expect
    assert set(got) - set(experiments.COMPONENTS) == set(experiments.AEROSOLS) - set(present)


def test_attribution_keeps_the_total(spark):
    rng = np.random.RandomState(5)
    rows = [(s, k, float(rng.rand())) for s in ("CO2", "SO2", "BC", "OC", "CH4", "BMB_AEROS_OC") for k in range(6)]
    f = spark.createDataFrame(rows, "species string, k int, f double")
    for fix in (False, True):
        got = experiments.attribute_forcing(forcing.with_total(f), ["base", "co2x2", "bcx10", "sulx5"], fix).toPandas()
        np.testing.assert_allclose(got.groupby("k").f.sum(), pd.DataFrame(rows).groupby(1)[2].sum())
        assert (got[got.expt == "sulx5"].f.abs().sum() > 0) == fix
    with pytest.raises(ValueError):
        experiments.attribute_forcing(f, ["base", "bcx10"])
    with pytest.raises(ValueError):
        experiments.attribute_forcing(f, ["base", "co2x2", "co2x4"])


def test_experiment_names(spark):
    names = spark.createDataFrame([("base",), ("co2x2",), ("sulx5",)], "expt string")
    got = {r.expt: (r.species, r.multiplier) for r in experiments.parse_experiments(names).collect()}
    assert got == {"base": (None, None), "co2x2": ("CO2", 2), "sulx5": ("SO2", 5)}
    for wrong in ("co2x0.5", "noxx5"):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            experiments.parse_experiments(spark.createDataFrame([(wrong,)], "expt string")).collect()
    lists = spark.createDataFrame([(["base", "co2x2", "bcx10"],), (["base", "co2x2"],)], "expts array<string>")
    assert [(r.label, r.title) for r in experiments.experiment_labels(lists).collect()] == [("CO2+BC", "Pattern with co2 and bc"), ("CO2", "Pattern with co2")]


def test_plateau_and_perturbation_leave_the_input_alone(spark):
    e = spark.createDataFrame([("CO2", k, float(k)) for k in range(12)] + [("CH4", k, 1.0) for k in range(12)], "species string, k int, value double")
    flat = {r.k: r.value for r in experiments.plateau(e, 3).where("species = 'CO2'").collect()}
    assert [flat[k] for k in (2, 3, 9, 10)] == [2, 3, 3, 10]
    runs = experiments.perturb(e, spark.createDataFrame([("base",), ("co2x2",), ("bcx10",)], "expt string"), 3).toPandas()
    v = lambda x, s, k: runs[(runs.expt == x) & (runs.species == s) & (runs.k == k)].value.iloc[0]
    assert v("co2x2", "CO2", 9) == 6 and v("co2x2", "CO2", 10) == 10 and v("co2x2", "CH4", 5) == 1 and v("bcx10", "CO2", 5) == 5


def test_gas_table_and_scenarios_are_read(spark, tmp_path):
    path = tmp_path / "gases.txt"
    path.write_text("GAS\tEM_UNIT\tCONC_UNIT\tBETA\tALPHA\tTAU1\tTAU2\tTAU3\tNATURAL\tSARF_TO_ERF\r\nCO2\tPg_C\tppm\t2.1\t0\t0\t0\t0\t0\t1.05\r\nXX\tX\t-\t1\t0\t0\t0\t0\t0\t1\t\r\n")
    got = readers.read_gas_table(spark, str(path)).toPandas()
    assert got.gas.tolist() == ["CO2", "XX"] and got.sarf_to_erf.tolist() == [1.05, 1.0]
    wide = tmp_path / "em.txt"
    wide.write_text("year\tCO2\tCH4\n2000\t1\t2\n2001\t3\t4\n")
    assert readers.read_scenario(spark, str(wide)).count() == 4
    for e in ("base", "co2x2"):
        spark.createDataFrame([(0, float("nan") if e == "base" else 1.0)], "time int, tas double").write.parquet(str(tmp_path / e))
    stacked = readers.stack_experiments(spark, ["base", "co2x2"], lambda e: str(tmp_path / e)).orderBy("expt_idx").collect()
    assert [r.tas for r in stacked] == [None, 1.0]
