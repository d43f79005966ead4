"""The same results in plain SQL, from the given tables alone."""

from __future__ import annotations

TIMES = {
    "monthly": "CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT)",
    "annual": "CAST(year(l_shipdate) - 1995 AS INT)",
    "weekly": "CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) AS INT)",
}
PARAMS = "p(mode, s, tau) AS (VALUES (CAST(0 AS INT), 3.0::DOUBLE, 10.0::DOUBLE), (CAST(1 AS INT), 1.5::DOUBLE, 100.0::DOUBLE))"
MONTH = "CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT)"
SPECIES = "CASE o_orderpriority WHEN '1-URGENT' THEN 'CO2' WHEN '2-HIGH' THEN 'SO2' WHEN '3-MEDIUM' THEN 'BC' WHEN '4-NOT SPECIFIED' THEN 'OC' WHEN '5-LOW' THEN 'CH4' END"
W = "cos(radians(lat))"


def cube(step: str = "monthly", ens: bool = False) -> str:
    e = "ens, " if ens else ""
    own = "CAST(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS INT) AS ens," if ens else ""
    return f"""c AS (
  SELECT CASE l_returnflag WHEN 'N' THEN 'base' WHEN 'A' THEN 'co2x2' WHEN 'R' THEN 'sulx5' END AS expt, {own} {TIMES[step]} AS time,
    CAST(n_regionkey * 5 + floor(n_nationkey / 5.0) AS INT) AS cell, CAST(n_regionkey * 30.0 - 60.0 AS DOUBLE) AS lat,
    CAST(floor(n_nationkey / 5.0) * 72.0 AS DOUBLE) AS lon, avg(l_quantity) AS tas, avg(l_extendedprice) AS pr
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
), f AS (
  SELECT expt, {e}'tas' AS variable, time, cell, lat, lon, tas AS value FROM c UNION ALL SELECT expt, {e}'pr', time, cell, lat, lon, pr FROM c
), ax AS (SELECT time, CAST(row_number() OVER (ORDER BY time) - 1 AS INT) AS step FROM (SELECT DISTINCT time FROM f)),
mw AS (SELECT avg({W}) AS m FROM (SELECT DISTINCT lat FROM f))"""


CLIM = "clim AS (SELECT variable, cell, avg(value) AS climatology FROM f WHERE expt = 'base' GROUP BY ALL)"
ANOM = f"{CLIM}, a AS (SELECT expt, variable, time, cell, lat, lon, value - climatology AS value FROM f LEFT JOIN clim USING (variable, cell))"
FIT_MEAN = f"""fm AS (SELECT expt, variable, time, avg(x) AS value FROM (
  SELECT expt, variable, time, lon, avg(value * {W} / m) AS x FROM f, mw GROUP BY ALL) GROUP BY ALL)"""
AMPLITUDE = """am AS (SELECT expt, variable, avg(x) AS amplitude FROM (SELECT expt, variable, time, avg(x) AS x FROM (
  SELECT expt, variable, time, lon, avg(value) AS x FROM f GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"""
FORCING = f"fo AS (SELECT {MONTH} AS k, avg(o_totalprice) / 1e5 AS f FROM orders GROUP BY ALL)"
INCREMENTS = f"""{FORCING}, inc AS (SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS k,
  coalesce(lead(f) OVER (ORDER BY k) - f, 0.0) / 4.08 AS d FROM fo)"""
SPECIES_FORCING = f"""sk AS (SELECT {SPECIES} AS species, {MONTH} AS k, avg(o_totalprice) / 1e5 AS f FROM orders GROUP BY ALL),
sf AS (SELECT species, k, coalesce(f, 0.0) AS f FROM (SELECT DISTINCT species FROM sk) CROSS JOIN (SELECT DISTINCT k FROM sk) LEFT JOIN sk USING (species, k))"""
EMISSIONS = f"""ek AS (SELECT {SPECIES} AS species, {MONTH} AS k, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
em AS (SELECT species, k, coalesce(value, 0.0) AS value FROM (SELECT unnest(['CO2', 'SO2', 'BC', 'OC', 'CH4']) AS species) CROSS JOIN (SELECT DISTINCT k FROM ek) LEFT JOIN ek USING (species, k))"""
PATTERNS = f"""{cube("annual")}, {ANOM}, {PARAMS},
st AS (SELECT step FROM ax WHERE step < 100), ns AS (SELECT count(*) AS n FROM ax),
b AS (SELECT step, mode, s * (1 - exp(-step / tau)) AS u FROM st, p),
w2 AS (SELECT step, max(u) FILTER (mode = 0) AS u0, max(u) FILTER (mode = 1) AS u1 FROM b GROUP BY step),
g AS (SELECT sum(u0 * u0) AS a, sum(u0 * u1) AS b, sum(u1 * u1) AS c FROM w2),
w AS (SELECT step, CAST(0 AS INT) AS mode, (c * u0 - b * u1) / (a * c - b * b) AS w FROM w2, g
  UNION ALL SELECT step, CAST(1 AS INT), (a * u1 - b * u0) / (a * c - b * b) FROM w2, g),
pt AS (SELECT expt, variable, mode, cell, lat, lon, CASE WHEN count(value) = max(n) THEN sum(w * value) END AS v
  FROM a JOIN ax USING (time) JOIN w USING (step), ns GROUP BY ALL),
rc AS (SELECT expt, variable, step, cell, lat, lon, CASE WHEN count(v) = count(*) THEN sum(u * v) END AS value FROM pt JOIN b USING (mode) GROUP BY ALL)"""
PREDICTED = f"""{PATTERNS}, {INCREMENTS},
y AS (SELECT x.k, mode, sum(j.d * s * (1 - exp(-(x.k - j.k) / tau))) AS u FROM inc x JOIN inc j ON j.k <= x.k, p GROUP BY ALL),
pf AS (SELECT variable, k + 1850 AS time, cell, lat, CASE WHEN count(v) = count(*) THEN sum(u * v) END AS value
  FROM pt JOIN y USING (mode) WHERE expt = 'co2x2' AND variable = 'tas' GROUP BY ALL)"""
NAMES = f"""nm AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year, replace(lower({SPECIES}), 'so2', 'sul') || 'x' || CAST(month(o_orderdate) % 4 + 2 AS VARCHAR) AS expt FROM orders)"""
RUNS = f"""{EMISSIONS}, ru(expt, target, m) AS (VALUES ('base', NULL, NULL), ('co2x2', 'CO2', 2), ('bcx10', 'BC', 10), ('sulx7', 'SO2', 7)),
pe AS (SELECT expt, species, k, CASE WHEN species = target AND k BETWEEN 40 AND 46
  THEN max(CASE WHEN k = 40 THEN value END) OVER (PARTITION BY expt, species) * m ELSE value END AS value FROM em, ru)"""
BOXES = "bx(species, tau, power) AS (VALUES ('CO2', 100.0::DOUBLE, 5.35::DOUBLE), ('CH4', 12.0, 0.4), ('SO2', 1.0, -0.3), ('BC', 1.0, 0.1), ('OC', 1.0, -0.05))"


def _box(source: str, keys: str) -> str:
    """Forcing of emissions in ``source`` (keys, species, k, value)."""
    on = " AND ".join(f"x.{c} = j.{c}" for c in [*[c.strip() for c in keys.split(",") if c.strip()], "species"])
    own = "".join(f"x.{c.strip()}, " for c in keys.split(",") if c.strip())
    return f"""{BOXES}, hb AS (SELECT {own}x.species, x.k, power, sum(j.value / 1e6 * exp(-(x.k - j.k) / tau)) AS box
  FROM {source} x JOIN {source} j ON {on} AND j.k <= x.k JOIN bx ON x.species = bx.species GROUP BY ALL),
hf AS (SELECT {keys} species, k, CASE WHEN species = 'CO2' THEN power * ln(1 + box) ELSE power * box END AS f FROM hb)"""


def _fill(src: str, axis: str, out: str) -> str:
    others = ", ".join(c for c in ("expt", "variable", "time", "lat", "lon") if c != axis)
    w = f"OVER (PARTITION BY {others} ORDER BY {axis} ROWS BETWEEN"
    past, future = f"{w} UNBOUNDED PRECEDING AND CURRENT ROW)", f"{w} CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""{out}_w AS (SELECT *, last_value(value IGNORE NULLS) {past} AS b, last_value(CASE WHEN value IS NOT NULL THEN {axis} END IGNORE NULLS) {past} AS ba,
  first_value(value IGNORE NULLS) {future} AS n, first_value(CASE WHEN value IS NOT NULL THEN {axis} END IGNORE NULLS) {future} AS na FROM {src}),
{out} AS (SELECT expt, variable, time, lat, lon, CASE WHEN b IS NOT NULL AND n IS NOT NULL THEN CASE WHEN {axis} - ba <= na - {axis} THEN b ELSE n END END AS value FROM {out}_w)"""


def _means(expr: str) -> str:
    return f"""WITH {PATTERNS}, d AS (SELECT expt, variable, step AS time, lat, value FROM a JOIN ax USING (time)), r AS (SELECT expt, variable, step AS time, lat, value FROM rc),
md AS (SELECT expt, variable, time, {expr} AS value FROM d, mw GROUP BY expt, variable, time), mr AS (SELECT expt, variable, time, {expr} AS value FROM r, mw GROUP BY expt, variable, time)
SELECT expt, variable, time, round(value, 4) AS value, 'data' AS series FROM md UNION ALL SELECT expt, variable, time, round(value, 4), 'eof' FROM mr
UNION ALL SELECT expt, variable, time, round(value, 4), 'fit' FROM mr"""


ATTRIBUTED = """tg(sul_is_so2, species, expt) AS (VALUES {rows}),
attributed AS (SELECT sul_is_so2, coalesce(tg.expt, 'co2x2') AS expt, k, sum(f) AS f FROM (SELECT DISTINCT sul_is_so2 FROM tg) CROSS JOIN sf LEFT JOIN tg USING (sul_is_so2, species) GROUP BY ALL),
af AS (SELECT s.sul_is_so2, e.expt, t.k, coalesce(attributed.f, 0.0) AS f FROM (SELECT DISTINCT sul_is_so2 FROM tg) s CROSS JOIN (SELECT unnest([{names}]) AS expt) e
  CROSS JOIN (SELECT DISTINCT k FROM sf) t LEFT JOIN attributed ON attributed.sul_is_so2 = s.sul_is_so2 AND attributed.expt = e.expt AND attributed.k = t.k)"""

NOISE_FREE = f"""{cube("annual")}, a AS (SELECT variable, cell, lat, lon, avg(value) AS a FROM f WHERE expt = 'base' GROUP BY ALL),
wl AS (SELECT avg({W}) AS m FROM (SELECT DISTINCT lat FROM a)),
s AS (SELECT variable, avg(x) AS s FROM (SELECT variable, lon, avg(a * {W} / m) AS x FROM a, wl GROUP BY ALL) GROUP BY ALL)"""
GASES = """gp AS (SELECT species, price / 500 AS beta, size AS tau, size / 25 AS erf FROM (SELECT ['CO2', 'SO2', 'BC', 'OC', 'CH4'][CAST(p_size AS INT) % 5 + 1] AS species,
  avg(p_size) AS size, avg(p_retailprice) AS price FROM part GROUP BY ALL)),
cc AS (SELECT species, k, f * 10 + 250.0 AS value FROM (SELECT * FROM sk WHERE species IN ('CO2', 'CH4')))"""


def _gas(keys: str, emissions: str, concentrations: str, driven: str, out: str) -> str:
    """Forcing by the gas table; ``driven``: steps that concentrations drive; the box goes on from step 39."""
    own = [*[c.strip() for c in keys.split(",") if c.strip()], "species"]
    o = ", ".join(own)
    x = ", ".join(f"x.{c}" for c in own)
    on = " AND ".join(f"x.{c} = j.{c}" for c in own)
    return f"""{out}_r AS (SELECT {o}, k, {emissions}.value AS e, {concentrations}.value AS c FROM {emissions} FULL JOIN {concentrations} USING ({o}, k)),
{out}_i AS (SELECT *, {driven} AS driven, CASE WHEN k = 39 THEN coalesce(c, 0.0) WHEN {driven} THEN 0.0 ELSE (coalesce(e, 0.0) + 1.5) / beta * tau * (1 - exp(-1 / tau)) END AS x FROM {out}_r JOIN gp USING (species)),
{out}_c AS (SELECT {x}, x.k, any_value(x.e) AS e, any_value(x.erf) AS erf, CASE WHEN any_value(x.driven) THEN any_value(x.c) ELSE sum(j.x * exp(-(x.k - j.k) / x.tau)) END AS c
  FROM {out}_i x JOIN {out}_i j ON {on} AND j.k <= x.k GROUP BY ALL),
{out}_z AS (SELECT *, CASE WHEN k = min(k) OVER w THEN c END AS c1, CASE WHEN k = min(k) OVER w THEN e END AS e1 FROM {out}_c WINDOW w AS (PARTITION BY {o})),
{out} AS (SELECT * FROM (SELECT {o}, k, erf * CASE WHEN species = 'CO2' THEN 5.35 * ln(c / max(c1) OVER w) WHEN species = 'CH4' THEN 0.036 * (sqrt(c) - sqrt(max(c1) OVER w))
  ELSE CASE species WHEN 'SO2' THEN -0.3 WHEN 'BC' THEN 0.1 ELSE -0.05 END * (e - max(e1) OVER w) END AS f FROM {out}_z WINDOW w AS (PARTITION BY {o})) WHERE f IS NOT NULL)"""


SCENARIO = f"""{SPECIES_FORCING}, {EMISSIONS}, es AS (SELECT species, k, value / 1e6 AS value FROM em), {GASES}"""
FLAT = """{0}_p AS (SELECT species, k, CASE WHEN k BETWEEN 40 AND 46 THEN max(CASE WHEN k = 40 THEN value END) OVER (PARTITION BY species) ELSE value END AS value FROM {0})"""

ORACLES = {
    "ensemble_first": f"WITH {cube(ens=True)} SELECT expt, variable, time, cell, lat, lon, round(value, 6) AS value FROM f WHERE ens = 0",
    "control_climatology": f"WITH {cube()}, {CLIM} SELECT variable, cell, round(climatology, 4) AS climatology FROM clim",
    "anomaly": f"WITH {cube()}, {ANOM} SELECT expt, variable, time, cell, round(value, 4) AS value FROM a",
    "first_100": f"WITH {cube('weekly')} SELECT expt, variable, step, cell, round(value, 6) AS value FROM f JOIN ax USING (time) WHERE step < 100",
    "field_gate": f"WITH {cube('weekly')} SELECT expt, variable, count(value) AS n_values FROM f JOIN ax USING (time) WHERE step < 100 GROUP BY ALL HAVING count(value) > 0",
    "make_anom": f"""WITH {cube()}, {CLIM}, an AS (SELECT expt, variable, time, lat, lon, value - climatology AS value FROM f JOIN clim USING (variable, cell) WHERE expt <> 'base'),
g AS (SELECT k.*, lat, lon, value FROM (SELECT DISTINCT expt, variable, time FROM an) k CROSS JOIN (SELECT DISTINCT lat FROM an)
  CROSS JOIN (SELECT DISTINCT lon FROM an) LEFT JOIN an USING (expt, variable, time, lat, lon)), {_fill("g", "lat", "g1")}, {_fill("g1", "lon", "g2")}
SELECT expt, variable, time, lat, lon, round(value, 4) AS value FROM g2""",
    "nearest_fill": f"""WITH {cube()}, g AS (SELECT k.*, lat, lon, value FROM (SELECT DISTINCT expt, variable, time FROM f) k CROSS JOIN (SELECT DISTINCT lat FROM f)
  CROSS JOIN (SELECT DISTINCT lon FROM f) LEFT JOIN f USING (expt, variable, time, lat, lon)), {_fill("g", "lat", "g1")}, {_fill("g1", "lon", "g2")}
SELECT expt, variable, time, lat, lon, round(value, 6) AS value FROM g2""",
    "area_weight": f"WITH {cube()} SELECT DISTINCT lat, round({W}, 6) AS weight FROM f",
    "area_weight_2d": f"WITH {cube()} SELECT DISTINCT lat, lon, round({W} * 0.99 + 0.01, 6) AS weight FROM f",
    "area_weight_3d": f"WITH {cube()} SELECT time, lat, lon, round({W} * 0.99 + 0.01, 6) AS weight FROM (SELECT DISTINCT time FROM f) CROSS JOIN (SELECT DISTINCT lat, lon FROM f)",
    "fit_mean": f"WITH {cube()}, {FIT_MEAN} SELECT expt, variable, time, round(value, 4) AS value FROM fm",
    "global_mean": f"WITH {cube(ens=True)} SELECT expt, variable, time, ens, round(avg(value * {W} / m), 4) AS value FROM f, mw GROUP BY ALL",
    "weighted_mean": f"WITH {cube()} SELECT expt, variable, time, round(sum(value * {W}) / sum({W}) FILTER (value IS NOT NULL), 4) AS value FROM f GROUP BY ALL",
    "amplitude_guess": f"WITH {cube()}, {AMPLITUDE} SELECT expt, variable, round(amplitude, 4) AS amplitude FROM am",
    "initial_params": f"""WITH {cube()}, {AMPLITUDE} SELECT expt, variable, CAST(mode AS INT) AS mode, round(amplitude, 4) AS s, pow(10.0, mode + 1) AS tau, pow(10.0, mode + 1) * 10 AS tau_max
FROM am JOIN (VALUES ('tas', 0), ('tas', 1), ('pr', 0), ('pr', 1), ('pr', 2)) v(variable, mode) USING (variable)""",
    "exp_response": f"WITH {cube()} SELECT step, round(5.0 * (1 - exp(-step / 25.0)), 6) AS value FROM ax",
    "exp_basis": f"WITH {cube()}, {PARAMS} SELECT step, mode, round(s * (1 - exp(-step / tau)), 6) AS u FROM ax, p",
    "exp_sum": f"WITH {cube()}, {PARAMS} SELECT step, round(sum(s * (1 - exp(-step / tau))), 6) AS total FROM ax, p GROUP BY step",
    "weighted_residual": f"""WITH {cube()}, {FIT_MEAN}, {PARAMS} SELECT expt, variable, step, mode, round(1.0 / (mode + 1) * (value - s * (1 - exp(-step / tau))), 4) AS residual
FROM fm JOIN ax USING (time), p""",
    "synthetic_forcing": f"WITH {FORCING} SELECT k, round(5 * exp(-(k - 40) * (k - 40) / 500.0), 6) AS gaussian, round(k * 2.0::DOUBLE / max(k) OVER (), 6) AS ramp FROM fo",
    "forcing_increments": f"WITH {INCREMENTS} SELECT k, round(d, 6) AS d FROM inc",
    "pc_convolution": f"WITH {INCREMENTS}, {PARAMS} SELECT x.k, mode, round(sum(j.d * s * (1 - exp(-(x.k - j.k) / tau))), 6) AS y FROM inc x JOIN inc j ON j.k <= x.k, p GROUP BY ALL",
    "quadratic_forcing": f"WITH {FORCING} SELECT k, round(0.9::DOUBLE * f + 0.1::DOUBLE * f * f, 6) AS f FROM fo",
    "pattern_projection": f"WITH {PATTERNS} SELECT expt, variable, mode, cell, round(v, 4) AS v FROM pt",
    "pattern_map": f"WITH {PATTERNS} SELECT expt, variable, mode, lat, lon, round(v, 4) AS v FROM pt WHERE mode < 1",
    "reconstruct": f"WITH {PATTERNS} SELECT expt, variable, step, cell, round(value, 4) AS value FROM rc",
    "predict_forcing": f"WITH {PREDICTED} SELECT variable, CAST(time AS INT) AS time, cell, round(value, 4) AS value FROM pf",
    "predict_combined": f"""WITH {PATTERNS}, {SPECIES_FORCING}, {ATTRIBUTED.format(rows="(false, 'CO2', 'co2x2')", names="'co2x2', 'sulx5'")},
ss(expt, size) AS (VALUES ('co2x2', 4.08::DOUBLE), ('sulx5', -2.5::DOUBLE)),
inc AS (SELECT expt, CAST(row_number() OVER (PARTITION BY expt ORDER BY k) - 1 AS INT) AS k, coalesce(lead(f) OVER (PARTITION BY expt ORDER BY k) - f, 0.0) / size AS d FROM af JOIN ss USING (expt)),
y AS (SELECT x.expt, x.k, mode, sum(j.d * s * (1 - exp(-(x.k - j.k) / tau))) AS u FROM inc x JOIN inc j ON x.expt = j.expt AND j.k <= x.k, p GROUP BY ALL)
SELECT variable, CAST(k + 1850 AS INT) AS year, cell, round(CASE WHEN count(v) = count(*) THEN sum(u * v) END, 3) AS value FROM pt JOIN y USING (expt, mode) GROUP BY ALL""",
    "trained_params": f"WITH {NOISE_FREE} SELECT 'co2x2' AS expt, variable, CAST(0 AS INT) AS mode, round(s, 2) AS s, 6.0::DOUBLE AS tau, 100.0::DOUBLE AS tau_max FROM s",
    "trained_patterns": f"WITH {NOISE_FREE} SELECT 'co2x2' AS expt, variable, CAST(0 AS INT) AS mode, cell, round(a / s, 3) AS v FROM a JOIN s USING (variable)",
    "trained_prediction": f"""WITH {NOISE_FREE}, {INCREMENTS}, y AS (SELECT x.k, sum(j.d * (1 - exp(-(x.k - j.k) / 6.0::DOUBLE))) AS y FROM inc x JOIN inc j ON j.k <= x.k GROUP BY ALL)
SELECT variable, CAST(k + 1850 AS INT) AS time, cell, round(a * y, 2) AS value FROM a, y WHERE variable = 'tas'""",
    "named_training": f"""WITH {NOISE_FREE}, {SCENARIO}, {FORCING}, inc AS (SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS k,
  coalesce(lead(f) OVER (ORDER BY k) - f, 0.0) / (erf * 5.35 * ln(2)) AS d FROM fo, gp WHERE species = 'CO2'),
y AS (SELECT x.k, sum(j.d * (1 - exp(-(x.k - j.k) / 6.0::DOUBLE))) AS y FROM inc x JOIN inc j ON j.k <= x.k GROUP BY ALL)
SELECT variable, CAST(k + 1850 AS INT) AS time, cell, round(a * y, 2) AS value FROM a, y WHERE variable = 'tas'""",
    "gas_parameters": f"""WITH {SCENARIO} SELECT species AS gas, 'Tg' AS em_unit, CASE WHEN species IN ('SO2', 'BC', 'OC') THEN '-' ELSE 'ppm' END AS conc_unit, round(beta, 6) AS beta,
  0.0::DOUBLE AS alpha, round(tau, 6) AS tau1, 0.0::DOUBLE AS tau2, 0.0::DOUBLE AS tau3, 1.5::DOUBLE AS natural_emissions, round(erf, 6) AS sarf_to_erf FROM gp""",
    "gas_forcing": f"""WITH {SCENARIO}, {_gas("", "es", "cc", "(k < 40)", "g1")}, {_gas("", "es", "cc", "true", "g2")}
SELECT false AS conc_run, species, k, round(f, 5) AS f FROM g1 UNION ALL SELECT true, species, k, round(f, 5) FROM g2""",
    "run_scaling": f"""WITH {SCENARIO}, {FLAT.format("es")}, {FLAT.format("cc")}, ru(expt, target, m) AS (VALUES ('base', NULL, NULL), ('co2x2', 'CO2', 2), ('bcx10', 'BC', 10), ('sulx7', 'SO2', 7)),
pe AS (SELECT * FROM (SELECT expt, species, k, CASE WHEN species = target AND k BETWEEN 40 AND 46 THEN max(CASE WHEN k = 40 THEN value END) OVER (PARTITION BY expt, species) * m ELSE value END AS value FROM es_p, ru) WHERE k <= 45),
pc AS (SELECT * FROM (SELECT expt, species, k, CASE WHEN species = target AND k BETWEEN 40 AND 46 THEN max(CASE WHEN k = 40 THEN value END) OVER (PARTITION BY expt, species) * m ELSE value END AS value FROM cc_p, ru) WHERE k <= 45),
{_gas("expt, ", "pe", "pc", "true", "g1")}, tt AS (SELECT expt, k, sum(f) AS f FROM g1 GROUP BY ALL), la AS (SELECT expt, max_by(f, k) AS last FROM tt GROUP BY expt)
SELECT l.expt, round(l.last - b.last, 4) AS scaling FROM la l, la b WHERE b.expt = 'base'""",
    "predict_emissions": f"""WITH {PATTERNS}, {SCENARIO}, {FLAT.format("es")}, {FLAT.format("cc")}, {_gas("", "es", "cc", "(k < 40)", "g1")}, {_gas("", "es_p", "cc_p", "true", "g2")},
bo AS (SELECT false AS conc_run, * FROM g1 UNION ALL SELECT true, * FROM g2),
co AS (SELECT conc_run, k, sum(f) AS f FROM bo GROUP BY ALL), ic AS (SELECT conc_run, CAST(row_number() OVER (PARTITION BY conc_run ORDER BY k) - 1 AS INT) AS k,
  coalesce(lead(f) OVER (PARTITION BY conc_run ORDER BY k) - f, 0.0) / 4.08 AS d FROM co),
y AS (SELECT x.conc_run, x.k, mode, sum(j.d * s * (1 - exp(-(x.k - j.k) / tau))) AS u FROM ic x JOIN ic j ON x.conc_run = j.conc_run AND j.k <= x.k, p GROUP BY ALL)
SELECT conc_run, variable, CAST(k + 1850 AS INT) AS year, cell, round(CASE WHEN count(v) = count(*) AND count(zero) = count(*) THEN sum(u * v) END, 3) AS value
FROM (SELECT y.*, pt.variable, pt.cell, pt.v, z.v AS zero FROM y JOIN pt USING (mode) JOIN pt z ON z.variable = pt.variable AND z.cell = pt.cell AND z.mode = pt.mode AND z.expt = 'sulx5' WHERE pt.expt = 'co2x2')
GROUP BY conc_run, variable, k, cell""",
    "gridded_files": f"""WITH {cube()} SELECT expt, CAST(CASE expt WHEN 'base' THEN 0 WHEN 'co2x2' THEN 1 ELSE 2 END AS INT) AS expt_idx, time, lat, lon, round(value, 6) AS value
FROM f WHERE variable = 'tas' AND time >= 12 AND time < 60""",
    "stack_experiments": """SELECT 'supplier' AS expt, CAST(0 AS INT) AS expt_idx, count(*) AS n, round(avg(s_acctbal), 4) AS balance, count(s_suppkey) AS n_suppliers FROM supplier
UNION ALL SELECT 'customer', 1, count(*), round(avg(c_acctbal), 4), 0 FROM customer""",
    "parse_experiment": f"""WITH {NAMES} SELECT DISTINCT expt, CASE upper(split_part(expt, 'x', 1)) WHEN 'SUL' THEN 'SO2' ELSE upper(split_part(expt, 'x', 1)) END AS species,
CAST(split_part(expt, 'x', 2) AS INT) AS multiplier FROM nm""",
    "experiment_label": f"""WITH {NAMES}, l AS (SELECT year, list_transform(list(expt ORDER BY expt), lambda x: split_part(x, 'x', 1)) AS n FROM nm GROUP BY year)
SELECT year, upper(array_to_string(n, '+')) AS label,
  'Pattern with ' || CASE WHEN len(n) > 1 THEN array_to_string(n[1:len(n) - 1], ', ') || ' and ' || n[len(n)] ELSE array_to_string(n, '') END AS title FROM l""",
    "emissions_long": f"WITH {EMISSIONS} SELECT k, species, round(value, 2) AS value FROM em",
    "plateau": f"""WITH {EMISSIONS} SELECT k, species, round(CASE WHEN k BETWEEN 40 AND 46 THEN max(CASE WHEN k = 40 THEN value END) OVER (PARTITION BY species) ELSE value END, 2) AS value FROM em""",
    "perturbation": f"WITH {RUNS} SELECT expt, species, k, round(value, 2) AS value FROM pe",
    "step_scaling": f"""WITH {RUNS}, pk AS (SELECT * FROM pe WHERE k <= 45), {_box("pk", "expt, ")}, tt AS (SELECT expt, k, sum(f) AS f FROM hf GROUP BY ALL),
la AS (SELECT expt, max_by(f, k) AS last FROM tt GROUP BY expt) SELECT l.expt, round(l.last - b.last, 4) AS scaling FROM la l, la b WHERE b.expt = 'base'""",
    "aerosol_mapping": f"""WITH o AS (SELECT o_custkey, list(DISTINCT {SPECIES}) AS s FROM orders GROUP BY o_custkey),
m AS (SELECT o_custkey, s, CASE WHEN list_contains(s, 'BC') THEN 'BC' WHEN list_contains(s, 'OC') THEN 'OC' WHEN list_contains(s, 'SO2') THEN 'SO2' ELSE 'CO2' END AS other FROM o),
v(component, own) AS (VALUES ('SO4_IND', 'SO2'), ('BMB_AEROS_BC', 'BC'), ('BMB_AEROS_OC', 'OC'))
SELECT o_custkey, component, CASE WHEN list_contains(s, own) THEN own ELSE other END AS target FROM m, v
UNION ALL SELECT o_custkey, x, other FROM m, (SELECT unnest(['SO2', 'BC', 'OC']) AS x) WHERE NOT list_contains(s, x)""",
    "forcer_attribution": f"""WITH {SPECIES_FORCING}, {ATTRIBUTED.format(
        rows="(false, 'CO2', 'co2x2'), (false, 'BC', 'bcx10'), (false, 'SO2', 'bcx10'), (false, 'OC', 'bcx10'), (true, 'CO2', 'co2x2'), (true, 'BC', 'bcx10'), (true, 'SO2', 'sulx5'), (true, 'OC', 'bcx10')",
        names="'base', 'co2x2', 'sulx5', 'bcx10'")} SELECT expt, k, round(f, 6) AS f, sul_is_so2 FROM af""",
    "natural_emissions": f"WITH {EMISSIONS} SELECT DISTINCT k, s AS species, 242.09::DOUBLE AS value FROM em, (SELECT unnest(['CH4', 'N2O']) AS s)",
    "species_forcing": f"""WITH {EMISSIONS}, {_box("em", "")} SELECT species, k, round(f, 4) AS f FROM hf
UNION ALL SELECT 'Total_forcing', k, round(sum(f), 4) FROM hf GROUP BY k""",
    "forcing_stack": f"""WITH {SPECIES_FORCING}, t AS (SELECT k, sum(f) FILTER (species = 'CO2') AS CO2, sum(f) FILTER (species = 'SO2') AS SO2, sum(f) FILTER (species = 'BC') AS BC,
  sum(f) FILTER (species = 'OC') AS OC FROM sf WHERE species <> 'CH4' GROUP BY k)
SELECT k, round(CO2, 6) AS CO2, round(SO2, 6) AS SO2, round(BC, 6) AS BC, round(OC, 6) AS OC, round(coalesce(CO2, 0) + coalesce(SO2, 0) + coalesce(BC, 0) + coalesce(OC, 0), 6) AS stack FROM t""",
    "diag_prediction_mean": f"WITH {PREDICTED} SELECT CAST(time AS INT) AS time, round(sum(value * {W}) / sum({W}) FILTER (value IS NOT NULL), 4) AS value FROM pf GROUP BY time",
    "diag_global_means": _means(f"avg(value * {W} / m)"),
    "diag_weighted_means": _means(f"sum(value * {W}) / sum({W}) FILTER (value IS NOT NULL)"),
    "diag_fast_means": f"WITH {PATTERNS} SELECT expt, variable, step, round(CASE WHEN count(value) = count(*) THEN sum(value * {W}) / sum({W}) END, 4) AS value FROM rc GROUP BY expt, variable, step",
    "period_change": f"""WITH {cube()} SELECT expt, variable, cell, round(avg(value) FILTER (step BETWEEN 60 AND 79) - avg(value) FILTER (step BETWEEN 0 AND 19), 4) AS change
FROM f JOIN ax USING (time) WHERE step < 100 GROUP BY ALL""",
    "anchored_series": f"""WITH {cube()}, {FIT_MEAN}, t AS (SELECT expt, variable, time, value, CASE WHEN time < 40 THEN 'past' ELSE 'scenario' END AS period FROM fm)
SELECT expt, variable, time, period, round(value - first_value(CASE WHEN period = 'past' THEN value END IGNORE NULLS) OVER (PARTITION BY expt, variable ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS value FROM t""",
}
ORACLES["pc_recursion"] = ORACLES["pc_convolution"]
# the same results in another layout
ORACLES["series_projection"] = ORACLES["pattern_projection"]
ORACLES["series_reconstruction"] = ORACLES["reconstruct"]
