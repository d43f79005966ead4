"""Fit of response time scales to global-mean series, and patterns from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Powers of ten beyond this don't fit whole numbers.
MOST_MODES = 18
SMALLEST_TAU = 1e-12


def initial_params(guess: DataFrame, modes: DataFrame) -> DataFrame:
    """(expt, variable, mode, s, tau, tau_max): starting amplitude from ``guess``, time scales 10, 100, ... bounded by ten times.

    ``modes``: (variable, n_modes).
    """
    m = F.explode(F.sequence(F.lit(0), F.col("n_modes") - 1)).alias("mode")
    start = guess.join(modes, "variable").select("expt", "variable", m, F.col("amplitude").alias("s"))
    tau = F.pow(F.lit(10.0), F.col("mode") + 1)
    return start.select("expt", "variable", "mode", "s", tau.alias("tau"), (tau * 10).alias("tau_max"))


def responses(n: int, s: np.ndarray, tau: np.ndarray) -> np.ndarray:
    return s * (1 - np.exp(-np.arange(n)[:, None] / tau))


def fit_series(y: np.ndarray, s: float, n_modes: int, loss: str = "quartic", rounds: int = 400) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """(s, tau, cost, converged) of the sum of ``n_modes`` responses nearest to y, by damped least squares.

    Time scales start at 10, 100, ... and stay within [0, ten times that] through a sine. ``quartic``: the squared
    deviations are the residuals, so the cost is the sum of fourth powers; ``l2``: the deviations are.
    """
    if n_modes > MOST_MODES:
        raise ValueError(f"at most {MOST_MODES} modes")
    if len(y) < 2 * n_modes:
        raise ValueError(f"{n_modes} modes need {2 * n_modes} points, there are {len(y)}")
    top = 10.0 ** (np.arange(n_modes) + 2)
    tau_of = lambda q: np.maximum((np.sin(q) + 1) * top / 2, SMALLEST_TAU)

    t = np.arange(len(y))[:, None]

    def residuals(p):
        off = y - responses(len(y), p[:n_modes], tau_of(p[n_modes:])).sum(1)
        return off * off if loss == "quartic" else off

    def derivatives(p):
        s, q = p[:n_modes], p[n_modes:]
        tau = tau_of(q)
        fade = np.exp(-t / tau)
        jac = np.column_stack((fade - 1, s * fade * (t / tau**2) * np.cos(q) * top / 2))
        return 2 * (y + (s * (fade - 1)).sum(1))[:, None] * jac if loss == "quartic" else jac

    p = np.concatenate((np.full(n_modes, s), np.full(n_modes, np.arcsin(2 * 0.1 - 1))))
    r = residuals(p)
    cost, damp, done = float(r @ r), 1e-3, False
    exact = cost * (1e-52 if loss == "quartic" else 1e-26)  # deviations of 1e-13 of the first ones
    for _ in range(rounds):
        jac = derivatives(p)
        a, g = jac.T @ jac, jac.T @ r
        for _ in range(20):
            step = np.linalg.lstsq(a + damp * (np.diag(np.diag(a)) + 1e-12 * np.eye(len(p))), -g, rcond=None)[0]
            new = residuals(p + step)
            if np.isfinite(new).all() and new @ new < cost:
                break
            damp *= 4
        else:
            done = True
            break
        gain, p, r = cost - float(new @ new), p + step, new
        cost, damp = float(r @ r), max(damp / 5, 1e-12)
        if gain <= 1e-14 * cost or cost <= exact:
            done = True
            break
    return p[:n_modes], tau_of(p[n_modes:]), cost, done


FIT_SCHEMA = "expt string, variable string, mode int, s double, tau double, tau_max double, cost double, converged boolean"


def fit_timescales(series: DataFrame, guess: DataFrame, modes: DataFrame, loss: str = "quartic") -> DataFrame:
    """Fitted (expt, variable, mode, s, tau, tau_max, cost, converged) for series (expt, variable, step, value).

    One task fits one series, whose length is the number of steps; missing steps are left out.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values("step")
        n = int(pdf["n_modes"].iloc[0]) if len(pdf) else 0
        if not n:
            return pd.DataFrame(columns=[c.split()[0] for c in FIT_SCHEMA.split(", ")])
        s, tau, cost, done = fit_series(pdf["value"].to_numpy(), float(pdf["amplitude"].iloc[0]), n, loss)
        return pd.DataFrame(
            {"expt": pdf["expt"].iloc[0], "variable": pdf["variable"].iloc[0], "mode": np.arange(n, dtype=np.int32), "s": s, "tau": tau,
             "tau_max": 10.0 ** (np.arange(n) + 2), "cost": cost, "converged": done}
        )

    rows = series.join(guess, ["expt", "variable"]).join(F.broadcast(modes), "variable")
    return rows.groupBy("expt", "variable").applyInPandas(fit, FIT_SCHEMA)


def pseudo_inverse(basis: DataFrame) -> DataFrame:
    """(expt, variable, step, mode, w): pseudo-inverse of each field's basis (expt, variable, step, mode, u), any number of modes."""

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        u = pdf.pivot(index="step", columns="mode", values="u").sort_index()
        w = np.linalg.pinv(u.to_numpy(), rcond=max(u.shape) * np.finfo(float).eps)
        m, t = np.meshgrid(u.columns.to_numpy(), u.index.to_numpy(), indexing="ij")
        return pd.DataFrame({"expt": pdf["expt"].iloc[0], "variable": pdf["variable"].iloc[0], "step": t.ravel(), "mode": m.ravel(), "w": w.ravel()})

    return basis.groupBy("expt", "variable").applyInPandas(invert, "expt string, variable string, step int, mode int, w double")
