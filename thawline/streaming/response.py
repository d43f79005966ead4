"""Responses to forcing that arrives as a stream.

An exponential kernel needs one number of state a mode: z_k = (z_{k-1} + s * d_{k-1}) * exp(-1 / tau), and the
response is s * (F_k - F_0) / step - z_k, the same as the batch convolution gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_forcing(events: DataFrame, scale: float = 1.0, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(scenario, start, f): mean value by event type and window; events later than ``late`` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.col("event_type").alias("scenario"), F.window("ts", size))
    return rows.agg((F.avg("value") / scale).alias("f")).select("scenario", F.col("window.start").alias("start"), "f")


def stream_response(forcing: DataFrame, params: list[tuple[int, float, float]], step: float) -> DataFrame:
    """(scenario, k, mode, y) for a stream (scenario, k, f) whose points come in order of k from 0, in any batches.

    Points that come again or too late are ignored.
    """
    mode, s, tau = (np.array(x) for x in zip(*params, strict=True))
    fade = np.exp(-1 / tau)

    def respond(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values("k")  # the points of one scenario in one batch
        last, f0, f_last, z = -1, 0.0, 0.0, np.zeros(len(mode))
        if state.exists:
            last, f0, f_last, held = state.get
            z = np.array(held)
        ks, fs = pdf["k"].to_numpy(), pdf["f"].to_numpy(float)
        new = np.concatenate((ks[:1] > last, (ks[1:] > last) & (ks[1:] != ks[:-1])))
        ks, fs = ks[new], fs[new]
        y = np.empty((len(ks), len(mode)))
        for i, f in enumerate(fs):
            if last < 0 and not i:
                f0 = f_last = f
            else:
                z = (z + s * (f - f_last) / step) * fade
            y[i], f_last = s * (f - f0) / step - z, f
        if len(ks):
            last = int(ks[-1])
            yield pd.DataFrame({"scenario": key[0], "k": np.repeat(ks, len(mode)), "mode": np.tile(mode, len(ks)), "y": y.ravel()})
        state.update((last, float(f0), float(f_last), [float(x) for x in z]))

    return forcing.groupBy("scenario").applyInPandasWithState(
        respond, "scenario string, k long, mode int, y double", "last long, f0 double, f_last double, z array<double>", "append", GroupStateTimeout.NoTimeout
    )
