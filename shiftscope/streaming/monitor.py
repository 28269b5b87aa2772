"""A stream extension of the regime search: residual monitoring per series.

Rows (series, ts, value) arrive in micro-batches; a two-sided cumulative sum
per series raises an alarm when its standardised value drifts, and starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALARMS = "series long, ts timestamp, direction int, score double"
STATE = "n long, mean double, m2 double, up double, down double"


def windowed_moments(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, mean and population variance per series and tumbling window, with late rows dropped after the watermark."""
    rows = stream.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "series").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")).select("series", F.col("w.start").alias("start"), "n", "mean", "var")


def drift_alarms(stream: DataFrame, slack: float = 0.5, limit: float = 8.0, warm_up: int = 20) -> DataFrame:
    """Alarms of a cumulative sum of standardised values; moments are those of all the series' rows since its last alarm."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, up, down = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            if n >= warm_up:
                z = (value - mean) / max(1e-9, (m2 / n) ** 0.5)
                up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
                if max(up, down) > limit:
                    out.append((key[0], ts, 1 if up > down else -1, max(up, down)))
                    n, mean, m2, up, down = 0, 0.0, 0.0, 0.0, 0.0
            n += 1
            d = value - mean
            mean += d / n
            m2 += d * (value - mean)
        state.update((n, mean, m2, up, down))
        yield pd.DataFrame(out, columns=["series", "ts", "direction", "score"])

    return stream.groupBy("series").applyInPandasWithState(step, ALARMS, STATE, "append", GroupStateTimeout.NoTimeout)
