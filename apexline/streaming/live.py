"""Live laps: Structured Streaming over fixes as they arrive.

A stream of fixes has (rec, ts, t, v, x, y).  Runs without a gap are session
windows; laps need the crossing before, which a small state for each recording keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import CONFIG

LAPS = "rec long, lap_id long, t_start double, lap_s double, v_max double"
STATE = "t double, x double, y double, crossing double, laps long, v_max double"


def runs(fixes: DataFrame, late: str = "10 seconds", gap_s: float = CONFIG.run_gap_s) -> DataFrame:
    """(rec, start, end, n, v_max): unbroken runs of fixes; a run ends when nothing comes for ``gap_s``."""
    window = F.session_window("ts", f"{int(gap_s * 1000)} milliseconds")
    return fixes.withWatermark("ts", late).groupBy("rec", window.alias("w")).agg(F.count("*").alias("n"), F.max("v").alias("v_max")).select("rec", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "v_max")


def speeds(fixes: DataFrame, late: str = "10 seconds", width: str = "10 seconds", every: str = "5 seconds") -> DataFrame:
    """(rec, start, n, mean_v, v_max) in sliding windows of time; fixes later than ``late`` are left out."""
    g = fixes.withWatermark("ts", late).groupBy("rec", F.window("ts", width, every).alias("w")).agg(F.count("*").alias("n"), F.avg("v").alias("mean_v"), F.max("v").alias("v_max"))
    return g.select("rec", F.col("w.start").alias("start"), "n", "mean_v", "v_max")


def laps(fixes: DataFrame, line: tuple[float, float, float, float]) -> DataFrame:
    """Each lap as it is closed, by crossings of ``line`` (x1, y1, x2, y2) in any direction.

    The state is the last fix and the open lap's start and top speed, whatever
    the length of the stream.  Fixes that are older than the last one seen are left out.
    """
    x1, y1, x2, y2 = line

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last_x, last_y, crossing, n, top = state.get if state.exists else (float("nan"), 0.0, 0.0, float("nan"), 0, 0.0)
        out = []
        fresh = pd.concat(list(batches)).sort_values("t", kind="stable")
        for t, v, x, y in zip(*(fresh[c].tolist() for c in ("t", "v", "x", "y")), strict=True):
            if t <= last_t:
                continue
            a = (x2 - x1) * (last_y - y1) - (y2 - y1) * (last_x - x1)
            b = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            c = (x - last_x) * (y1 - last_y) - (y - last_y) * (x1 - last_x)
            d = (x - last_x) * (y2 - last_y) - (y - last_y) * (x2 - last_x)
            if last_t == last_t and a * b < 0 and c * d < 0:
                at = last_t + (t - last_t) * abs(a) / (abs(a) + abs(b))
                if crossing == crossing:
                    out.append((key[0], n, crossing, at - crossing, top))
                    n += 1
                crossing, top = at, 0.0
            top = max(top, v)
            last_t, last_x, last_y = t, x, y
        state.update((last_t, last_x, last_y, crossing, n, top))
        yield pd.DataFrame(out, columns=["rec", "lap_id", "t_start", "lap_s", "v_max"])

    slim = fixes.select(F.col("rec").cast("long").alias("rec"), "t", "v", "x", "y")
    return slim.groupBy("rec").applyInPandasWithState(step, LAPS, STATE, "append", GroupStateTimeout.NoTimeout)
