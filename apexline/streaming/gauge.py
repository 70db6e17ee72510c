"""The moving dot of a force gauge: smoothed forces and their usual peaks, as samples arrive."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Share of a new sample in the dot, and samples and percentile of the peaks.
SHARE, WINDOW, PERCENTILE = 0.30, 90, 90.0
SIDES = ("right", "left", "back", "front")
DOTS = "rec long, ts timestamp, lap_id long, x double, y double, right double, left double, back double, front double, hull_x double, hull_y double"


def percentile(values: list[float], q: float = PERCENTILE) -> float:
    """By linear interpolation; 0 without values."""
    s = sorted(values)
    if not s:
        return 0.0
    at = q / 100 * (len(s) - 1)
    low = math.floor(at)
    return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)


class Dot:
    """What the gauge remembers of a recording: the dot, the last WINDOW dots, and the peaks of the lap."""

    def __init__(self, said: str | None = None):
        self.x = self.y = self.lap = None
        self.near: list[list[float]] = []
        self.peaks = [0.0] * 4
        if said:
            self.x, self.y, self.lap, self.near, self.peaks = json.loads(said)

    def __str__(self) -> str:
        return json.dumps([self.x, self.y, self.lap, self.near, self.peaks])

    def moved(self, lap: int | None, lateral: float, longitudinal: float) -> tuple:
        """The dot, peaks and point of the envelope after a sample.  A new lap begins its peaks anew; between laps they stay."""
        if lap is not None and lap != self.lap:
            if self.lap is not None:
                self.near, self.peaks = [], [0.0] * 4
            self.lap = lap
        first = self.x is None
        self.x = lateral if first else self.x + SHARE * (lateral - self.x)
        self.y = longitudinal if first else self.y + SHARE * (longitudinal - self.y)
        self.near = [*self.near[1 - WINDOW :], [self.x, self.y]]
        for k, (axis, sign) in enumerate(((0, 1), (0, -1), (1, 1), (1, -1))):
            self.peaks[k] = max(self.peaks[k], percentile([sign * p[axis] for p in self.near if sign * p[axis] > 0]))
        right, left, back, front = self.peaks
        return self.x, self.y, *self.peaks, max(min(self.x, right), -left), max(min(self.y, back), -front)


def dots(samples: DataFrame, late: str = "2 seconds") -> DataFrame:
    """(rec, ts, lap_id, x, y, right, left, back, front, hull_x, hull_y): the gauge after each sample of a stream (rec, ts, lap_id, lat_g, long_g).

    The dot follows the forces with SHARE of each new sample.  A peak is the largest PERCENTILE of the lap's last
    WINDOW dots on its side, so that a single jolt is none; the envelope's point is the dot, held
    within the peaks.  What happens depends on the order of samples, so they wait until the watermark, ``late``
    behind the newest, has passed them; later ones are left out.  Samples of one time are taken in order of their
    values.  The state is WINDOW dots and what waits, whatever the length of the stream.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        said, waiting = state.get if state.exists else ("", "[]")
        dot, rows = Dot(said), json.loads(waiting)
        mark = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            us = batch["ts"].astype("datetime64[us]").astype("int64")
            lap = batch["lap_id"].astype(object).where(batch["lap_id"].notna(), None)
            new = [[int(t), None if n is None else int(n), float(a), float(b)] for t, n, a, b in zip(us, lap, batch["lat_g"], batch["long_g"], strict=True)]
            rows += [r for r in new if r[0] > mark]
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3]))
        ready = [r for r in rows if r[0] <= mark]
        rows = rows[len(ready) :]
        out = [(key[0], pd.Timestamp(t, unit="us"), n, *dot.moved(n, a, b)) for t, n, a, b in ready]
        state.update((str(dot), json.dumps(rows)))
        if rows:
            state.setTimeoutTimestamp(max(rows[0][0] // 1000, state.getCurrentWatermarkMs() + 1))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in DOTS.split(", ")])
        yield made.astype({"lap_id": "Int64", "rec": "int64"})

    slim = samples.select(F.col("rec").cast("long").alias("rec"), "ts", F.col("lap_id").cast("long").alias("lap_id"), F.col("lat_g").cast("double").alias("lat_g"), F.col("long_g").cast("double").alias("long_g")).where("rec is not null and ts is not null and lat_g is not null and long_g is not null")
    return slim.withWatermark("ts", late).groupBy("rec").applyInPandasWithState(step, DOTS, "dot string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
