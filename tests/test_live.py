"""Live laps against the same laps of the whole trace, over files as they come."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from apexline.operators import laps
from apexline.streaming import live

FIX = "rec long, seq long, ts timestamp, t double, v double, x double, y double"


def circle(rec: int, n: int, step: float) -> list[tuple]:
    """A drive around a circle of 30 m that begins left of the top."""
    start = dt.datetime(2024, 1, 1)
    return [(rec, i, start + dt.timedelta(seconds=i / 10), i / 10, 10.0 + rec + i % 7, 30 * math.sin(-0.3 + i * step), 30 * math.cos(-0.3 + i * step)) for i in range(n)]


@pytest.fixture()
def stream(spark, tmp_path):
    rows = circle(1, 500, 0.05) + circle(2, 300, 0.07)
    for part in range(5):  # in order of time, as fixes arrive
        spark.createDataFrame([r for r in rows if part * 10 <= r[3] < part * 10 + 10], FIX).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return rows, spark.readStream.schema(FIX).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), str(tmp_path / "state")


def done(df, mode: str, folder: str, name: str):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_live_laps_are_those_of_the_whole_trace(spark, stream):
    rows, fixes, folder = stream
    line = (0.0, 25.0, 0.0, 35.0)
    got = sorted((r.rec, r.lap_id, round(r.t_start, 3), round(r.lap_s, 3)) for r in done(live.laps(fixes, line), "append", folder, "live_laps"))
    trace = spark.createDataFrame(rows, FIX)
    lines = trace.select("rec").distinct().withColumn("line", F.struct(*[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), line, strict=True)]))
    cross = [tuple(r) for r in laps.numbered(laps.line_crossings(trace, lines)).select("rec", "lap_id", "t_cross").orderBy("rec", "lap_id").collect()]
    want = [(a[0], a[1], a[2], round(b[2] - a[2], 3)) for a, b in zip(cross, cross[1:], strict=False) if a[0] == b[0]]
    assert len(got) == len(want) >= 4
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2:] for g in got] == [pytest.approx(w[2:], abs=2e-3) for w in want]


def test_live_runs_end_with_a_gap(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, start + dt.timedelta(seconds=s), float(s), 5.0 + i, 0.0, 0.0) for i, s in enumerate([0, 0.5, 1.0, 10, 10.5, 60])]
    spark.createDataFrame(rows, FIX).coalesce(1).write.parquet(f"{tmp_path}/in")
    fixes = spark.readStream.schema(FIX).parquet(f"{tmp_path}/in")
    got = sorted((r.n, r.v_max) for r in done(live.runs(fixes), "append", str(tmp_path / "state"), "live_runs"))
    assert got == [(2, 9.0), (3, 7.0)]
