"""Chapters, transponder lists, JSON stores and metadata payloads."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from apexline.operators import house
from apexline.sources import gpmf, recordings


def test_chapters_of_a_recording(spark):
    names = ["/c/GX020007.MP4", "/c/gx010007.mp4", "/c/GX010008.MP4", "/c/other.mov", "/c/other.mov"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.rec: (r.label, r.paths) for r in recordings.recordings(files).collect()}
    assert got["/c/GX0007"] == ("gx010007.mp4 (2 chapters)", ["/c/gx010007.mp4", "/c/GX020007.MP4"])
    assert got["/c/other.mov"] == ("other.mov", ["/c/other.mov"]) and len(got) == 3
    assert [r.chapter for r in recordings.siblings(files, "/c/GX020007.MP4").collect()] == [1, 2]


def test_chapter_times(spark):
    m = recordings.chapter_map(spark.createDataFrame([(1, 1, 10.0), (1, 2, 5.0)], "rec int, chapter int, duration double"))
    t = spark.createDataFrame([(1, -1.0), (1, 9.5), (1, 10.0), (1, 99.0)], "rec int, t double")
    got = {r.t: (r.chapter, r.local) for r in recordings.to_local(t, m).collect()}
    assert got == {-1.0: (1, 0.0), 9.5: (1, 9.5), 10.0: (2, 0.0), 99.0: (2, 5.0)}


def test_transponder_skips_bad_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Lap,Pos,Lap Time\n1,3,1:02.500,x\nbad\n2,1,62.5\n3,1,0:59.9\n")
    assert [tuple(r) for r in recordings.transponder(spark, str(tmp_path / "t.csv")).orderBy("lap_no").collect()] == [(1, 62.5), (3, 59.9)]


def test_stores_migrate_and_leave_out_what_is_invalid(spark, tmp_path):
    (tmp_path / "lib.json").write_text(json.dumps({"version": 1, "entries": [{"fingerprint": "GX0007", "best": 61.2, "lap_count": 3}, {"fingerprint": "", "best": 1.0}, {"fingerprint": "b", "best": -1.0}]}))
    assert [(r.fingerprint, r.verified, r.degraded, r.dropout) for r in recordings.library(spark, str(tmp_path / "lib.json")).collect()] == [("GX0007", True, False, False)]
    good = {"version": 1, "track": "a", "start": [[1, 2], [3, 4]], "sectors": []}
    (tmp_path / "s.json").write_text(json.dumps(good))
    assert [(r.track, r.confirmed) for r in recordings.sidecars(spark, str(tmp_path / "s.json")).collect()] == [("a", True)]
    (tmp_path / "bad.json").write_text(json.dumps(good | {"start": [[1, 2]]}))
    assert recordings.sidecars(spark, str(tmp_path / "bad.json")).count() == 0


def test_payloads(spark):
    gps9 = gpmf.packed("SCAL", "l", np.array([1, 1, 1, 1, 1, 1, 1])) + gpmf.packed("GPS9", "l", np.array([[45, 7, 100, 10, 11, 1, 2], [46, 8, 101, 12, 13, 1, 3]]))
    accl = gpmf.packed("SCAL", "s", np.array([10])) + gpmf.packed("ACCL", "s", np.array([[10, 20, 30], [40, 50, 60]]))
    whole = gpmf.nested("DEVC", gpmf.nested("STRM", gps9) + gpmf.nested("STRM", accl))
    p = spark.createDataFrame([("r", 1, 2.0, 3.0, bytearray(whole)), ("r", 2, 0.0, 1.0, bytearray(whole[:20])), ("r", 3, 0.0, 1.0, None)], "rec string, chapter int, t_in double, t_out double, payload binary")
    got = gpmf.fixes(p).orderBy("k").collect()
    assert [(r.naive, r.lat, r.full_speed, r.ts_ms, r.fix) for r in got] == [(2.0, 45, 11, 946684800000 + 86_402_000, -1), (2.5, 46, 13, 946684800000 + 86_403_000, -1)]
    assert [(r.stream, r.t, r.w, r.x, r.z) for r in gpmf.motion(p).orderBy("t").collect()] == [("ACCL", 2.0, None, 1.0, 3.0), ("ACCL", 2.5, None, 4.0, 6.0)]


def test_moving_median(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 9.0, 2.0, 3.0, 50.0])], "k int, i int, v double")
    got = [r.m for r in d.select("i", house.moving_median("v", ["k"], "i", 3).alias("m")).orderBy("i").collect()]
    assert got == pytest.approx([5.0, 2.0, 3.0, 3.0, 26.5])


def test_interpolation_of_a_column_named_x(spark):
    s = spark.createDataFrame([(1, 0.0, 5.0), (1, 2.0, 7.0)], "k int, d double, x double")
    g = spark.createDataFrame([(1, 1.0)], "k int, d double")
    assert house.interp_join(s, g, ["k"], "d", ["x"]).select(F.col("x")).first()[0] == 6.0
