"""Camera files, stores, versions of lines, the gauge over a stream, and chapters of an IMU."""

import datetime as dt
import json
import math
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from apexline.functions import scalars
from apexline.operators import coaching, imu, laps, library, versions
from apexline.sources import gpmf, mp4, recordings, stores
from apexline.sources.tables import materialised
from apexline.streaming import gauge

# Camera files


def payload(k):
    return gpmf.nested("DEVC", gpmf.nested("STRM", gpmf.packed("SCAL", "l", np.array([1] * 7)) + gpmf.packed("GPS9", "l", np.array([[45 + k, 7, 100, 10, 11 + i, 1, 2 + i] for i in range(3)]))))


@pytest.fixture(scope="module")
def camera(tmp_path_factory):
    folder = tmp_path_factory.mktemp("camera")
    made = [[payload(k) for k in range(n)] for n in (7, 1)]
    (folder / "GX010007.MP4").write_bytes(mp4.written(made[0], video=b"x" * 3000))
    (folder / "GX020007.MP4").write_bytes(mp4.written(made[1], wide=True, per_chunk=1, scale=600, step=300))
    (folder / "GX010008.MP4").write_bytes(mp4.written(made[0])[:-400])  # cut off in its table
    (folder / "GX010009.MP4").write_bytes(b"")
    (folder / "notes.txt").write_text("no film")
    return folder, made


@pytest.mark.parametrize("slot", [1 << 10, 1 << 20])
def test_a_recording_is_read_in_partitions(spark, camera, slot):
    folder, made = camera
    mp4.register(spark)
    raw = spark.read.format("camera").option("path", str(folder)).option("slotBytes", slot).load()
    got = sorted((os.path.basename(r.path), r.n, r.t_in, r.t_out, bytes(r.payload)) for r in raw.collect())
    assert got == [("GX010007.MP4", k, float(k), k + 1.0, p) for k, p in enumerate(made[0])] + [("GX020007.MP4", 0, 0.0, 0.5, made[1][0])]
    assert (raw.rdd.getNumPartitions() > 3) == (slot == 1 << 10)
    files = spark.createDataFrame([(f"file://{folder}/{n}",) for n in os.listdir(folder)] + [(None,)], "path string")
    assert sorted(bytes(r.payload) for r in mp4.payloads(files).collect()) == sorted(p for m in made for p in m)
    # Decoded, they are the fixes of the same payloads in a table.
    named = recordings.chapters(raw).select(F.col("number").alias("rec"), "chapter", "t_in", "t_out", "payload")
    table = spark.createDataFrame([("0007", c + 1, k * (1.0, 0.5)[c], (k + 1) * (1.0, 0.5)[c], bytearray(p)) for c, m in enumerate(made) for k, p in enumerate(m)], "rec string, chapter int, t_in double, t_out double, payload binary")
    assert sorted(map(tuple, gpmf.fixes(named).collect()), key=str) == sorted(map(tuple, gpmf.fixes(table).collect()), key=str)


def test_tables_of_samples_that_are_malformed():
    whole = mp4.written([payload(0), payload(1)])
    moov = mp4.inside(whole, (b"moov",))
    good = whole[moov[0] : moov[1]]
    assert len(mp4.samples(good)) == 2 and len(mp4.samples(b"")) == 0 and len(mp4.samples(good.replace(b"gpmd", b"tmcd"))) == 0
    r = random.Random(1)
    for _ in range(300):  # never more than what the table says, and no endless loop
        bad = bytearray(good)
        for _ in range(3):
            bad[r.randrange(len(bad))] = r.randrange(4)
        try:
            assert mp4.samples(bytes(bad)).shape[1] == 4
        except (struct.error, ValueError, IndexError):
            pass


def test_times_of_gps5_payloads_are_in_utc_whatever_the_zone(spark):
    body = b"240131235959.250".ljust(16, b"\0")
    said = b"GPSU" + b"U" + bytes([16]) + struct.pack(">H", 1) + body
    whole = gpmf.nested("DEVC", gpmf.nested("STRM", said + gpmf.packed("SCAL", "l", np.array([1] * 5)) + gpmf.packed("GPS5", "l", np.array([[45, 7, 100, 10, 11]]))))
    p = spark.createDataFrame([("r", 1, 0.0, 1.0, bytearray(whole))], "rec string, chapter int, t_in double, t_out double, payload binary")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r.ts_ms for r in gpmf.fixes(p).collect()] == [1_706_745_599_250]
            d = spark.createDataFrame([("2024-01-31 23:59:59.25",), ("2024-01-31T23:59:59.25+01:00",), ("never",)], "t string")
            assert [r[0] for r in d.select(scalars.instant_ms(F.col("t"))).collect()] == [1_706_745_599_250, 1_706_741_999_250, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_seek_is_clamped(spark):
    spans = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, 2.0, 3.0), ("a", 2, 4.0, 5.0)], "path string, n int, t_in double, t_out double")
    times = spark.createDataFrame([("a", t) for t in (-5.0, 1.0, 1.9, 2.0, 3.0, 3.5, 4.9, 5.0, 9.0)], "path string, t double")
    got = [(r.t, r.n, r.at_end) for r in mp4.seek(times, spans).orderBy("t").collect()]
    assert got == [(-5.0, 0, False), (1.0, 0, False), (1.9, 0, False), (2.0, 1, False), (3.0, 2, False), (3.5, 2, False), (4.9, 2, False), (5.0, 2, True), (9.0, 2, True)]
    assert mp4.durations(spans).first()[1:] == (3, 5.0)


# Stores

ENTRY = "fingerprint string, track string, best double, lap_count int"


def test_a_store_is_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "library")
    first = spark.createDataFrame([(f"f{i}", "t", 60.0 + i, 3) for i in range(25)], ENTRY)
    monkeypatch.setattr(stores, "ENTRIES", 10)
    stores.save(first, path)
    read = lambda: {(r.fingerprint, r.best) for r in recordings.library(spark, stores.place(spark, path)).collect()}
    assert read() == {(f"f{i}", 60.0 + i) for i in range(25)} and len([f for f in os.listdir(path) if f.endswith(".json")]) > 1
    # A write that fails leaves what was there, and nothing beside it.
    broken = first.withColumn("best", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        stores.save(broken, path)
    assert len(read()) == 25 and os.listdir(tmp_path) == ["library"]
    # Between the two renames the store is found where it was set aside.
    os.rename(path, f"{path}.old")
    assert len(read()) == 25
    stores.save(first.limit(1), path)
    assert len(read()) == 1 and os.listdir(tmp_path) == ["library"]
    stores.save(first.where("false"), path)
    assert read() == set()
    stores.clear(spark, path)
    assert stores.place(spark, path) is None


def test_what_is_not_understood_is_kept(spark, tmp_path):
    path = tmp_path / "library"
    path.mkdir()
    (path / "a.json").write_text(json.dumps({"version": 9, "entries": []}))
    stores.save(spark.createDataFrame([("f", "t", 60.0, 3)], ENTRY), str(path))
    assert sorted(os.listdir(tmp_path)) == ["library", "library.bak"]
    assert json.loads((tmp_path / "library.bak" / "a.json").read_text())["version"] == 9


# Versions of lines


def _trace(spark, tmp_path):
    """Three recordings that go there and back over x = 0, stored by recording."""
    rows = []
    for rec in range(3):
        for i in range(1200):
            x = 100 * math.sin(i / 40 + 0.013)
            rows.append((rec, i, i / 10, x, 0.0, 10.0, i * 2.5))
    kind = "rec long, seq long, t double, x double, y double, v double, odo double"
    spark.createDataFrame(rows, kind).write.partitionBy("rec").parquet(f"{tmp_path}/trace")
    return spark.read.schema(kind).parquet(f"{tmp_path}/trace")


def _line(x):
    return F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (x, -5, x, 5), strict=True)])


def test_edits_undo_and_recut(spark, tmp_path, monkeypatch):
    trace = _trace(spark, tmp_path)
    recs = spark.createDataFrame([(0,), (1,), (2,)], "rec long")
    none = F.array().cast(f"array<{versions.ENDS}>")
    edit = lambda rows, x, sure=True: rows.select("rec", _line(x).alias("line"), none.alias("sectors"), F.lit(sure).alias("confirmed"))
    empty = spark.createDataFrame([], f"rec long, {versions.HISTORY}")
    h = materialised(versions.edited(empty, edit(recs, 0, False)), "h0")
    first = versions.current(h)
    crossings = materialised(laps.numbered(laps.line_crossings(trace, first.select("rec", "line"))).select("rec", "seq", "lap_id", "t_cross"), "c0")
    h1 = materialised(versions.edited(h, edit(recs.where("rec = 1"), 20)), "h1")
    assert {(r.rec, r.steps) for r in versions.undoable(h1).collect()} == {(0, 0), (1, 1), (2, 0)}
    assert versions.edited(h1, edit(recs.where("rec = 1"), 20)).count() == h1.count()  # nothing new
    after = versions.recut(trace, crossings, first, versions.current(h1))
    whole = laps.numbered(laps.line_crossings(trace, versions.current(h1).select("rec", "line"))).select("rec", "seq", "lap_id", "t_cross")
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, whole.collect()))
    assert [r.rec for r in versions.changed(first, versions.current(h1)).collect()] == [1]
    # Only the files of the edited recording are read.
    read = {f.rsplit("/", 2)[1] for f in after.inputFiles() if "/trace/" in f}
    assert "PartitionFilters: [isnotnull(rec" in after._jdf.queryExecution().executedPlan().toString() and read <= {"rec=0", "rec=1", "rec=2"}
    monkeypatch.setattr(versions, "NAMED", 0)
    assert sorted(map(tuple, versions.recut(trace, crossings, first, versions.current(h1)).collect())) == sorted(map(tuple, whole.collect()))
    monkeypatch.undo()
    # Off the track nothing crosses, so there is no way back to it; undo takes the newest version only.
    h2 = materialised(versions.edited(h1, edit(recs.where("rec = 1"), 5000)), "h2")
    back = materialised(versions.undone(h2, recs, trace), "back")
    assert {(r.rec, r.version, r.line.x1) for r in versions.current(back).collect()} == {(0, 0, 0.0), (1, 1, 20.0), (2, 0, 0.0)}
    again = materialised(versions.undone(back, recs, trace), "again")
    assert {(r.rec, r.version, r.line.x1) for r in versions.current(again).collect()} == {(0, 0, 0.0), (1, 0, 0.0), (2, 0, 0.0)}
    restored = versions.recut(trace, materialised(after, "after"), versions.current(h1), versions.current(again))
    assert sorted(map(tuple, restored.collect())) == sorted(map(tuple, crossings.collect()))
    bad = materialised(versions.edited(versions.edited(empty, edit(recs, 5000)), edit(recs, 0)), "bad")
    assert versions.undone(bad, recs, trace).count() == bad.count()  # nothing fits before


def test_history_is_bounded(spark):
    none = F.array().cast(f"array<{versions.ENDS}>")
    h = spark.range(40).select(F.lit(1).cast("long").alias("rec"), F.col("id").alias("version"), F.struct(*[F.col("id").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("line"), none.alias("sectors"), F.lit(True).alias("confirmed"))
    new = versions.edited(h, spark.range(1).select(F.lit(1).cast("long").alias("rec"), _line(-1).alias("line"), none.alias("sectors"), F.lit(True).alias("confirmed")))
    assert new.count() == versions.DEPTH + 1 and versions.current(new).first().version == 40
    assert versions.steps(new).where("version = 39").first().moved_m == pytest.approx(math.sqrt(2), abs=1e-4)


def test_local_and_global_are_inverse(spark):
    d = spark.createDataFrame([(50.0 + a / 7, 8.0 + b / 9, 30.0 * a) for a in range(5) for b in range(5)], "lat double, lon double, alt double")
    at = scalars.local_xy(F.col("lat"), F.col("lon"), F.col("alt"), F.lit(50.3), F.lit(8.2))
    back = d.select("lat", "lon", "alt", *[c.alias(n) for c, n in zip(scalars.global_of(*at, F.lit(50.3), F.lit(8.2)), "abc", strict=True)]).collect()
    assert all((r.a, r.b, r.c) == (pytest.approx(r.lat, abs=1e-9), pytest.approx(r.lon, abs=1e-9), pytest.approx(r.alt, abs=1e-4)) for r in back)


def test_tracks_are_found_across_the_date_line_and_at_the_poles(spark):
    places = spark.createDataFrame([("line", 10.0, 179.9999, 500.0), ("pole", 89.9999, 10.0, 500.0), ("far", 10.0, 179.9, 500.0), ("none", None, 1.0, 500.0)], "place string, lat double, lon double, diag double")
    known = spark.createDataFrame([("a", 10.0, -179.9999, 600.0), ("b", 89.9999, -170.0, 600.0)], "track string, k_lat double, k_lon double, k_diag double")
    assert {(r.place, r.track) for r in library.same_track(places, known).collect()} == {("line", "a"), ("pole", "b")}


def test_texts_and_pages(spark):
    d = spark.createDataFrame([("first", 60.0, None), ("beat", 59.5, 60.25), ("none", 61.0, 60.0)], "m string, b double, p double")
    assert [r[0] for r in d.select(coaching.pb_text(d.m, d.b, d.p)).collect()] == ["First time on this track", "New best by 0.750 s", None]
    table = spark.createDataFrame([(1, "a<b", 2.5), (1, "c&d", None)], "rec int, name string, v double")
    page = coaching.html_report(table, "T").first().html
    assert page.count("<tr>") == 3 and "a&lt;b" in page and "c&amp;d" in page and "—" in page
    assert [r[0] for r in spark.createDataFrame([(0,), (-5,), (86_399_000,), (90_000,)], "ms long").select(scalars.clock_text(F.col("ms"))).collect()] == [None, None, "23:59", "00:01"]


def test_blanks_come_last_both_ways(spark):
    d = spark.createDataFrame([("a", 2.0), ("b", None), ("c", float("nan")), ("d", 1.0)], "k string, v double")
    for down, want in ((False, ["d", "a"]), (True, ["a", "d"])):
        got = [r.k for r in d.orderBy(library.blanks_last("v", down), "k").collect()]
        assert got == [*want, "b", "c"]
    e = spark.createDataFrame([("Mid Track", "2024-05-01"), ("Other", "2023-01-01"), (None, "2024-05-02")], "track string, date string")
    assert library.matching(e, " 2024-05").count() == 2 and library.matching(e, "mid").count() == 1 and library.matching(e, "", "Other").count() == 1


# The gauge


def test_the_gauge_over_a_stream_is_that_of_plain_loops(spark, tmp_path):
    """Samples come in parts, out of order within the delay; some are too late and left out."""
    r = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    kind = "rec long, ts timestamp, lap_id long, lat_g double, long_g double"
    rows = [(rec, start + dt.timedelta(milliseconds=33 * i + rec), None if i % 150 > 130 else i // 150, r.gauss(0, 1), r.gauss(0, 1)) for rec in (1, 2) for i in range(600)]
    parts: list[list] = [[] for _ in range(5)]
    for row in rows:
        at = (row[1] - start).total_seconds() / 4
        parts[min(4, int(at) + (at % 1 > 0.85 and r.random() < 0.3))].append(row)
    late = [(1, start, 0, 99.0, 99.0)]
    for k, part in enumerate(parts):
        r.shuffle(part)
        spark.createDataFrame(part + (late if k == 3 else []), kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = gauge.dots(stream).writeStream.format("memory").queryName("dots").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = spark.table("dots").collect()
    mark = max(x[1] for x in rows) - dt.timedelta(seconds=2)
    want = []
    for rec in (1, 2):
        x = y = lap = None
        near, peaks = [], [0.0] * 4
        for _, ts, n, a, b in sorted((q for q in rows if q[0] == rec), key=lambda q: q[1]):
            if ts > mark:
                break
            if n is not None and n != lap:
                if lap is not None:
                    near, peaks = [], [0.0] * 4
                lap = n
            x, y = (a, b) if x is None else (x + 0.3 * (a - x), y + 0.3 * (b - y))
            near = (near + [(x, y)])[-90:]
            sides = [[p for p, _ in near if p > 0], [-p for p, _ in near if p < 0], [p for _, p in near if p > 0], [-p for _, p in near if p < 0]]
            peaks = [max(old, float(np.percentile(s, 90)) if s else 0.0) for old, s in zip(peaks, sides, strict=True)]
            want.append((rec, ts, x, y, *peaks))
    assert [(g.rec, g.ts) for g in sorted(got, key=lambda g: (g.rec, g.ts))] == [w[:2] for w in want]
    assert all((g.x, g.y, g.right, g.left, g.back, g.front) == pytest.approx(w[2:]) for g, w in zip(sorted(got, key=lambda g: (g.rec, g.ts)), want, strict=True))
    assert all(-g.left - 1e-12 <= g.hull_x <= g.right + 1e-12 and -g.front - 1e-12 <= g.hull_y <= g.back + 1e-12 for g in got)


# Two mounts in one recording


def test_each_chapters_mounting_is_recovered(spark):
    """A weaving drive in two chapters; the camera is turned by 50 degrees in the first, by -100 in the second."""
    gt = np.arange(0, 60, 0.1)
    v, psi = 15 + 4 * np.sin(0.4 * gt), 0.6 * np.sin(0.5 * gt)
    x, y = np.cumsum(v * np.cos(psi)) * 0.1, np.cumsum(v * np.sin(psi)) * 0.1
    trace = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(zip(gt, v, x, y, strict=True))], "rec long, seq long, t double, v double, x double, y double")
    rows = []
    for t in np.arange(0, 60, 0.02):
        chapter = 1 if t < 30 else 2
        yaw = math.radians(50 if chapter == 1 else -100)
        p, dp = 0.6 * math.sin(0.5 * t), 0.3 * math.cos(0.5 * t)
        s, ds = 15 + 4 * math.sin(0.4 * t), 1.6 * math.cos(0.4 * t)
        e, n = ds * math.cos(p) - s * dp * math.sin(p), ds * math.sin(p) + s * dp * math.cos(p)
        # The quaternion says nothing of the mounting, so the level axes turn with the camera.
        a, b = e * math.cos(yaw) + n * math.sin(yaw), n * math.cos(yaw) - e * math.sin(yaw)
        rows += [(1, chapter, "ACCL", float(t), None, b, a, 9.80665), (1, chapter, "GRAV", float(t), None, 0.0, 0.0, 1.0), (1, chapter, "CORI", float(t), 1.0, 0.0, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "rec long, chapter int, stream string, t double, w double, x double, y double, z double")
    chapters = spark.createDataFrame([(1, 1, 0.0), (1, 2, 30.0)], "rec long, chapter int, offset double")
    gps = materialised(imu.gps_g(trace), "gps")
    flat = materialised(imu.horizontal(table, ["rec", "chapter"]), "flat")
    fit = materialised(imu.fitted(flat, imu.in_chapters(gps, chapters), ["rec", "chapter"]), "fit")
    turns = {r.chapter: math.degrees(math.atan2(r.s, r.c)) for r in fit.collect()}
    hands = {r.chapter: r.hand for r in fit.collect()}
    assert set(turns) == {1, 2} and all(r.ok and r.r_lat > 0.98 for r in fit.collect())
    assert abs(hands[1] * turns[1] - hands[2] * turns[2]) % 360 == pytest.approx(150, abs=3) or abs(hands[1] * turns[1] - hands[2] * turns[2]) % 360 == pytest.approx(210, abs=3)
    got = imu.g_series(flat, gps, fit, chapters).toPandas()
    inside = got[(got.t > 2) & (got.t < 58) & ((got.t < 28) | (got.t > 32))]
    t = inside.t.to_numpy()
    assert set(inside.origin) == {"imu"}
    assert np.abs(inside.lat_g.to_numpy() - (15 + 4 * np.sin(0.4 * t)) * 0.3 * np.cos(0.5 * t) / 9.80665).max() < 0.06
    # One fit for the whole recording can't give both.
    alone = imu.fitted(materialised(imu.horizontal(table.drop("chapter")), "flat1"), gps).first()
    assert alone.r_lat < 0.9
    whole = imu.merged_fits(fit).first()
    assert whole.ok and whole.n == sum(r.n for r in fit.collect())


def test_tracks_at_shared_spots(spark, monkeypatch):
    """Many places and tracks at a few spots: all their pairs, and the last of equally near tracks; spots alone are compared."""
    near, compared = library._near, []
    monkeypatch.setattr(library, "_near", lambda a, b: compared.append((a.count(), b.count())) or near(a, b))
    places = spark.range(2000).selectExpr("id as place", "45 + id % 4 / 1000.0D as lat", "7.0D as lon", "500.0D + id % 2 as diag")
    known = spark.range(600).selectExpr("format_string('t%03d', id) as track", "45 + id % 3 / 1000.0D as k_lat", "7.0D as k_lon", "600.0D as k_diag")
    pairs = library.same_track(places, known)
    assert pairs.count() == 2000 * 600 and pairs.select("place", "track").distinct().count() == 2000 * 600
    got = {r.place: (r.track, r.distance_m) for r in library.detect(places, known).collect()}
    assert len(got) == 2000 and got[0] == ("t597", 0.0) and got[1] == ("t598", 0.0) and got[2] == ("t599", 0.0) and got[3][0] == "t599"
    assert compared == [(4, 3), (4, 3)]


def test_pairs_at_shared_spots_come_from_lists(spark):
    """Joins give a track once for each list of places near it, not once for each place; repeated rows, nulls and more columns stay."""

    def joined(node):
        name = node.nodeName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        return max([node.metrics().apply("numOutputRows").value() if "Join" in name else 0, *map(joined, below)])

    places = spark.range(400).selectExpr("id as place", "45 + id % 4 / 1000.0D as lat", "7.0D as lon", "500.0D + id % 2 as diag", "id * 2 as twice")
    known = spark.range(150).selectExpr("format_string('t%03d', id) as track", "45 + id % 3 / 1000.0D as k_lat", "7.0D as k_lon", "600.0D as k_diag")
    pairs = library.same_track(places, known)
    assert len(pairs.collect()) == 400 * 150
    assert joined(pairs._jdf.queryExecution().executedPlan()) <= 150 * 4
    few = places.where("place < 50")
    few = few.union(few.where("place < 10")).union(spark.sql("select null, 45.0D, 7.0D, 500.0D, 5L")).union(spark.sql("select 99L, null, 7.0D, 500.0D, 5L")).union(spark.sql("select 98L, 45.0D, -0.0D, 500.0D, 5L"))
    tracks = known.where("track < 't009'").union(known.where("track < 't002'")).union(spark.sql("select 'zero', 45.0D, 0.0D, 600.0D")).union(spark.sql("select null, 45.0D, 7.0D, 600.0D"))
    want = sorted(map(str, few.join(tracks, (F.abs(F.col("lat") - F.col("k_lat")) < 0.005) & (F.col("lon") == F.col("k_lon"))).select("place", "track", "twice", "lat", "k_lat").collect()))
    whole = pairs.columns
    for most, salts in ((4096, 4), (7, 3), (1, 1)):
        got = library.same_track(few, tracks, most, salts)
        assert sorted(got.columns) == sorted(whole) == sorted({*places.columns, *known.columns, "distance_m", "ratio"})
        assert sorted(map(str, got.select("place", "track", "twice", "lat", "k_lat").collect())) == want, (most, salts)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_camera_files_of_more_than_ten_thousand_recordings(spark, tmp_path):
    import duckdb

    from apexline.plans.oracle import ORACLE
    from apexline.plans.queries import QUERIES

    c = duckdb.connect()
    c.sql(f"copy (select event_id + 1000 * k as event_id, ts, user_id + 250000 * k as user_id, event_type, value, props from '/root/testdata/sf0.001/events.parquet', range(0, 2) t(k)) to '{tmp_path}/events.parquet'")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    for name in ("camera_payloads", "camera_seek"):
        df, want = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLE[name])
        got = sorted(map(tuple, df.select(*want.columns).collect()))
        assert {r[want.columns.index("rec")] for r in got} == {0, 10_000}, name
        assert got == sorted(want.fetchall()), name


def test_fixes_of_payloads_of_both_kinds_in_one_batch(spark):
    nine = gpmf.packed("SCAL", "l", np.array([10, 10, 1, 1, 1, 1, 1000, 100, 1])) + gpmf.packed("GPS9", "l", np.array([[500, 70, 1, 2, 3, 1, 1500, 250, 3], [510, 71, 4, 5, 6, 1, 2500, 250, 2]]))
    five = gpmf.packed("SCAL", "l", np.array([10])) + gpmf.packed("GPS5", "l", np.array([[500, 70, 10, 20, 30]]))
    held = [gpmf.nested("DEVC", gpmf.nested("STRM", s)) for s in (nine, five)]
    rows = [("a", 1, 0.0, 1.0, held[0]), ("a", 1, 1.0, 2.0, None), ("b", 2, 2.0, 3.0, held[1])]
    got = sorted(map(tuple, gpmf.fixes(spark.createDataFrame(rows, "rec string, chapter int, t_in double, t_out double, payload binary").coalesce(1)).collect()))
    day = 946_684_800_000 + 86_400_000
    assert got == [
        ("a", 1, 0, 2, 0.0, 50.0, 7.0, 1.0, 2.0, 3.0, day + 1500, 2.5, 3), ("a", 1, 1, 2, 0.5, 51.0, 7.1, 4.0, 5.0, 6.0, day + 2500, 2.5, 2),
        ("b", 2, 0, 1, 2.0, 50.0, 7.0, 1.0, 2.0, 3.0, None, -1.0, -1),
    ]
