"""The engine against DuckDB on the driver's small tables, and against circuits with known answers."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from apexline.functions import scalars
from apexline.operators import corners, house, laps, library, pace
from apexline.operators import trace as tr
from apexline.plans.oracle import ORACLE
from apexline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["quality_gate_fraction", "gap_runs", "dropout_gaps", "true_clock_runs", "lap_crossings", "lap_table", "lap_at_time", "sector_splits", "delta_grid", "otsu_threshold", "brake_islands", "grip_envelope", "track_summary", "track_match", "fingerprint", "corner_detect", "corner_times_drifted", "segment_times", "brake_events_merged", "brake_consistency", "reasons", "gap_fills", "gps_forces", "delta_at_time", "lap_stats", "camera_payloads", "recut_laps"])
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    assert rows(df, *cols) == sorted(want.select(*[f'"{c}"' for c in cols]).fetchall(), key=str)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_interp_clamps_and_meets_samples(spark):
    s = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 20.0), (1, 3.0, 50.0)], "k int, x double, y double")
    g = spark.createDataFrame([(1, -1.0), (1, 0.0), (1, 1.0), (1, 2.0), (1, 2.5), (1, 9.0), (2, 1.0)], "k int, x double")
    got = {(r.k, r.x): r.y for r in house.interp_join(s, g, ["k"], "x", ["y"]).collect()}
    assert got == {(1, -1.0): 10, (1, 0.0): 10, (1, 1.0): 15, (1, 2.0): 20, (1, 2.5): 35, (1, 9.0): 50, (2, 1.0): None}


def test_islands(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 1, 1, 0, None, 1])], "k int, i int, v int")
    assert rows(house.islands(d, ["k"], "i", F.col("v") == 1), "i", "island") == [(1, 1), (2, 1), (5, 2)]


def test_even_window_leans_back(spark):
    d = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "k int, i int, v double")
    got = [r.m for r in d.select("i", house.boxcar("v", ["k"], "i", 4).alias("m")).orderBy("i").collect()]
    assert got == [0.5, 1.0, 1.5, 2.5, 3.5, 4.0]


def test_uneven_gradient_is_exact_for_parabolas(spark):
    xs = [0.0, 1.0, 1.5, 4.0, 6.0]
    d = spark.createDataFrame([(1, x, x * x) for x in xs], "k int, x double, y double")
    got = [r.g for r in d.select("x", house.gradient("y", "x", ["k"], "x").alias("g")).orderBy("x").collect()]
    assert got[1:-1] == pytest.approx([2.0, 3.0, 8.0])


def test_unwrap(spark):
    angles = [0.0, 2.0, 4.0 - 2 * math.pi, 6.0 - 2 * math.pi, 8.0 - 2 * math.pi]
    d = spark.createDataFrame([(1, i, a) for i, a in enumerate(angles)], "k int, i int, a double")
    assert [r.u for r in house.unwrap(d, "a", ["k"], "i", "u").orderBy("i").collect()] == pytest.approx([0, 2, 4, 6, 8])


def test_three_sweeps_cross_three_times(spark):
    """Sweeps over x = 0, there and back; a vertex on the line doesn't count."""
    xs = [-3, -1, 1, 3, 1, -1, -3, -1, 1, 3]
    t = spark.createDataFrame([("a", i, float(i), float(x), 0.0, 5.0) for i, x in enumerate(xs)] + [("b", i, float(i), float(x), 0.0, 5.0) for i, x in enumerate([-1, 0, 1])], "rec string, seq long, t double, x double, y double, v double")
    line = spark.createDataFrame([("a",), ("b",)], "rec string").withColumn("line", F.struct(*[F.lit(v).alias(n) for n, v in (("x1", 0.0), ("y1", -1.0), ("x2", 0.0), ("y2", 1.0))]))
    got = laps.numbered(laps.line_crossings(t, line))
    assert rows(got, "rec", "lap_id", "t_cross", "x") == [("a", 0, 1.5, 0.0), ("a", 1, 4.5, 0.0), ("a", 2, 7.5, 0.0)]


def test_stadium_has_two_half_turns(spark):
    straight, radius, ds = 200.0, 30.0, 1.5
    arc = math.pi * radius
    total = 2 * straight + 2 * arc
    pts = []
    for lap in (0, 1):
        for k in range(int(total / ds)):
            s = k * ds
            if s < straight:
                x, y = s, 0.0
            elif s < straight + arc:
                a = -math.pi / 2 + (s - straight) / radius
                x, y = straight + radius * math.cos(a), radius + radius * math.sin(a)
            elif s < 2 * straight + arc:
                x, y = 2 * straight + arc - s, 2 * radius
            else:
                a = math.pi / 2 + (s - 2 * straight - arc) / radius
                x, y = radius * math.cos(a), radius + radius * math.sin(a)
            pts.append((0, lap, s, x, y))
    d = spark.createDataFrame(pts, "rec int, lap_id int, dist double, x double, y double")
    lengths = spark.createDataFrame([(0, total)], "rec int, length double")
    profile = corners.pooled(corners.curvature(d), lengths)
    got = corners.detect(profile, corners.otsu(profile)).orderBy("cid").collect()
    assert [r.direction for r in got] == [1, 1]
    assert [r.turn_deg for r in got] == pytest.approx([180, 180], abs=6)
    assert [r.enter for r in got] == pytest.approx([straight, 2 * straight + arc], abs=5)


def test_gate_keeps_what_is_unknown(spark):
    t = spark.createDataFrame([(0, 0, 5.0, -1.0, -1), (0, 1, 5.0, None, None), (0, 2, 5.0, 11.0, 3), (0, 3, 5.0, 1.0, 2), (0, 4, 5.0, 10.0, 3)], "rec int, seq long, v double, dop double, fix int")
    assert rows(tr.gated(t), "seq") == [(0,), (1,), (4,)]


def test_spread_of_one_is_unknown(spark):
    one = spark.createDataFrame([(0, 0, 20.0)], "rec int, lap_id long, lap_s double")
    r = pace.pace(one).first()
    assert (r.n, r.sigma_s, r.gap_s) == (1, None, 0.0)
    assert pace.theil_sen(one).first().slope is None


def test_formats(spark):
    d = spark.createDataFrame([(83.4567,), (None,)], "s double")
    assert [r[0] for r in d.select(scalars.lap_clock(F.col("s"))).collect()] == ["1:23.457", "—"]
    assert d.select(scalars.delta_text(F.lit(0.004)), scalars.delta_text(F.lit(-1.256))).first()[:] == ("0.00 s", "-1.26 s")


def test_upsert_takes_the_new(spark):
    kind = "fingerprint int, track string, date string, best double"
    old, new = spark.createDataFrame([(1, "a", "2024", 9.0), (2, "a", "2024", 8.0)], kind), spark.createDataFrame([(2, "a", "2023", 9.5), (3, "b", "2024", 1.0)], kind)
    assert rows(library.upsert(old, new), "fingerprint", "best") == [(1, 9.0), (2, 9.5), (3, 1.0)]


def test_empty_trace(spark):
    kind = "rec int, seq long, t double, v double, odo double, dop double, fix int, x double, y double, lap_no long"
    t = spark.createDataFrame([], kind)
    line = spark.createDataFrame([], "rec int, line struct<x1: double, y1: double, x2: double, y2: double>")
    c = laps.numbered(laps.line_crossings(t, line))
    assert laps.lap_table(laps.laps(t, c)).count() == 0
    assert tr.dropouts(t).count() == 0


def test_halves_are_rounded_and_laps_cut_as_in_sql(spark):
    """Steps of 3 m cross the line at half milliseconds, again and again: SQL's last bit decides, and so does ours."""
    import duckdb

    from apexline.functions.scalars import crosses, rounded

    cm = [(i, a, s) for i, (a, s) in enumerate((5000 - k, s) for s in (100, 200, 285, 300) for k in range(0, s))]
    d = spark.createDataFrame(cm, "i long, a long, s long").selectExpr("i", "i * 100 / 1000.0D as t0", "(i + 1) * 100 / 1000.0D as t", "a / 100.0D as x0", "(a + s) / 100.0D as x", "0.0D as y")
    hit, share = crosses(F.col("x0"), F.col("y"), F.col("x"), F.col("y"), F.struct(*[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (50.005, -15.0, 50.005, 15.0), strict=True)]))
    at = rounded(F.col("t0") + (F.col("t") - F.col("t0")) * share, 3)
    got = [tuple(r) for r in d.where(hit).select("i", at.alias("at"), rounded(F.col("x0") * share, 4).alias("v"), rounded(-F.col("x0") * share, 4).alias("w")).orderBy("i").collect()]
    rows_ = ", ".join(f"({i}, {a}, {s})" for i, a, s in cm)
    want = duckdb.sql(f"with d as (select i, i * 100 / 1000.0::double as t0, (i + 1) * 100 / 1000.0::double as t, a / 100.0::double as x0, (a + s) / 100.0::double as x from (values {rows_}) v(i, a, s)), r as (select *, (50.005::double - x0) / (x - x0) as r from d where (x0 - 50.005) * (x - 50.005) < 0) select i, round(t0 + (t - t0) * r, 3), round(x0 * r, 4), round(-x0 * r, 4) from r order by i").fetchall()
    assert len(got) > 800 and got == want
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-0.0001,), (2.5,), (-2.5,), (3.5,)], "v double").select(rounded("v", 0)).collect()
    assert [str(r[0]) for r in odd] == ["None", "nan", "inf", "0.0", "3.0", "-3.0", "4.0"]


def test_means_by_key_are_those_of_a_loop_without_a_join(spark):
    """Windows as wide as each key says, laid over its own rows: nothing is joined or dealt anew."""
    values = {k: [float((i * i * 7 + k) % 13) for i in range(n)] for k, n in ((1, 9), (2, 4), (3, 6), (4, 1))}
    wide = {1: 4, 2: 5, 3: 1, 4: 1}
    d = spark.createDataFrame([(k, 2 * i, v, wide[k]) for k, vs in values.items() for i, v in enumerate(vs)], "k int, o int, v double, w int")
    made = house.boxcar_by(d, "v", "w", ["k"], "o", "m")
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.k, r.o): r.m for r in made.collect()}
    for k, vs in values.items():
        for i, v in enumerate(vs):
            near = vs[max(i - wide[k] // 2, 0) : i + (wide[k] - 1) // 2 + 1]
            assert got[k, 2 * i] == pytest.approx(sum(near) / len(near) if len(vs) >= wide[k] > 1 else v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_session_tops_need_no_brakes(spark, monkeypatch):
    """Top speeds and coasts are made without corners and brake events."""
    from apexline.operators import driving

    monkeypatch.setattr(driving, "brake_events", None)
    monkeypatch.setattr(corners, "detect", None)
    assert QUERIES["session_tops"](spark, SF).count() > 0


def _rolling_loop(rows_, laps_, best):
    """:func:`laps.rolling_best` of one recording in plain loops; rows (lap, t, dist, x, y)."""
    lap = {}
    for n in laps_:
        p = sorted((r[1:] for r in rows_ if r[0] == n), key=lambda r: r[:2])
        top, made = max(r[1] for r in p), []
        for i, (t, d, x, y) in enumerate(p):
            (ax, ay), (bx, by) = (p[max(i - 1, 0)][2:], p[min(i + 1, len(p) - 1)][2:])
            half = 2 if 0 < i < len(p) - 1 else 1
            known = None not in (ax, ay, bx, by)
            gx, gy = ((bx - ax) / half, (by - ay) / half) if known else (0.0, 0.0)
            size = math.hypot(gx, gy)
            made.append((t, x, y, gx / size if size else 0.0, gy / size if size else 0.0, d / top))
        lap[n] = made
    found = []
    for n, own in lap.items():
        other = lap.get(n + 1)
        if not other:
            continue
        m = len(other)
        half = max(5, math.floor(m * 0.02))
        for t, x, y, hx, hy, share in own:
            middle = min(sum(o[5] < share for o in other), m - 1)
            near = [(-1 if None in (o[1], o[2], x, y) else (o[1] - x) ** 2 + (o[2] - y) ** 2, j) for j, o in enumerate(other) if abs(j - middle) <= half and hx * o[3] + hy * o[4] >= 0.5]
            if not near or min(near)[0] < 0:
                continue
            j, feet = min(near)[1], []
            for a, b in ((max(j - 1, 0), j), (j, min(j + 1, m - 1))):
                if None in (*other[a][1:3], *other[b][1:3]):
                    continue
                vx, vy = other[b][1] - other[a][1], other[b][2] - other[a][2]
                l2 = vx * vx + vy * vy
                u = min(max(((x - other[a][1]) * vx + (y - other[a][2]) * vy) / l2, 0.0), 1.0) if l2 > 0 else 0.0
                feet.append(((other[a][1] + u * vx - x) ** 2 + (other[a][2] + u * vy - y) ** 2, other[a][0] + u * (other[b][0] - other[a][0])))
            off, at = min(feet, key=lambda f: f[0], default=(math.inf, 0.0))
            if off <= 9:
                found.append(at - t)
    return round(min([best, *found]), 4)


def test_rolling_laps_are_those_of_a_loop_and_no_pair_is_dealt(spark):
    """Short and long laps, standing still, a lap that is missing, rows that come twice, places that aren't known and recordings without a key; plain samples are dealt, not pairs by sample number."""
    import random
    import re

    deal, samples, facts, want = random.Random(5), [], [], {}
    for rec, sizes in enumerate([(120, 131, 90, 140), (700, 650), (30, 25, 28, 33), (40,), (60, 70), (80, 85)]):
        t, rows_ = 0.0, []
        for n, size in enumerate(sizes):
            paces = [deal.choice((0.0, 1.0, 1.0, 2.0)) for _ in range(size)] + [1.0]
            done = 0.0
            for p in paces:
                a = 2 * math.pi * done / sum(paces)
                rows_.append((n, round(t, 1), done, 60 * math.cos(a) + deal.uniform(-2, 2), 40 * math.sin(2 * a) + deal.uniform(-2, 2)))
                t, done = t + deal.choice((0.1, 0.1, 0.2)), done + p
        if rec == 2:
            rows_ = [r for r in rows_ if r[0] != 1]
        if rec == 4:
            rows_ = [r for r in rows_ for _ in range(2)]
        if rec == 5:
            rows_ = [(*r[:3], None, r[4]) if i % 50 == 7 else r for i, r in enumerate(rows_)]
        samples += [(rec, *r) for r in rows_]
        known = sorted({r[0] for r in rows_})
        facts += [(rec, n, 1000.0 + n, 99, 500.0, 0.2) for n in known]
        want[rec] = _rolling_loop(rows_, known, 1000.0)
    samples += [(None, *r[1:]) for r in samples if r[0] == 0]
    d = spark.createDataFrame(samples, "rec int, lap_id long, t double, dist double, x double, y double")
    l = spark.createDataFrame(facts + [(None, *f[1:]) for f in facts if f[0] == 0], "rec int, lap_id long, lap_s double, samples long, dist_m double, max_dt double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = laps.rolling_best(d, l)
        assert not re.search(r"hashpartitioning\([^)]*\b[ij]#", made._jdf.queryExecution().executedPlan().toString())
        got = {r.rec: r.rolling_s for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.pop(None, 1000.0) == 1000.0
    assert got == pytest.approx(want) and sum(v < 1000 for v in want.values()) == 5


@pytest.fixture(scope="module")
def regrouped(tmp_path_factory):
    """sf0.1's events of recording 0, and of three copies' recordings whose laps begin at half milliseconds."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("regrouped"))
    source = "read_parquet('/root/testdata/sf0.1/events.parquet')"
    duckdb.sql(f"select * from {source} where user_id < 25 union all select * replace (event_id + 100000 as event_id, user_id + 1501 as user_id) from {source} where (user_id + 1501) // 25 in (98, 106, 116)").write_parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["brake_events_merged", "brake_points", "corner_bests", "corner_deltas", "corner_deltas_reference", "corner_detect", "corner_markers", "corner_projection", "corner_projection_drifted", "corner_report", "corner_spreads", "corner_stats"])
def test_laps_that_begin_at_half_milliseconds_have_the_corners_of_the_sql(spark, regrouped, name):
    import duckdb

    df, c = QUERIES[name](spark, regrouped), duckdb.connect()
    c.sql(f"create view events as select * from '{regrouped}/events.parquet'")
    cols = sorted(df.columns)
    want = sorted(c.sql(ORACLE[name]).select(*[f'"{x}"' for x in cols]).fetchall(), key=str)
    assert want and rows(df, *cols) == want


@pytest.fixture(scope="module")
def lengthened(tmp_path_factory):
    """Four recordings of sf0.1 with all events six times, so that speeds stay for six samples and recordings are six times as long."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("lengthened"))
    source = "read_parquet('/root/testdata/sf0.1/events.parquet')"
    duckdb.sql(f"select * exclude k replace (event_id + 100000 * k as event_id) from {source}, range(0, 6) r(k) where user_id // 25 in (0, 1, 20, 51)").write_parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["brake_events_merged", "brake_points", "corner_bests", "corner_deltas", "corner_deltas_reference", "corner_detect", "corner_markers", "corner_projection", "corner_projection_drifted", "corner_report", "corner_spreads", "corner_stats"])
def test_long_recordings_have_the_corners_of_the_sql(spark, lengthened, name):
    import duckdb

    df, c = QUERIES[name](spark, lengthened), duckdb.connect()
    c.sql(f"create view events as select * from '{lengthened}/events.parquet'")
    cols = sorted(df.columns)
    want = sorted(c.sql(ORACLE[name]).select(*[f'"{x}"' for x in cols]).fetchall(), key=str)
    assert want and rows(df, *cols) == want
