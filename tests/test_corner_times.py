"""Corners' ends and times on laps whose odometers drifted; brake events and reasons against plain loops."""

import math
import random

import pytest

from apexline.operators import coaching, corners, driving, projection

SAMPLES = "rec long, lap_id long, t double, elapsed double, dist double, v double, x double, y double"
WINDOW = "rec long, lap_id long, cid int, enter double, exit double, total double"


def stadium(lap, odometer=lambda s: s, v=20.0, straight=200.0, radius=30.0, ds=1.5):
    arc = math.pi * radius
    total = 2 * straight + 2 * arc
    n = int(total / ds)
    out = []
    for k in range(n + 1):
        s = total * k / n
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
        out.append((0, lap, 100.0 * lap + s / v, s / v, odometer(s), v, x, y))
    return out


def test_a_stretched_lap_gets_the_right_corner_times(spark):
    """A lap's odometer runs unevenly by up to two percent: scaled ends would be off by metres, ends by place aren't."""
    arc = math.pi * 30
    slip = lambda s: s * 1.02 + 4 * (1 - math.cos(2 * math.pi * s / (400 + 2 * arc)))
    even = lambda s: s * 1.003
    facts = spark.createDataFrame(stadium(0) + stadium(1, slip) + stadium(2, even), SAMPLES)
    found = spark.createDataFrame([(0, 1, 200.0, 200.0 + arc), (0, 2, 400.0 + arc, 400.0 + 2 * arc)], "rec long, cid int, enter double, exit double")
    best, lengths = spark.createDataFrame([(0, 0)], "rec long, lap_id long"), spark.createDataFrame([(0, 400.0 + 2 * arc)], "rec long, length double")
    windows = projection.windows(found, facts, best, lengths)
    got = {(r.lap_id, r.cid): (r.enter, r.exit) for r in windows.collect()}
    for lap, odometer in ((0, lambda s: s), (1, slip), (2, even)):
        assert got[lap, 1] == pytest.approx((odometer(200.0), odometer(200.0 + arc)), abs=0.05)
        assert got[lap, 2] == pytest.approx((odometer(400.0 + arc), odometer(400.0 + 2 * arc)), abs=0.05)
    times = {(r.lap_id, r.cid): r.time_s for r in corners.stats(facts, windows).collect()}
    assert all(t == pytest.approx(arc / 20.0, abs=0.01) for t in times.values()) and len(times) == 6
    assert abs((200.0 + arc) * 1.02 - slip(200.0 + arc)) > 3  # what scaling would have given
    parts = corners.segments(facts, windows).groupBy("lap_id").sum("time_s").collect()
    assert all(r[1] == pytest.approx((400 + 2 * arc) / 20.0, abs=1e-3) for r in parts)
    phases = corners.phases(facts, windows).where("lap_id = 1").collect()
    assert len(phases) == 6 and all(r.time_s == pytest.approx(slip(300.0) * 0 + arc / 60.0, rel=0.06) for r in phases)


def test_an_end_without_a_place_nearby_is_scaled(spark):
    """A drifted lap that was driven ten metres beside the best one."""
    off = [(r, lap, t, e, d * 1.02, v, x, y + 10 if y < 30 else y - 10) for r, lap, t, e, d, v, x, y in stadium(1)]
    facts = spark.createDataFrame(stadium(0) + off, SAMPLES)
    found = spark.createDataFrame([(0, 1, 50.0, 120.0)], "rec long, cid int, enter double, exit double")
    total = 400 + 60 * math.pi
    got = projection.projected(found, facts, spark.createDataFrame([(0, 0)], "rec long, lap_id long"), spark.createDataFrame([(0, total)], "rec long, length double"))
    assert sorted(r.dist for r in got.where("lap_id = 1").collect()) == pytest.approx([50 * 1.02, 120 * 1.02])


# Brake events


def plain_events(parts, windows):
    """Fragments (d0, t0, d1, t1, peak, between) of a lap fused one after the other."""
    inside = lambda d: next((c for c, a, b in windows if max(a - 40, 0) <= d <= b), None)
    groups = []
    for d0, t0, d1, t1, peak, between in parts:
        lasting = t1 - t0 >= 0.25
        if groups:
            g = groups[-1]
            a, b = inside(g["d0"]), inside(d0)
            if not (between > 0.5 or d0 - g["d1"] > 25 or (a is not None and b is not None and a != b)):
                if not g["settled"] and lasting:
                    g["d0"], g["t0"], g["settled"] = d0, t0, True
                g["d1"], g["t1"], g["peak"], g["n"] = d1, t1, max(g["peak"], peak), g["n"] + 1
                continue
        groups.append({"d0": d0, "t0": t0, "d1": d1, "t1": t1, "peak": peak, "settled": lasting, "n": 1})
    return [(g["d0"], g["t0"], g["d1"], g["t1"], g["peak"], g["n"]) for g in groups if g["t1"] - g["t0"] >= 0.25]


def test_brake_events_against_plain_loops(spark):
    r = random.Random(7)
    rows, spans, want = [], [], []
    for lap in range(60):
        d = t = 0.0
        parts = []
        for k in range(r.randrange(12)):
            d0, t0 = d + r.choice([2, 10, 24, 25, 26, 60]), t + r.uniform(0.1, 2)
            t1 = t0 + r.choice([0.0, 0.1, 0.2, 0.25, 0.3, 1.0])
            d1 = d0 + 15 * (t1 - t0)
            between = r.choice([0.0, 0.3, 0.5, 0.51])
            parts.append((d0, t0, d1, t1, r.random(), between))
            rows.append((0, lap, k + 1, d0, t0, d1, t1, parts[-1][4], between if k else None))
            d, t = d1, t1
        cut = sorted(r.uniform(0, 300) for _ in range(6))
        windows = [(c + 1, cut[2 * c], cut[2 * c + 1]) for c in range(3)]
        spans += [(0, lap, c, a, b, 400.0) for c, a, b in windows]
        want += [(lap, *e) for e in plain_events(parts, windows)]
    f = spark.createDataFrame(rows, "rec long, lap_id long, k long, d0 double, t0 double, d1 double, t1 double, peak_g double, between double")
    got = driving.brake_events(f, spark.createDataFrame(spans, WINDOW)).orderBy("lap_id", "t0").collect()
    assert len(got) == len(want) > 50
    assert [(e.lap_id, e.d0, e.t0, e.d1, e.t1, e.peak_g, e.fragments) for e in got] == [pytest.approx(w) for w in sorted(want, key=lambda w: (w[0], w[2]))]
    assert driving.brake_events(f.where("false")).count() == 0


def test_two_short_fragments_are_one_event_of_the_whole_span(spark):
    f = spark.createDataFrame([(0, 0, 1, 100.0, 5.0, 102.0, 5.1, 0.3, None), (0, 0, 2, 108.0, 5.4, 110.0, 5.5, 0.4, 0.0)], "rec long, lap_id long, k long, d0 double, t0 double, d1 double, t1 double, peak_g double, between double")
    e = driving.brake_events(f).collect()
    assert len(e) == 1 and (e[0].t0, e[0].fragments, e[0].peak_g) == (5.0, 2, 0.4) and e[0].seconds == pytest.approx(0.5)


def test_fragments_need_the_entry_level_and_last_to_the_release(spark):
    """0.2 g is the entry level, so 0.07 g the release: a dip to 0.15 alone is none, one with 0.25 in it is as long as it stays above 0.07."""
    g = [0.0, -0.15, -0.15, 0.0, -0.1, -0.25, -0.08, -0.05, 0.6, -0.3, 0.0]
    rows = [(0, 0, i, float(i), float(i), -x * 0 + x, x) for i, x in enumerate(g)]
    s = spark.createDataFrame(rows, "rec long, lap_id long, i int, dist double, elapsed double, long_g double, gate double")
    got = driving.fragments(s, spark.createDataFrame([(0, 0.2)], "rec long, theta double")).orderBy("k").collect()
    assert [(f.k, f.d0, f.d1, f.peak_g, f.between) for f in got] == [(1, 4.0, 6.0, 0.25, None), (2, 9.0, 9.0, 0.3, 0.6)]


# Reasons


@pytest.mark.parametrize(("facts", "want"), [
    ((5.0, 0.0, 0.0, 0.0), "apex"), ((0.0, 0.2, 0.0, 0.0), "brake"), ((0.0, 0.0, 0.2, 0.0), "coast"), ((0.0, 0.0, 0.0, 0.1), "line"),
    ((3.0, 0.30, 0.30, 0.15), "apex"), ((0.0, 0.30, 0.30, 0.15), "brake"), ((0.0, 0.0, 0.30, 0.15), "coast"), ((1.0, 0.31, 0.0, 0.0), "brake"), ((0.0, 0.0, 0.0, 0.0), "none"), ((1.0, 0.0, 0.0, 0.5), "line"),
])
def test_the_strongest_evidence_is_the_reason(spark, facts, want):
    """Each is half as strong as can be at its own half; equal ones go by priority; nothing explains a corner without loss."""
    d = spark.createDataFrame([(0.2, *facts), (0.0, *facts)], "loss double, apex double, brake double, coast double, line double")
    got = d.select(coaching.reason(d.loss).alias("r")).collect()
    assert got[0].r.reason == want and got[1].r.reason == "none"
    halves = [3.0, 0.3, 0.3, 0.15]
    assert got[0].r.strength == pytest.approx(max(e / (e + h) for e, h in zip(facts, halves, strict=True)))


@pytest.mark.parametrize(("why", "parts", "want"), [("brake", (0.3, 0.1, 0.0), ", mostly at entry"), ("brake", (0.0, 0.1, 0.3), "; it lasts to exit"), ("coast", (0.0, 0.3, 0.1), ", mostly at the apex"), ("line", (0.1, 0.1, 0.1), ""), ("apex", (-0.2, 0.1, 0.0), "")])
def test_a_phase_is_named_only_if_it_holds_most_of_the_loss(spark, why, parts, want):
    d = spark.createDataFrame([(why, *parts)], "why string, entry_s double, apex_s double, exit_s double")
    assert d.select(coaching.clause(d.why)).first()[0] == want


def test_coasts_count_by_overlap_and_brakes_by_their_begin(spark):
    windows = spark.createDataFrame([(0, 0, 1, 100.0, 150.0, 400.0)], WINDOW)
    kind = "rec long, lap_id long, d0 double, d1 double, seconds double"
    events = spark.createDataFrame([(0, 0, 69.0, 90.0, 1.0), (0, 0, 70.0, 90.0, 2.0), (0, 0, 150.0, 160.0, 4.0), (0, 0, 151.0, 160.0, 8.0)], kind)
    assert coaching.braked(events, windows).first().brake == 6.0
    spans = spark.createDataFrame([(0, 0, 80.0, 99.0, 1.0), (0, 0, 80.0, 100.0, 2.0), (0, 0, 150.0, 190.0, 4.0), (0, 0, 151.0, 190.0, 8.0)], kind)
    assert coaching.coasted(spans, windows).first().coast == 6.0
