"""Gaps of laps, filled from other laps, against a plain version and circuits with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from apexline.operators import gapfill

SAMPLES = "rec long, lap_id long, t double, dist double, x double, y double"
POINTS = "rec long, lap_id long, i int, t double, x double, y double, s double"


def circle(lap, gone=(), radius=50.0, n=120, step=0.1):
    """A lap of a circle, a fix each 0.1 s, without those at ``gone``."""
    out = []
    for k in range(n):
        if k not in gone:
            a = 2 * math.pi * k / n
            out.append((0, lap, 1000.0 * lap + k * step, radius * a, radius * math.cos(a), radius * math.sin(a)))
    return out


def plain(laps, lap, reference=()):
    """The gaps of a lap and what fills them, one after the other: (i, source, donor, points)."""
    own = laps[lap]
    if len(own) < 3:
        return []
    steps = sorted(b[0] - a[0] for a, b in zip(own, own[1:], strict=False) if 0 < b[0] - a[0] <= 0.35)
    k = len(steps)
    usual = max((steps[k // 2] + steps[(k - 1) // 2]) / 2 if k else 0.1, 1e-3)
    out = []
    for i, (p, q) in enumerate(zip(own, own[1:], strict=False)):
        dt = q[0] - p[0]
        if dt <= 0.35:
            continue
        missing, a, b = max(round(dt / usual) - 1, 1), p[1:], q[1:]
        chord, best = math.dist(a, b), None
        for ref, donor, line in [*((False, d, [x[1:] for x in v]) for d, v in sorted(laps.items()) if d != lap), *([(True, -1, list(reference))] if reference else [])]:
            if missing <= 3 or len(line) < 3:
                continue
            ka, kb = (min(range(len(line)), key=lambda j: (math.dist(line[j], m) ** 2, j)) for m in (a, b))
            error = max(math.dist(line[ka], a), math.dist(line[kb], b))
            way = line[min(ka, kb) : max(ka, kb) + 1]
            length = sum(math.dist(u, v) for u, v in zip(way, way[1:], strict=False))
            if ka == kb or error > max(0.25 * chord, 5.0) or not 0.4 <= length / max(chord, 1e-6) <= 3.0:
                continue
            if best is None or (ref, round(error, 9)) < best[0]:
                best = ((ref, round(error, 9)), donor, way if ka < kb else way[::-1])
        if best:
            (ref, _), donor, way = best
            z = [complex(*w) for w in way]
            turn = (complex(*b) - complex(*a)) / (z[-1] - z[0])
            line = [complex(*a) + turn * (w - z[0]) for w in z]
            out.append((i, "reference" if ref else "borrowed", None if ref else donor, [(w.real, w.imag) for w in line[1:-1]]))
        else:
            p0, p3 = own[max(i - 1, 0)][1:], own[min(i + 2, len(own) - 1)][1:]
            cubic = lambda c, f: 0.5 * (2 * a[c] + (b[c] - p0[c]) * f + (2 * p0[c] - 5 * a[c] + 4 * b[c] - p3[c]) * f**2 + (3 * a[c] - p0[c] - 3 * b[c] + p3[c]) * f**3)
            out.append((i, "curve" if missing <= 3 else "uncovered", None, [(cubic(0, j / (missing + 1)), cubic(1, j / (missing + 1))) for j in range(1, missing + 1)]))
    return out


def test_a_gap_follows_the_lap_that_has_been_there(spark):
    """A quarter of a circle is missing on a lap; another lap, a little wider, has it: the fill is round, not a chord."""
    gone = range(20, 50)
    rows = circle(0, gone) + circle(1, radius=51.0)
    points = gapfill.numbered(spark.createDataFrame(rows, SAMPLES))
    fill = gapfill.filled(points).where("lap_id = 0")
    got = fill.orderBy("j").collect()
    assert {r.source for r in got} == {"borrowed"} and {r.donor for r in got} == {1}
    assert max(abs(math.hypot(r.x, r.y) - 50.0) for r in got) < 1e-6
    # Its ends are the mouths, and times go on between theirs.
    assert (got[0].x, got[0].y) == pytest.approx(rows[19][4:]) and (got[-1].x, got[-1].y) == pytest.approx(rows[20][4:])
    assert got[0].t == pytest.approx(1.9) and got[-1].t == pytest.approx(5.0)
    r = gapfill.report(points, gapfill.filled(points)).first()
    assert (r.missing, r.source, r.donor) == (30, "borrowed", 1) and r.fill_m == pytest.approx(50 * 2 * math.pi * 31 / 120, rel=1e-3)
    assert r.error_m == pytest.approx(1.0, abs=1e-6)
    drawn = gapfill.drawn(points, gapfill.filled(points)).where("lap_id = 0")
    assert drawn.where("source = 'measured'").count() == 90 and drawn.count() == 90 + len(got) - 2


def test_a_lap_driven_the_other_way_is_turned_round(spark):
    back = [(0, 1, 2000.0 + i * 0.1, d, x, y) for i, (_, _, _, d, x, y) in enumerate(reversed(circle(1)))]
    points = gapfill.numbered(spark.createDataFrame(circle(0, range(20, 50)) + back, SAMPLES))
    got = gapfill.filled(points).where("lap_id = 0").orderBy("j").collect()
    assert got[0].source == "borrowed" and max(abs(math.hypot(r.x, r.y) - 50.0) for r in got) < 1e-6


def test_the_reference_is_taken_only_where_no_lap_covers_the_gap(spark):
    line = [(0, k, 50.5 * math.cos(2 * math.pi * k / 60), 50.5 * math.sin(2 * math.pi * k / 60)) for k in range(60)]
    ref = spark.createDataFrame(line, "rec long, k int, x double, y double")
    hole, far = range(20, 50), circle(1, range(0, 75))
    points = gapfill.numbered(spark.createDataFrame(circle(0, hole) + far, SAMPLES))
    assert {r.source for r in gapfill.filled(points, ref).where("lap_id = 0").collect()} == {"reference"}
    assert {r.source for r in gapfill.filled(points).where("lap_id = 0").collect()} == {"uncovered"}
    both = gapfill.numbered(spark.createDataFrame(circle(0, hole) + circle(1, radius=52.0), SAMPLES))
    assert {r.source for r in gapfill.filled(both, ref).where("lap_id = 0").collect()} == {"borrowed"}


def test_odd_laps(spark):
    """Two samples, one place for all, no gap, no lap."""
    rows = [(0, 0, 0.0, 0.0, 1.0, 1.0), (0, 0, 9.0, 1.0, 2.0, 2.0)] + [(0, 1, k * 1.0, 0.0, 5.0, 5.0) for k in range(5)] + circle(2)
    points = gapfill.numbered(spark.createDataFrame(rows, SAMPLES))
    got = gapfill.filled(points)
    assert {r.lap_id for r in got.collect()} == {1} and got.where("not (x = 5 and y = 5)").count() == 0
    nothing = spark.createDataFrame([], POINTS)
    assert gapfill.filled(nothing).count() == 0 and gapfill.drawn(nothing, gapfill.filled(nothing)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_loops(spark, seed):
    r = random.Random(seed)
    laps = {}
    for lap in range(7):
        radius, dx = r.uniform(45, 60), r.uniform(-4, 4)
        start, size = r.randrange(100), r.randrange(0, 30)
        few = r.randrange(110)
        gone = {*range(start, start + size), *range(few, few + 3), *r.sample(range(120), r.randrange(6))}
        laps[lap] = [(t, x + dx + r.gauss(0, 0.3), y + r.gauss(0, 0.3)) for _, _, t, _, x, y in circle(lap, gone, radius)]
    line = [(52 * math.cos(k / 10), 52 * math.sin(k / 10)) for k in range(63)]
    rows = [(0, lap, t, float(k), x, y) for lap, v in laps.items() for k, (t, x, y) in enumerate(v)]
    points = gapfill.numbered(spark.createDataFrame(rows, SAMPLES))
    ref = spark.createDataFrame([(0, k, x, y) for k, (x, y) in enumerate(line)], "rec long, k int, x double, y double")
    got: dict = {}
    for f in gapfill.filled(points, ref).where("j > 0 and j < n").orderBy("lap_id", "i", "j").collect():
        got.setdefault((f.lap_id, f.i, f.source, f.donor), []).append((f.x, f.y))
    want = {(lap, i, source, donor): p for lap in laps for i, source, donor, p in plain(laps, lap, line) if p}
    assert got.keys() == want.keys() and {k[2] for k in want} >= {"borrowed", "curve"}
    assert all(g == pytest.approx(w, abs=1e-6) for k in want for g, w in zip(got[k], want[k], strict=True))
    assert gapfill.totals(gapfill.report(points, gapfill.filled(points, ref))).agg(F.sum("gaps")).first()[0] == gapfill.gaps(points).count()
