"""Hulls, loop fits and slopes against brute force."""

import math

import numpy as np
import pytest

from apexline.operators import pace, shape


def corners_of(points):
    """Those points that all others lie within a half-turn of: corners of the hull."""
    points = sorted(set(points))
    if len(points) < 3:
        return set(points)
    out = set()
    for a in points:
        angles = sorted({math.atan2(b[1] - a[1], b[0] - a[0]) for b in points if b != a})
        gaps = [(angles[(k + 1) % len(angles)] - t) % (2 * math.pi) for k, t in enumerate(angles)]
        if len(angles) == 1 or max(gaps) > math.pi + 1e-9:
            out.add(a)
    return out


def test_hull_of_random_points():
    r = np.random.default_rng(0)
    for t in range(200):
        points = [tuple(map(float, p)) for p in r.integers(0, [4, 30, 1000][t % 3], (r.integers(1, 200), 2))]
        x, y = shape.hull_of(*(np.array(c) for c in zip(*points, strict=True)))
        got = list(zip(x.tolist(), y.tolist(), strict=True))
        assert set(got) == corners_of(points) and len(got) == len(set(got)) and got[0] == min(got)
        if len(got) > 2:  # counter-clockwise
            assert sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(got, got[1:] + got[:1], strict=True)) > 0


def test_hulls_of_recordings(spark):
    r = np.random.default_rng(1)
    rows = [(i % 3, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(3000, 2)).round(2))] + [(1, None, 1.0), (1, float("nan"), 0.0), (None, 9.0, 9.0), (7, 1.0, 1.0), (7, 1.0, 1.0), (8, 0.0, 0.0), (8, 1.0, 1.0), (8, 2.0, 2.0)]
    got: dict = {}
    for p in shape.hull(spark.createDataFrame(rows, "rec long, x double, y double").repartition(7)).orderBy("rec", "i").collect():
        got.setdefault(p.rec, []).append((p.x, p.y))
    for rec in (0, 1, 2, 7, 8):
        assert set(got[rec]) == corners_of([(a, b) for k, a, b in rows if k == rec and a is not None and a == a])
    assert set(got) == {0, 1, 2, 7, 8} and shape.hull(spark.createDataFrame([], "rec long, x double, y double")).count() == 0


def test_distances_to_a_ring():
    square = np.array([0.0, 10, 10, 0]), np.array([0.0, 0, 10, 10])
    far, x, y = shape.to_ring(np.array([5.0, 12, 5, 0]), np.array([-3.0, 13, 6, 4]), *square)
    assert far.tolist() == [3.0, math.hypot(2, 3), 4.0, 0.0] and (x[1], y[1]) == (10, 10) and (x[3], y[3]) == (0, 4)


def test_a_shifted_noisy_loop_is_recovered(spark):
    """A bean turned, scaled, mirrored, shifted and begun elsewhere, with noise and bunched points."""
    r = np.random.default_rng(2)

    def bean(a):
        radius = 100 + 30 * np.cos(a) + 15 * np.sin(2 * a)
        return radius * np.cos(a), radius * np.sin(a)

    n = 256
    x, y = bean(np.linspace(0, 2 * np.pi, n, endpoint=False))
    ref = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    px, py = bean(a + 0.5 + 0.2 * np.sin(a))
    own = 0.5 * np.exp(0.7j) * (px - 1j * py) + 20 - 5j + r.normal(0, 0.1, n) + 1j * r.normal(0, 0.1, n)
    loops = spark.createDataFrame([(3, i, float(z.real), float(z.imag)) for i, z in enumerate(own)], "rec long, i int, x double, y double")
    reference = spark.createDataFrame(ref, "i int, x double, y double")
    fits = shape.fit_loops(loops, reference, n)
    few = shape.refined(loops, reference, fits).first()
    got = shape.refined(loops, reference, fits, rounds=60).first()
    assert got.rms <= few.rms <= few.rms0
    assert got.rms <= got.rms0 and got.mirror and got.coverage == 1.0
    assert got.scale == pytest.approx(2.0, rel=0.005) and got.rms < 0.4 < got.rms0
    laid = shape.laid(loops, shape.refined(loops, reference, fits, rounds=60)).collect()
    far, _, _ = shape.to_ring(np.array([p.x for p in laid]), np.array([p.y for p in laid]), x, y)
    assert np.sqrt(np.mean(far**2)) == pytest.approx(got.rms)


def test_median_slope_is_that_of_all_pairs():
    r = np.random.default_rng(0)
    for t in range(150):
        y = r.integers(0, [3, 50, 100_000][t % 3], r.integers(2, 40))
        n = len(y)
        want = np.median([(y[j] - y[i]) / (j - i) for i in range(n) for j in range(i + 1, n)])
        assert pace.median_slope(y) == pytest.approx(want, abs=1e-12)
    assert pace.median_slope(np.array([10**15, 10**15 + 7, 5])) == pytest.approx(np.median([7, 5 - 10**15 - 7, (5 - 10**15) / 2]))


def test_theil_sen_of_many_laps(spark):
    r = np.random.default_rng(3)
    y = 60 + 0.002 * np.arange(20_000) + r.normal(0, 0.5, 20_000)
    rows = [(1, i, float(v)) for i, v in enumerate(y)] + [(2, i, 60.0) for i in range(5)] + [(3, i, None if i == 2 else 60.0 + i) for i in range(8)]
    got = {g.rec: (g.n, g.slope) for g in pace.theil_sen(spark.createDataFrame(rows, "rec long, lap_id long, lap_s double")).collect()}
    assert got[1] == (20_000, 0.002) and got[2] == (5, None) and got[3] == (7, 1.0)


def test_offset_of_laps_that_are_all_alike(spark):
    """Times without spread have no correlation: such a list has no offset, and others keep theirs."""
    alike = [(1, i, 60.0) for i in range(12)]
    varied = [(2, i, 60.0 + (i * i * 7 % 11) / 10) for i in range(12)]
    measured = spark.createDataFrame(alike + varied, "rec long, lap_id long, lap_s double")
    listed = spark.createDataFrame([(r, i + 3, s) for r, i, s in alike + varied], "rec long, lap_no long, ref_s double")
    got = pace.offset(measured, listed, 6).collect()
    assert [(r.rec, r.shift, round(r.r, 9)) for r in got] == [(2, 3, 1.0)]


def test_loop_fits_are_those_of_every_try(spark):
    """Against least squares for each start, way and hand; points aren't multiplied by tries in Spark, and a loop without extent has no fit."""
    r = np.random.default_rng(5)
    n = 12
    q = r.normal(size=n) + 1j * r.normal(size=n)
    own = {rec: r.normal(size=n) + 1j * r.normal(size=n) for rec in range(4)} | {9: np.full(n, 1 + 1j)}
    loops = spark.createDataFrame([(rec, i, float(z.real), float(z.imag)) for rec, p in own.items() for i, z in enumerate(p)], "rec long, i int, x double, y double")
    fits = shape.fit_loops(loops, spark.createDataFrame([(i, float(z.real), float(z.imag)) for i, z in enumerate(q)], "i int, x double, y double"), n)
    assert "Generate" not in fits._jdf.queryExecution().optimizedPlan().toString()
    got = {f.rec: f for f in fits.collect()}
    assert set(got) == {0, 1, 2, 3}
    for rec, f in got.items():
        tries = []
        for shift in range(n):
            for way in (1, -1):
                aim = q[(way * np.arange(n) + shift) % n]
                for mirror in (False, True):
                    p = np.conj(own[rec]) if mirror else own[rec]
                    a = np.stack([p, np.ones(n)], axis=1)
                    left = aim - a @ np.linalg.lstsq(a, aim, rcond=None)[0]
                    tries.append((np.sqrt(np.mean(np.abs(left) ** 2)), shift, way, mirror))
        rms, *what = min(tries)
        assert [f.shift, f.way, f.mirror] == what and f.rms == pytest.approx(rms)
        p = np.conj(own[rec]) if f.mirror else own[rec]
        laid = f.scale * np.exp(1j * f.turn) * p + f.dx + 1j * f.dy
        assert np.sqrt(np.mean(np.abs(laid - q[(f.way * np.arange(n) + f.shift) % n]) ** 2)) == pytest.approx(rms)
