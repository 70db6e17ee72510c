"""Forces from an IMU of known mounting: a drive whose forces are known is recovered."""

import math

import numpy as np
import pytest

from apexline.operators import imu
from apexline.sources.tables import materialised

G = 9.80665


def turned(q, v):
    w, x, y, z = q
    t = 2 * np.cross([x, y, z], v)
    return v + w * t + np.cross([x, y, z], t)


def times(a, b):
    return np.array([a[0] * b[0] - a[1:] @ b[1:], *(a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:]))])


@pytest.mark.parametrize("with_imu", [True, False])
def test_mounting_is_recovered(spark, with_imu):
    """A weaving drive; the camera is turned by 50 and tilted by 10 degrees."""
    gt = np.arange(0, 40, 0.1)
    v = 15 + 4 * np.sin(0.4 * gt)
    psi = 0.6 * np.sin(0.5 * gt)
    x, y = np.cumsum(v * np.cos(psi)) * 0.1, np.cumsum(v * np.sin(psi)) * 0.1
    trace = spark.createDataFrame([(1, i, float(t), float(a), float(b), float(c)) for i, (t, a, b, c) in enumerate(zip(gt, v, x, y, strict=True))], "rec long, seq long, t double, v double, x double, y double")
    half = math.radians(25), math.radians(5)
    to_world = times(np.array([math.cos(half[0]), 0, 0, math.sin(half[0])]), np.array([math.cos(half[1]), 0, math.sin(half[1]), 0]))
    to_camera = to_world * [1, -1, -1, -1]
    t200 = np.arange(0, 40, 0.02)
    rows = []
    for t in t200:
        p, dp = 0.6 * math.sin(0.5 * t), 0.3 * math.cos(0.5 * t)
        s, ds = 15 + 4 * math.sin(0.4 * t), 1.6 * math.cos(0.4 * t)
        world = np.array([ds * math.cos(p) - s * dp * math.sin(p), ds * math.sin(p) + s * dp * math.cos(p), G])
        a, g = turned(to_camera, world), turned(to_camera, np.array([0, 0, 1.0]))
        rows += [(1, "ACCL", float(t), None, *map(float, (a[1], a[0], a[2]))), (1, "GRAV", float(t), None, *map(float, g)), (1, "CORI", float(t), *map(float, to_camera))]
    table = spark.createDataFrame(rows if with_imu else [], "rec long, stream string, t double, w double, x double, y double, z double")
    gps, flat = materialised(imu.gps_g(trace), "gps"), materialised(imu.horizontal(table), "flat")
    fit = materialised(imu.fitted(flat, gps), "fit")
    got = imu.g_series(flat, gps, fit).orderBy("k").toPandas()
    assert len(got) == pytest.approx(39.9 / 0.02, abs=1) and set(got.origin) == {"imu" if with_imu else "gps"}
    inside = got[(got.t > 2) & (got.t < 38)]
    t = inside.t.to_numpy()
    lat = (15 + 4 * np.sin(0.4 * t)) * 0.3 * np.cos(0.5 * t) / G
    assert np.abs(inside.lat_g.to_numpy() - lat).max() < (0.05 if with_imu else 0.12)
    assert np.abs(inside.long_g.to_numpy() - 1.6 * np.cos(0.4 * t) / G).max() < 0.08
    if with_imu:
        f = fit.first()
        assert f.ok and f.r_lat > 0.99 and f.r_long > 0.9


def test_streams_meet_once(spark):
    """The joined streams are read twice, for gravity's mean and for the axes, so they are a table and not made twice."""
    rows = [(1, i / 10, s, w, x, y, z) for i in range(8) for s, w, x, y, z in (("ACCL", None, 1.0, 2.0, 9.8), ("GRAV", None, 0.0, 0.0, 1.0), ("CORI", 1.0, 0.0, 0.0, 0.0))]
    flat = imu.horizontal(spark.createDataFrame(rows, "rec int, t double, stream string, w double, x double, y double, z double"))
    assert "Union" not in flat._jdf.queryExecution().optimizedPlan().toString() and flat.count() == 8
