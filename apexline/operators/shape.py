"""The shape of a circuit: fits between loops, gaps filled, hulls, polylines for maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CONFIG
from .house import along, interp_join, runs, united

REC = ["rec"]
#: Points of a loop, and missing fixes up to which a gap is a plain curve.
LOOP, PLAIN = 512, 3


def arc_length(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``points`` with ``s``: the length of the line up to each."""
    w = along(keys, order)
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    return points.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def loop(points: DataFrame, keys: list[str], order: str, n: int = LOOP) -> DataFrame:
    """(keys, i, x, y): ``n`` points of even spacing on the closed line."""
    first = points.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), order).alias("p"), F.max(order).alias("_o"))
    closed = united(points.select(*keys, F.col(order).cast("double").alias("_o"), "x", "y"), first.select(*keys, (F.col("_o") + 1).cast("double").alias("_o"), "p.x", "p.y"))
    line = arc_length(closed, keys, "_o")
    total = line.groupBy(*keys).agg(F.max("s").alias("_t")).where("_t > 0")
    grid = total.select(*keys, (F.col("_t") / n).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(*keys, (F.col("_q") * F.col("i")).alias("s"), "i")
    return interp_join(line, grid, keys, "s", ["x", "y"]).select(*keys, "i", "x", "y")


def resampled(points: DataFrame, keys: list[str], order: str, n: int = 400) -> DataFrame:
    """(keys, i, s, x, y): ``n`` points of even spacing on an open line, its ends among them; a line without length stays at its place."""
    line = arc_length(points, keys, order)
    total = line.groupBy(*keys).agg(F.max("s").alias("_t"))
    grid = total.select(*keys, "_t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(*keys, (F.col("_t") * F.col("i") / (n - 1)).alias("s"), "i")
    return interp_join(line, grid, keys, "s", ["x", "y"]).select(*keys, "i", "s", "x", "y")


def rings(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, px, py): the loops (keys, i, x, y) as two short arrays in order of i."""
    return points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("_p")).select(*keys, F.col("_p.x").alias("px"), F.col("_p.y").alias("py"))


def with_reference(own: DataFrame, reference: DataFrame) -> DataFrame:
    """``own`` and the reference's arrays (qx, qy) beside each row; it is one loop of a fixed number of points, so it may be broadcast."""
    one = rings(reference.withColumn("_one", F.lit(1)), "_one").select(F.col("px").alias("qx"), F.col("py").alias("qy"))
    return own.crossJoin(F.broadcast(one))


def similarities(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> tuple | None:
    """(shift, way, scale, turn, mirror, dx, dy, rms) of the best of all starts and both ways round; None for a loop without extent.

    A similarity's best fit has a closed form in means of products.  Those of one loop alone are the same for
    all tries, and those of both are taken with all shifted copies of the reference at once.
    """
    n = len(px)
    at = np.arange(n)
    mx, my, mu, mv = px.mean(), py.mean(), qx.mean(), qy.mean()
    spread, aim = np.mean(px * px) - mx * mx + np.mean(py * py) - my * my, np.mean(qx * qx) - mu * mu + np.mean(qy * qy) - mv * mv
    if not spread > 0:
        return None
    tries = []
    for way in (1, -1):
        i = (way * at + at[:, None]) % n
        u, v = qx[i], qy[i]
        xu, xv, yu, yv = u @ px / n - mx * mu, v @ px / n - mx * mv, u @ py / n - my * mu, v @ py / n - my * mv
        for hand in (1.0, -1.0):
            c, s = xu + hand * yv, xv - hand * yu
            size = np.sqrt(c * c + s * s)
            left = np.sqrt(np.maximum(aim - size * size / spread, 0.0))
            k = int(np.argmin(left))
            tries.append((float(left[k]), k, way, hand < 0, float(size[k] / spread), float(np.arctan2(s[k], c[k])), hand))
    rms, shift, way, mirror, scale, turn, hand = min(tries)
    dx = mu - scale * (np.cos(turn) * mx - np.sin(turn) * hand * my)
    dy = mv - scale * (np.sin(turn) * mx + np.cos(turn) * hand * my)
    return shift, way, scale, turn, mirror, float(dx), float(dy), rms


def fit_loops(loops: DataFrame, reference: DataFrame, n: int = LOOP) -> DataFrame:
    """(rec, shift, way, scale, turn, mirror, dx, dy, rms): the similarity that lays each loop (rec, i, x, y) on ``reference`` (i, x, y).

    Every start point, both ways round and both hands are tried.  A recording is one row of two short arrays,
    so what is shuffled is the loops' points, once; the tries are made where the row is.
    ``reference`` is one loop of ``n`` points; a loop of another number has no fit.
    """
    rows = with_reference(rings(loops, "rec"), reference).where((F.size("px") == n) & (F.size("qx") == n))
    kind = loops.schema["rec"].dataType.simpleString()
    names = ["rec", "shift", "way", "scale", "turn", "mirror", "dx", "dy", "rms"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [(r.rec, similarities(*(np.asarray(a, float) for a in (r.px, r.py, r.qx, r.qy)))) for r in batch.itertuples(index=False)]
            yield pd.DataFrame([(rec, *fit) for rec, fit in fits if fit], columns=names)

    return rows.mapInPandas(run, f"rec {kind}, shift int, way int, scale double, turn double, mirror boolean, dx double, dy double, rms double")


def laid(points: DataFrame, fits: DataFrame) -> DataFrame:
    """``points`` (rec, x, y) moved by their recording's fit."""
    hand = F.when(F.col("mirror"), -1.0).otherwise(1.0)
    p = points.join(fits.select("rec", "scale", "turn", "mirror", "dx", "dy"), REC)
    x = F.col("scale") * (F.cos("turn") * F.col("x") - F.sin("turn") * hand * F.col("y")) + F.col("dx")
    y = F.col("scale") * (F.sin("turn") * F.col("x") + F.cos("turn") * hand * F.col("y")) + F.col("dy")
    return p.withColumns({"x": x, "y": y}).select(*points.columns)


def hermite(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """The uniform cubic through p1 and p2 whose slopes there are half of those between their neighbours."""
    return p1 + t * ((p2 - p0) / 2 + t * ((p0 - p2) + (p2 - p1) * 3 - (p3 - p1) / 2 + t * ((p1 - p2) * 2 + (p2 - p0) / 2 + (p3 - p1) / 2)))


def filled(trace: DataFrame) -> DataFrame:
    """(rec, seq, j, t, x, y, measured, fill): a trace with its gaps drawn.

    Gaps are cubics through their mouths; those of more than PLAIN fixes are
    marked.  ``gapfill`` draws these as other laps of the recording went.
    """
    w = along(REC, "seq")
    cols = ["x", "y"]
    s = trace.withColumns({"dt": F.col("t") - F.lag("t").over(w), "_t0": F.lag("t").over(w), "_o0": F.lag("odo").over(w), **{f"_{c}{k}": F.lag(c, 2 - k).over(w) for c in cols for k in (0, 1)}, **{f"_{c}3": F.lead(c).over(w) for c in cols}})
    usual = s.where("dt > 0 and dt < 1").groupBy(*REC).agg(F.median("dt").alias("_u"))
    gaps = s.where(F.col("dt") > CONFIG.dropout_s).join(usual, REC).withColumn("missing", F.greatest(F.bround(F.col("dt") / F.col("_u")) - 1, F.lit(1.0)).cast("int"))
    steps = gaps.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("missing")))).withColumn("_r", F.col("j") / (F.col("missing") + 1))
    curve = {f"_c{c}": hermite(F.coalesce(f"_{c}0", f"_{c}1"), F.col(f"_{c}1"), F.col(c), F.coalesce(f"_{c}3", c), F.col("_r")) for c in cols}
    steps = steps.withColumns({**curve, "odo": F.col("_o0") + (F.col("odo") - F.col("_o0")) * F.col("_r"), "t": F.col("_t0") + F.col("dt") * F.col("_r")})
    measured = trace.select("rec", "seq", F.lit(0).alias("j"), "t", "x", "y", F.lit(True).alias("measured"), F.lit("gps").alias("fill"))
    short = F.col("missing") <= PLAIN
    return united(measured, steps.select("rec", "seq", "j", "t", F.col("_cx").alias("x"), F.col("_cy").alias("y"), F.lit(False).alias("measured"), F.when(short, "curve").otherwise("long curve").alias("fill")))


#: Parts of a recording whose hulls are made before they are joined, and directions whose farthest points bound what can be a corner.
PARTS, DIRECTIONS = 32, 16


def hull_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the convex hull, counter-clockwise from the leftmost (the lowest of these); points on an edge are none.

    Points inside the polygon of the farthest points in a few directions can't be
    corners and are left out first; the rest are walked once from left to right and back.
    """
    keep = np.isfinite(x) & np.isfinite(y)
    x, y = x[keep], y[keep]
    if len(x) > 4 * DIRECTIONS:
        turns = 2 * np.pi * np.arange(DIRECTIONS) / DIRECTIONS
        far = np.array([np.argmax(x * np.cos(a) + y * np.sin(a)) for a in turns])
        far = far[np.append(True, (x[far][1:] != x[far][:-1]) | (y[far][1:] != y[far][:-1]))]
        px, py = x[far], y[far]
        left = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for ax, ay, bx, by in zip(px, py, np.roll(px, -1), np.roll(py, -1), strict=True) if (ax, ay) != (bx, by)]
        # Rounding may call a point on an edge inside: only what is clearly inside goes.
        slack = 1e-9 * max(np.ptp(x), np.ptp(y), 1e-300) ** 2
        outside = np.min(left, axis=0) <= slack if len(left) > 2 else np.ones(len(x), bool)
        x, y = x[outside], y[outside]
    points = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(points) < 3:
        return np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    sides = []
    for way in (points, points[::-1]):
        side: list[tuple[float, float]] = []
        for c in way:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (c[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (c[0] - side[-2][0]):
                side.pop()
            side.append(c)
        sides += side[:-1]
    return np.array([p[0] for p in sides]), np.array([p[1] for p in sides])


def hull(points: DataFrame) -> DataFrame:
    """(rec, i, x, y): corners of each recording's convex hull, counter-clockwise from its leftmost point.

    The hull of hulls is the hull, so every batch sends its corners only, they are
    joined in PARTS parts of a recording, and then to one.  Points with a null or NaN are left out.
    """
    kind = points.schema["rec"].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rec, part in batch.groupby("rec", sort=False, dropna=False):
                x, y = hull_of(part["x"].to_numpy(float), part["y"].to_numpy(float))
                yield pd.DataFrame({"rec": pd.Series([rec] * len(x), dtype=batch["rec"].dtype), "x": x, "y": y})

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        x, y = hull_of(part["x"].to_numpy(float), part["y"].to_numpy(float))
        return pd.DataFrame({"rec": pd.Series([part["rec"].iloc[0]] * len(x), dtype=part["rec"].dtype), "i": np.arange(len(x), dtype=np.int32), "x": x, "y": y})

    few = points.where("rec is not null and x is not null and y is not null").select("rec", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(partial, f"rec {kind}, x double, y double")
    parts = few.groupBy("rec", F.pmod(F.xxhash64("x", "y"), F.lit(PARTS)).alias("part")).applyInPandas(joined, f"rec {kind}, i int, x double, y double")
    return parts.groupBy("rec").applyInPandas(joined, f"rec {kind}, i int, x double, y double")


def to_ring(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, x, y) of the place of the closed line ``q`` that is nearest to each point ``p``."""
    ex, ey = np.roll(qx, -1) - qx, np.roll(qy, -1) - qy
    along_ = ((px[:, None] - qx) * ex + (py[:, None] - qy) * ey) / np.maximum(ex * ex + ey * ey, 1e-12)
    share = np.clip(along_, 0.0, 1.0)
    fx, fy = qx + share * ex, qy + share * ey
    far = np.hypot(px[:, None] - fx, py[:, None] - fy)
    rows, best = np.arange(len(px)), np.argmin(far, axis=1)
    return far[rows, best], fx[rows, best], fy[rows, best]


def refine(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, fit: tuple[float, float, bool, float, float], rounds: int, near_m: float) -> tuple[tuple, float, float, int]:
    """(fit, rms, coverage, round): a similarity (scale, turn, mirror, dx, dy) that lays ``p`` on the ring ``q``, bettered.

    Each round fits the points to their nearest places on the ring, in closed form.  The
    best of all rounds by the points' distances to the ring counts; round 0 is the fit as given.
    """
    p = px + 1j * py

    def laid(scale, turn, mirror, dx, dy):
        return scale * np.exp(1j * turn) * (np.conj(p) if mirror else p) + dx + 1j * dy

    best, now = None, fit
    for n in range(rounds + 1):
        at = laid(*now)
        far, fx, fy = to_ring(at.real, at.imag, qx, qy)
        rms = float(np.sqrt(np.mean(far * far)))
        if best is None or rms < best[1]:
            best = (now, rms, float(np.mean(far <= near_m)), n)
        own, aim = np.conj(p) if now[2] else p, fx + 1j * fy
        own_mean, aim_mean = own.mean(), aim.mean()
        spread = np.sum(np.abs(own - own_mean) ** 2)
        if not spread:
            break
        turned = np.sum((aim - aim_mean) * np.conj(own - own_mean)) / spread
        shift = aim_mean - turned * own_mean
        now = (float(abs(turned)), float(np.angle(turned)), now[2], float(shift.real), float(shift.imag))
    return best


def refined(loops: DataFrame, reference: DataFrame, fits: DataFrame, rounds: int = 8, near_m: float = 5.0) -> DataFrame:
    """``fits`` of :func:`fit_loops` bettered on the reference's line: (rec, scale, turn, mirror, dx, dy, rms0, rms, coverage, round).

    ``rms`` is of the distances of a loop's points to the nearest place of the reference, a ring;
    it is never above ``rms0``, that of the fit as given.  ``coverage`` is the share within ``near_m``.  A loop has as
    many points as :func:`loop` gives, so a recording is one row of two short arrays.
    """
    rows = with_reference(rings(loops, "rec"), reference).join(fits.select("rec", "scale", "turn", "mirror", "dx", "dy"), "rec")
    kind = loops.schema["rec"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                given = (r.scale, r.turn, r.mirror, r.dx, r.dy)
                arrays = [np.asarray(a, float) for a in (r.px, r.py, r.qx, r.qy)]
                _, rms0, _, _ = refine(*arrays, given, 0, near_m)
                fit, rms, coverage, n = refine(*arrays, given, rounds, near_m)
                out.append((r.rec, *fit, rms0, rms, coverage, n))
            yield pd.DataFrame(out, columns=["rec", "scale", "turn", "mirror", "dx", "dy", "rms0", "rms", "coverage", "round"])

    return rows.mapInPandas(run, f"rec {kind}, scale double, turn double, mirror boolean, dx double, dy double, rms0 double, rms double, coverage double, round int")


def segment_values(points: DataFrame, keys: list[str], order: str, value: str, t: str = "t") -> DataFrame:
    """``points`` with ``segment``: the mean of ``value`` at both ends of the step to each, null at the first and over steps that take too long."""
    w = along(keys, order)
    step = F.col(t) - F.lag(t).over(w)
    return points.withColumn("segment", F.when(step <= CONFIG.dropout_s, (F.col(value) + F.lag(value).over(w)) / 2))


def polylines(bucketed: DataFrame, order: str = "seq") -> DataFrame:
    """(rec, run, bucket, points): unbroken runs of a bucket as lines for a map; nothing is drawn at bucket -1 (unknown)."""
    w = along(REC, order)
    marked = runs(bucketed, REC, order, F.col("bucket") != F.lag("bucket").over(w), "run")
    return marked.where("bucket >= 0").groupBy("rec", "run", "bucket").agg(F.sort_array(F.collect_list(F.struct(order, "x", "y"))).alias("points"))


def jitter(trace: DataFrame) -> DataFrame:
    """(rec, across_m, heading_deg): noise of positions about their smoothed line, and of headings from step to step."""
    w = along(REC, "seq")
    mean = lambda c, n: F.avg(c).over(w.rowsBetween(-(n // 2), n // 2))
    s = trace.withColumns({f"_{c}": F.col(c) - mean(c, 41) for c in ("x", "y")})
    s = s.withColumns({f"_r{c}": F.col(f"_{c}") - mean(f"_{c}", 9) for c in ("x", "y")})
    s = s.withColumn("_a", F.atan2(F.col("y") - F.lag("y").over(w), F.col("x") - F.lag("x").over(w)))
    s = s.withColumn("_t", F.degrees(F.atan2(F.sin(F.col("_a") - F.lag("_a").over(w)), F.cos(F.col("_a") - F.lag("_a").over(w)))))
    s = s.withColumn("_q", F.col("_t") - F.lag("_t").over(w))
    return s.groupBy(*REC).agg(F.sqrt(F.var_pop("_rx") + F.var_pop("_ry")).alias("across_m"), F.stddev_pop("_q").alias("heading_deg"))
