"""Braking, coasting and grip, from a trace with ``long_g`` (and ``lat_g`` where an IMU gives it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CONFIG
from ..functions.scalars import buckets, rounded
from .house import along, boxcar, boxcar_by, interp_join, islands, runs
from .trace import long_g

REC, LAP = ["rec"], ["rec", "lap_id"]


def brake_threshold(trace: DataFrame) -> DataFrame:
    """(rec, theta): a low quantile of the decelerations at speed, within bounds."""
    braking = (F.col("long_g") < -CONFIG.brake_decel_min) & (F.col("v") > CONFIG.brake_moving_mps)
    q = F.percentile(F.when(braking, -F.col("long_g")), CONFIG.brake_quantile)
    return trace.groupBy(*REC).agg(rounded(F.least(F.greatest(F.coalesce(q, F.lit(CONFIG.brake_enter_min)), F.lit(CONFIG.brake_enter_min)), F.lit(CONFIG.brake_enter_max)), 6).alias("theta"))


def brake_islands(trace: DataFrame, thresholds: DataFrame, value: str = "long_g") -> DataFrame:
    """(rec, island, t0, t1, peak_g, d0, d1): runs below the release level that reach the entry level.

    That is what a trigger with two levels gives: it enters at one and stays until the other.
    """
    t = trace.join(thresholds, REC)
    low = F.col(value) < -CONFIG.brake_release * F.col("theta")
    found = islands(t, REC, "seq", low).groupBy("rec", "island").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max(-F.col(value)).alias("peak"), F.min("odo").alias("d0"), F.max("odo").alias("d1"), F.max(F.col(value) < -F.col("theta")).alias("hit"))
    return found.where("hit").select("rec", "island", rounded("t0", 3).alias("t0"), rounded("t1", 3).alias("t1"), rounded("peak", 4).alias("peak_g"), rounded("d0", 3).alias("d0"), rounded("d1", 3).alias("d1"))


def lap_g(samples: DataFrame) -> DataFrame:
    """Samples of laps with their number ``i``, the smoothed longitudinal g of the lap's own speeds, and ``gate``, smoothed over a longer time."""
    s = long_g(samples, ("rec", "lap_id"), ("t", "dist")).withColumn("i", F.row_number().over(along(LAP, "t", "dist")) - 1)
    s = s.withColumn("_dt", F.col("t") - F.lag("t").over(along(LAP, "i")))
    step, n = F.median("_dt").over(Window.partitionBy(*LAP)), F.count("*").over(Window.partitionBy(*LAP))
    width = lambda seconds: F.when(n < 3, 1).otherwise(F.greatest(F.bround(seconds / F.greatest(step, F.lit(1e-9))), F.lit(1))).cast("int")
    s = s.withColumns({"_w": width(F.lit(CONFIG.brake_smooth_s)), "_wide": width(F.lit(CONFIG.brake_gate_s))}).drop("_dt")
    s = boxcar_by(s.withColumnRenamed("long_g", "_raw"), "_raw", "_w", LAP, "i", "long_g")
    return boxcar_by(s, "long_g", "_wide", LAP, "i", "gate").drop("_raw", "_w", "_wide")


def fragments(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(rec, lap_id, k, d0, t0, d1, t1, peak_g, between): runs of :func:`lap_g` below the release level that reach the entry level.

    Distances and times are the lap's own.  ``between`` is the largest gate from the last
    sample of the fragment before to the first of this one, null for a lap's first.  All is
    one sweep of a lap: a sample belongs to a fragment or to the gap behind one.
    """
    w, run = along(LAP, "i"), along(LAP, "i").rowsBetween(Window.unboundedPreceding, 0)
    s = samples.join(thresholds, REC).withColumn("_in", F.coalesce(F.col("long_g") < -CONFIG.brake_release * F.col("theta"), F.lit(False)))
    s = s.withColumn("_s", (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int")).withColumn("_n", F.sum("_s").over(run))
    hit = F.max(F.col("_in") & (F.col("long_g") < -F.col("theta"))).over(Window.partitionBy(*LAP, "_n"))
    s = s.withColumn("_f", F.col("_in") & hit).withColumn("_k", F.sum((F.col("_f") & (F.col("_s") == 1)).cast("int")).over(run))
    at = F.when(F.col("_f"), F.struct("i", "dist", "elapsed", "gate"))
    parts = s.groupBy(*LAP, F.col("_k").alias("k")).agg(F.min(at).alias("a"), F.max(at).alias("z"), F.max(F.when(F.col("_f"), -F.col("long_g"))).alias("peak_g"), F.max(F.when(~F.col("_f"), F.col("gate"))).alias("_gap"))
    order = along(LAP, "k")
    before = F.lag("z.gate").over(order)
    between = F.when(F.col("k") > 1, F.greatest(before, F.lag("_gap").over(order), F.col("a.gate")))
    found = parts.withColumn("between", between).where("a is not null")
    return found.select(*LAP, "k", F.col("a.dist").alias("d0"), F.col("a.elapsed").alias("t0"), F.col("z.dist").alias("d1"), F.col("z.elapsed").alias("t1"), "peak_g", "between")


def brake_events(fragments_: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """(rec, lap_id, d0, t0, d1, t1, peak_g, seconds, fragments): fragments fused to one event where the driver brakes on.

    Two stay apart if more than ``merge_gap_m`` lie between them, if the gate rises above ``merge_accel_g``
    between them, or if the event began in one corner's window (rec, lap_id, cid, enter, exit; widened by
    ``merge_lead_m`` before it) and the fragment in another's.  The first two cut a lap into runs
    by windows.  The last depends on where the event began, so it is a fold over a run of fragments.
    An event begins with its first fragment that lasts ``event_min_s``, which is then settled, or else with
    its first one; it must last as long itself.
    """
    f = fragments_
    if windows is None:
        f = f.withColumn("corner", F.lit(None).cast("int"))
    else:
        spans = windows.select(*LAP, "cid", F.greatest(F.col("enter") - CONFIG.merge_lead_m, F.lit(0.0)).alias("_a"), F.col("exit").alias("_b"))
        first = f.select(*LAP, "k", "d0").join(spans, LAP).where((F.col("d0") >= F.col("_a")) & (F.col("d0") <= F.col("_b"))).groupBy(*LAP, "k").agg(F.min("cid").cast("int").alias("corner"))
        f = f.join(first, [*LAP, "k"], "left")
    order = along(LAP, "k")
    far = F.col("d0") - F.lag("d1").over(order) > CONFIG.merge_gap_m
    f = runs(f.withColumn("_cut", far | (F.col("between") > CONFIG.merge_accel_g)), LAP, "k", F.col("_cut"), "_run")
    lasting = F.col("t1") - F.col("t0") >= CONFIG.event_min_s
    rows = f.groupBy(*LAP, "_run").agg(F.sort_array(F.collect_list(F.struct("k", "d0", "t0", "d1", "t1", "peak_g", "corner", lasting.alias("settled")))).alias("fs"))
    names = ("d0", "t0", "d1", "t1", "peak_g", "corner", "settled")
    event = "struct<d0: double, t0: double, d1: double, t1: double, peak_g: double, corner: int, settled: boolean, fragments: bigint>"

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        apart = F.coalesce(last["corner"] != p["corner"], F.lit(False)) | (F.size(done) == 0)
        later = ~last["settled"] & p["settled"]
        start = {c: F.when(later, p[c]).otherwise(last[c]).alias(c) for c in ("d0", "t0", "corner")}
        joined = F.struct(start["d0"], start["t0"], p["d1"].alias("d1"), p["t1"].alias("t1"), F.greatest(last["peak_g"], p["peak_g"]).alias("peak_g"), start["corner"], (last["settled"] | p["settled"]).alias("settled"), (last["fragments"] + 1).alias("fragments"))
        one = F.struct(*[p[c].alias(c) for c in names], F.lit(1).cast("long").alias("fragments"))
        return F.when(apart, F.concat(done, F.array(one))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    fused = rows.select(*LAP, F.explode(F.aggregate("fs", F.expr(f"cast(array() as array<{event}>)"), step)).alias("e")).select(*LAP, "e.*")
    return fused.withColumn("seconds", F.col("t1") - F.col("t0")).where(F.col("seconds") >= CONFIG.event_min_s).select(*LAP, "d0", "t0", "d1", "t1", "peak_g", "seconds", "fragments")


def lap_coasts(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(rec, lap_id, d0, d1, seconds): spans of :func:`lap_g` at speed with neither brake nor throttle, that last."""
    inside = (F.col("long_g") < -CONFIG.coast_g) & (F.col("long_g") > -F.col("theta")) & (F.col("v") > CONFIG.brake_moving_mps)
    found = islands(samples.join(thresholds, REC), LAP, "i", inside).groupBy(*LAP, "island").agg(F.min("dist").alias("d0"), F.max("dist").alias("d1"), (F.max("elapsed") - F.min("elapsed")).alias("seconds"))
    return found.where(F.col("seconds") >= CONFIG.event_min_s).drop("island")


def coasting(trace: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(rec, island, t0, t1): spans at speed with neither brake nor throttle, that last."""
    t = trace.join(thresholds, REC)
    inside = (F.col("long_g") > -F.col("theta")) & (F.col("long_g") < -CONFIG.coast_g) & (F.col("v") > CONFIG.brake_moving_mps)
    found = islands(t, REC, "seq", inside).groupBy("rec", "island").agg(rounded(F.min("t"), 3).alias("t0"), rounded(F.max("t"), 3).alias("t1"))
    return found.where(rounded(F.col("t1") - F.col("t0"), 3) >= CONFIG.event_min_s)


def pedals(theta: Column, g: str = "long_g") -> Column:
    """-1 (full brake) to 1 (full throttle)."""
    a = F.col(g)
    brake = F.when(-a < 0.18, 0.0).otherwise(-F.least(-a / theta, F.lit(1.0)))
    return F.when(a < 0, brake).otherwise(F.least(a / 0.5, F.lit(1.0)))


def grip_envelope(trace: DataFrame, lat: str = "lat_g", long: str = "long_g") -> DataFrame:
    """(rec, envelope_g): a high quantile of the total g at speed, with a floor."""
    total = F.when(F.col("v") > CONFIG.brake_moving_mps, F.sqrt(F.col(lat) ** 2 + F.col(long) ** 2))
    return trace.groupBy(*REC).agg(rounded(F.greatest(F.coalesce(F.percentile(total, CONFIG.envelope_quantile), F.lit(CONFIG.envelope_floor)), F.lit(CONFIG.envelope_floor)), 4).alias("envelope_g"))


def grip_utilisation(trace: DataFrame, envelope: DataFrame, lat: str = "lat_g", long: str = "long_g") -> DataFrame:
    share = F.sqrt(F.col(lat) ** 2 + F.col(long) ** 2) / F.col("envelope_g")
    return trace.join(envelope, REC).select("rec", "seq", rounded(F.least(share, F.lit(CONFIG.utilisation_max)), 4).alias("utilisation"))


def max_decel(events: DataFrame) -> DataFrame:
    return events.groupBy(*REC).agg(F.greatest(F.percentile("peak_g", 0.9), F.lit(CONFIG.envelope_floor)).alias("a_max"))


def brake_distance(v: Column, v_apex: Column, a_max: Column, slope: Column | None = None) -> Column:
    """Metres that braking from v to v_apex takes; null where there is nothing to brake."""
    a = (a_max + (F.sin(slope) if slope is not None else 0.0)) * CONFIG.g
    return F.when((v > v_apex) & (a > 0), (v * v - v_apex * v_apex) / (2 * a))


def brake_points(stats: DataFrame, events: DataFrame, samples: DataFrame, limits: DataFrame) -> DataFrame:
    """(rec, lap_id, cid, onset, peak_g, optimal, metres_later, commit): the last brake onset before or in each corner, against the latest that would do.

    Speed is taken where braking begins.  A corner without an onset, or without anything to brake for, has no row.
    """
    met = stats.join(events.select(*LAP, "d0", "peak_g"), LAP).where((F.col("d0") >= F.col("enter") - CONFIG.corner_lead_m) & (F.col("d0") <= F.col("exit")))
    last = met.groupBy(*LAP, "cid", "apex", "v_apex").agg(F.max(F.struct("d0", "peak_g")).alias("e"))
    asked = last.select(*LAP, F.col("e.d0").alias("dist"), "cid", "apex", "v_apex", F.col("e.peak_g").alias("peak_g"))
    at = interp_join(samples, asked, LAP, "dist", ["v"]).join(limits, REC)
    need = brake_distance(F.col("v"), F.col("v_apex"), F.col("a_max"))
    both = at.withColumn("optimal", F.col("apex") - need).where("optimal is not null")
    return both.select(*LAP, "cid", F.col("dist").alias("onset"), "peak_g", "optimal", (F.col("optimal") - F.col("dist")).alias("metres_later"), F.when(F.col("a_max") > 0, F.col("peak_g") / F.col("a_max")).alias("commit"))


def onset_spread(points: DataFrame, totals: DataFrame, lengths: DataFrame) -> DataFrame:
    """(rec, cid, n, median_m, sigma_m, span_m, commit_pct, later_m) over laps; onsets are scaled to the best lap's length."""
    p = points.join(totals.select(*LAP, "total"), LAP).join(lengths.select("rec", "length"), REC).withColumn("_o", F.col("onset") * F.col("length") / F.col("total"))
    return p.groupBy("rec", "cid").agg(
        F.count("*").alias("n"), rounded(F.median("_o"), 3).alias("median_m"), rounded(F.stddev_samp("_o"), 4).alias("sigma_m"), rounded(F.max("_o") - F.min("_o"), 3).alias("span_m"),
        rounded(F.median("commit") * 100, 3).alias("commit_pct"), rounded(F.median("metres_later"), 3).alias("later_m"),
    )


def rainbow(trace: DataFrame, value: str, n: int = 16) -> DataFrame:
    """(rec, seq, bucket) of a channel between its least and largest value."""
    box = trace.groupBy(*REC).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return trace.join(box, REC).select("rec", "seq", buckets(F.col(value), F.col("_lo"), F.col("_hi"), n).alias("bucket"))


def g_cloud(forces: DataFrame, most: int = 4000) -> DataFrame:
    """At most ``most`` of each recording's rows (rec, t, ...), evenly taken in order of time, for a plot."""
    n = F.count("*").over(Window.partitionBy(*REC))
    placed = forces.withColumns({"_i": F.row_number().over(along(REC, "t")) - 1, "_s": F.ceil(n / most)})
    return placed.where("_i % _s = 0").drop("_i", "_s")


def smoothed_g(trace: DataFrame, width: int = 3) -> DataFrame:
    return trace.withColumn("long_g", boxcar("long_g", REC, "seq", width))
