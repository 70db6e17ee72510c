"""Cleaning a trace: quality, clock, smoothing, gaps, odometer.

A trace has a row for each fix, keyed by ``rec`` and ordered by ``seq``; every
window is partitioned by ``rec``, so recordings are worked on side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CONFIG
from ..functions.scalars import rounded
from .house import along, runs, smooth

REC = ["rec"]


def quality_ok() -> Column:
    """Known bad fixes and large dilutions fail; what isn't known passes."""
    bad_fix = (F.col("fix") >= 0) & (F.col("fix") < 3)
    return ~(F.coalesce(bad_fix, F.lit(False)) | F.coalesce(F.col("dop") > CONFIG.dop_max, F.lit(False))) & F.col("v").isNotNull()


def gated(trace: DataFrame) -> DataFrame:
    return trace.where(quality_ok())


def gate_fraction(trace: DataFrame) -> DataFrame:
    """(rec, fixes, dropped, fraction): the share of moving fixes that the gate drops."""
    moving = F.col("v") > CONFIG.moving_mps
    a = trace.groupBy(*REC).agg(F.count("*").alias("fixes"), F.count_if(moving & ~quality_ok()).alias("dropped"), F.count_if(moving).alias("moving"))
    return a.select("rec", "fixes", "dropped", rounded(F.when(F.col("moving") > 0, F.col("dropped") / F.col("moving")).otherwise(0.0), 6).alias("fraction"))


def timing_quality(fractions: DataFrame, media_clock: Column) -> DataFrame:
    """``fractions`` with the verdict on a recording's times."""
    low = F.col("fraction") >= CONFIG.degraded_fraction
    concerns = F.array_compact(F.array(F.when(media_clock, "media clock"), F.when(low, "weak GPS")))
    return fractions.withColumns({"degraded": media_clock | low, "concerns": concerns, "summary": F.when(F.size(concerns) == 0, "good").otherwise(F.array_join(concerns, ", "))})


def trimmed(trace: DataFrame) -> DataFrame:
    """From the first five moving fixes in a row to the last moving one; all if under ten would stay."""
    w = along(REC, "seq")
    steady = F.min("v").over(w.rowsBetween(0, 4)) > CONFIG.moving_mps
    full = F.lead("seq", 4).over(w).isNotNull()
    marked = trace.withColumns({"_a": F.when(steady & full, F.col("seq")), "_b": F.when(F.col("v") > CONFIG.moving_mps, F.col("seq"))})
    all_ = Window.partitionBy(*REC)
    marked = marked.withColumns({"_a": F.min("_a").over(all_), "_b": F.max("_b").over(all_)})
    inside = F.coalesce((F.col("seq") >= F.col("_a")) & (F.col("seq") <= F.col("_b")), F.lit(False))
    marked = marked.withColumn("_in", inside).withColumn("_n", F.count_if("_in").over(all_))
    return marked.where("_in or _n < 10").drop("_a", "_b", "_in", "_n")


def despiked(trace: DataFrame) -> DataFrame:
    """Without single fixes far from both neighbours, which are near each other, and fixes far outside the track's box; under ten stay as they are."""
    w = along(REC, "seq")
    hop = lambda x0, y0, x1, y1: F.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)
    px, py, nx, ny = (f(c).over(w) for f in (F.lag, F.lead) for c in ("x", "y"))
    far = CONFIG.spike_m
    spike = (hop(px, py, F.col("x"), F.col("y")) > far) & (hop(F.col("x"), F.col("y"), nx, ny) > far) & (hop(px, py, nx, ny) < far)
    q = lambda c, p: F.percentile(c, p)
    box = trace.groupBy(*REC).agg(F.count("*").alias("_n"), *[q(c, p).alias(f"_{c}{i}") for c in ("x", "y") for i, p in enumerate((0.01, 0.99))])
    margin = F.greatest(0.5 * F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")), F.lit(1.0))
    inside = F.col("x").between(F.col("_x0") - margin, F.col("_x1") + margin) & F.col("y").between(F.col("_y0") - margin, F.col("_y1") + margin)
    kept = trace.withColumn("_spike", F.coalesce(spike, F.lit(False))).join(box, REC)
    return kept.where((F.col("_n") < 10) | (~F.col("_spike") & inside)).select(*trace.columns)


def true_clock(fixes: DataFrame) -> DataFrame:
    """``fixes`` (rec, seq, naive, ts_ms) and ``t``: runs of credible receiver times, each anchored at its first naive time, made monotone."""
    w = along(REC, "seq")
    step = (F.col("ts_ms") - F.lag("ts_ms").over(w)) / 1000.0
    joined = (F.col("ts_ms") > 0) & (F.lag("ts_ms").over(w) > 0) & (step >= CONFIG.clock_min_s) & (step <= CONFIG.clock_max_s)
    marked = runs(fixes, REC, "seq", ~F.coalesce(joined, F.lit(False)), "run")
    run = along([*REC, "run"], "seq").rowsBetween(Window.unboundedPreceding, 0)
    t = F.first("naive").over(run) + (F.col("ts_ms") - F.first("ts_ms").over(run)) / 1000.0
    timed = marked.withColumn("_t", F.when(F.count("*").over(Window.partitionBy(*REC, "run")) > 1, t).otherwise(F.col("naive")))
    return timed.withColumn("t", F.max("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t")


def clock_used(fixes: DataFrame) -> DataFrame:
    """(rec, fixes, on_clock, used, first_ms, last_ms): how many fixes lie in runs of the receiver's clock, whether any do, and its first and last time."""
    w = along(REC, "seq")
    step = (F.col("ts_ms") - F.lag("ts_ms").over(w)) / 1000.0
    joined = F.coalesce((F.col("ts_ms") > 0) & (F.lag("ts_ms").over(w) > 0) & (step >= CONFIG.clock_min_s) & (step <= CONFIG.clock_max_s), F.lit(False))
    marked = fixes.withColumn("_j", joined).withColumn("_on", F.col("_j") | F.coalesce(F.lead("_j").over(w), F.lit(False)))
    known = F.when(F.col("ts_ms") > 0, F.col("ts_ms"))
    a = marked.groupBy(*REC).agg(F.count("*").alias("fixes"), F.count_if("_on").alias("on_clock"), F.min(known).alias("first_ms"), F.max(known).alias("last_ms"))
    return a.select("rec", "fixes", "on_clock", (F.col("on_clock") > 0).alias("used"), "first_ms", "last_ms")


def steps(trace: DataFrame) -> DataFrame:
    """``trace`` with the time since the fix before, and that one's values."""
    w = along(REC, "seq")
    return trace.withColumns({"dt": F.col("t") - F.lag("t").over(w), "v0": F.lag("v").over(w), "x0": F.lag("x").over(w), "y0": F.lag("y").over(w)})


def gap_runs(trace: DataFrame) -> DataFrame:
    """``trace`` with the number of the run, unbroken by more than a second, that a fix is in."""
    return runs(steps(trace), REC, "seq", F.col("dt") > CONFIG.run_gap_s)


def smoothed(trace: DataFrame, width: int = CONFIG.smooth) -> DataFrame:
    """Positions smoothed within runs; speeds as they are."""
    marked = gap_runs(trace)
    return marked.withColumns({c: smooth(c, ["rec", "run"], "seq", width) for c in ("x", "y")}).select(*trace.columns)


def dropouts(trace: DataFrame) -> DataFrame:
    """(rec, seq, t0, t1, missing): steps that are too long, and how many fixes they lack."""
    stepped = steps(trace)
    usual = stepped.where("dt > 0 and dt < 1").groupBy(*REC).agg(F.median("dt").alias("usual"))
    long_ = stepped.where(F.col("dt") > CONFIG.dropout_s).join(usual, REC)
    return long_.select("rec", "seq", rounded(F.col("t") - F.col("dt"), 3).alias("t0"), rounded("t", 3).alias("t1"), F.greatest(F.bround(F.col("dt") / F.col("usual")) - 1, F.lit(1.0)).cast("long").alias("missing"))


def odometer(trace: DataFrame) -> DataFrame:
    """``trace`` with ``odo_m``: chords, but over a gap at least the mean speed times its time."""
    s = steps(trace)
    chord = F.sqrt((F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2)
    step = F.when(F.col("dt") > CONFIG.dropout_s, F.greatest(chord, 0.5 * (F.col("v0") + F.col("v")) * F.col("dt"))).otherwise(chord)
    total = F.sum(F.coalesce(step, F.lit(0.0))).over(along(REC, "seq").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("odo_m", total).select(*trace.columns, "odo_m")


def path_distance(trace: DataFrame) -> DataFrame:
    s = steps(trace)
    return s.groupBy(*REC).agg(rounded(F.sum(F.sqrt((F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2)), 3).alias("path_m"))


def moving_time(trace: DataFrame) -> DataFrame:
    """Time in steps of up to a second that begin at speed."""
    ok = (F.col("dt") > 0) & (F.col("dt") <= CONFIG.moving_gap_s) & (F.col("v0") >= CONFIG.moving_clock_mps)
    return steps(trace).groupBy(*REC).agg(rounded(F.coalesce(F.sum(F.when(ok, F.col("dt"))), F.lit(0.0)), 3).alias("moving_s"))


def bounds(trace: DataFrame) -> DataFrame:
    """The box of a trace and its centre."""
    a = trace.groupBy(*REC).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
    return a.withColumns({f"mid_{c}": rounded((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2, 6) for c in ("x", "y")})


def long_g(trace: DataFrame, keys: tuple[str, ...] = ("rec",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``trace`` with the longitudinal g of its speed: uneven central differences, clipped; 0 with under three fixes."""
    w = along(list(keys), *order)
    all_ = Window.partitionBy(*keys)
    s = trace.withColumn("_h", F.col("t") - F.lag("t").over(w))
    usual = F.median(F.when(F.col("_h") > 0, F.col("_h"))).over(all_)
    s = s.withColumn("_h", F.when(F.col("_h") > 0, F.col("_h")).when(F.col("_h").isNotNull(), usual)).withColumns({"_n": F.lead("_h").over(w), "_v0": F.lag("v").over(w), "_v2": F.lead("v").over(w)})
    a, b = F.col("_h"), F.col("_n")
    slope = F.when(a.isNull(), (F.col("_v2") - F.col("v")) / b).when(b.isNull(), (F.col("v") - F.col("_v0")) / a).otherwise((a * a * F.col("_v2") + (b * b - a * a) * F.col("v") - b * b * F.col("_v0")) / (a * b * (a + b)))
    clip = F.least(F.greatest(slope / CONFIG.g, F.lit(-CONFIG.long_g_clip)), F.lit(CONFIG.long_g_clip))
    return s.withColumn("long_g", F.when(F.count("*").over(all_) < 3, 0.0).otherwise(clip)).drop("_h", "_n", "_v0", "_v2")
