"""Corners: curvature of the laps, pooled; detection; times and speeds in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CONFIG
from ..functions.scalars import rounded
from .house import along, boxcar_by, gradient, interp_join, islands, runs, united, unwrap

REC, LAP = ["rec"], ["rec", "lap_id"]


def curvature(samples: DataFrame, arc_m: float = CONFIG.corner_window_m) -> DataFrame:
    """(rec, lap_id, dist, kappa): turning per metre along each lap, smoothed over ``arc_m`` metres by the lap's median step.

    Samples at one place are taken once.
    """
    w = along(LAP, "dist")
    moved = samples.withColumn("_d", F.col("dist") - F.lag("dist").over(w)).where("_d is null or _d > 1e-9").drop("_d")
    moved = moved.withColumns({"_dx": gradient("x", "dist", LAP, "dist"), "_dy": gradient("y", "dist", LAP, "dist")}).withColumn("_a", F.atan2("_dy", "_dx"))
    turned = unwrap(moved, "_a", LAP, "dist", "_psi").withColumns({"_k": gradient("_psi", "dist", LAP, "dist"), "_d": F.col("dist") - F.lag("dist").over(w)})
    step = F.median("_d").over(Window.partitionBy(*LAP))
    turned = turned.withColumn("_w", F.greatest(F.bround(F.lit(arc_m) / F.greatest(step, F.lit(1e-9))), F.lit(1)).cast("int"))
    return boxcar_by(turned.select(*LAP, "dist", "_k", "_w"), "_k", "_w", LAP, "dist", "kappa").select(*LAP, "dist", "kappa")


def pooled(curves: DataFrame, lengths: DataFrame) -> DataFrame:
    """(rec, i, s_m, kappa): median over laps on cells of CELL metres; ``lengths`` (rec, length)."""
    n = F.greatest(F.bround(F.col("length") / CONFIG.corner_cell_m), F.lit(16)).cast("int")
    total = curves.groupBy(*LAP).agg(F.max("dist").alias("total"), F.count("*").alias("n")).where("n >= 8")
    cells = total.select(*LAP, "total").join(lengths.select("rec", "length", n.alias("cells")), REC)
    grid = cells.select(*LAP, "total", "length", "cells", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("i"))
    grid = grid.select(*LAP, (F.col("i") / (F.col("cells") - 1) * F.col("total")).alias("dist"), "i", (F.col("i") / (F.col("cells") - 1) * F.col("length")).alias("s_m"))
    return interp_join(curves, grid, LAP, "dist", ["kappa"]).groupBy("rec", "i").agg(F.max("s_m").alias("s_m"), F.median("kappa").alias("kappa"))


def otsu(values: DataFrame, value: str = "kappa", bins: int = CONFIG.otsu_bins) -> DataFrame:
    """(rec, threshold): the split of the logarithm's histogram with the largest variance between its sides, the first of equals."""
    logs = values.select("rec", F.log10(F.greatest(F.abs(value), F.lit(CONFIG.kappa_floor))).alias("q"))
    box = logs.groupBy(*REC).agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    placed = logs.join(box, REC).withColumn("b", F.least(F.floor((F.col("q") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * bins), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy("rec", "b", "lo", "hi").agg(F.count("*").alias("n"))
    all_bins = box.select("rec", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("b"))
    hist = all_bins.join(counts.select("rec", "b", "n"), ["rec", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mid = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("b") + 0.5) / bins
    w, all_ = along(REC, "b").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*REC)
    h = hist.withColumn("m", mid).withColumns({"w0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("m")).over(w), "w": F.sum("n").over(all_), "s": F.sum(F.col("n") * F.col("m")).over(all_)})
    w1 = F.col("w") - F.col("w0")
    var = F.col("w0") * w1 * (F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1) ** 2
    best = h.where((F.col("w0") > 0) & (w1 > 0)).groupBy(*REC).agg(F.min(F.struct((-rounded(var, 6)).alias("v"), "b", "m")).alias("x"))
    return best.select("rec", F.col("x.b").alias("bin"), rounded(F.pow(F.lit(10.0), F.col("x.m")), 8).alias("threshold"))


def detect(profile: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(rec, cid, enter, exit, apex, direction, turn_deg): corners of a pooled profile (rec, i, s_m, kappa).

    Runs above the low level that reach the high one, cut where the sign
    changes; near ones of a direction are one corner; short or slight ones go.
    """
    p = profile.join(thresholds.select("rec", "threshold"), REC)
    w = along(REC, "i")
    step = F.coalesce(F.col("s_m") - F.lag("s_m").over(w), F.lit(0.0))
    p = p.withColumns({"sign": F.signum("kappa"), "_area": (F.col("kappa") + F.lag("kappa").over(w)) / 2 * step})
    inside = islands(p, REC, "i", F.abs("kappa") >= CONFIG.corner_low * F.col("threshold"))
    cut = runs(inside, ["rec", "island"], "i", F.col("sign") != F.lag("sign").over(along(["rec", "island"], "i")), "piece")
    k = F.abs("kappa")
    parts = cut.groupBy("rec", "island", "piece").agg(F.min("s_m").alias("a"), F.max("s_m").alias("b"), F.max(k).alias("top"), F.first("threshold").alias("t"), F.first("sign").alias("sign"), F.min("i").alias("i0"), F.max("i").alias("i1")).where("top >= t")
    order = along(REC, "a")
    far = (F.col("a") - F.lag("b").over(order) > CONFIG.corner_merge_m) | (F.col("sign") != F.lag("sign").over(order))
    merged = runs(parts, REC, "a", far, "g").groupBy("rec", "g").agg(F.min("a").alias("enter"), F.max("b").alias("exit"), F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.max_by("sign", "top").cast("int").alias("direction"))
    # A corner's turn and middle are those of its whole stretch, which is fetched by its cells' numbers.
    cells = merged.select("rec", "g", "i0", F.explode(F.sequence("i0", "i1")).alias("i")).join(p.select("rec", "i", "s_m", "kappa", "_area"), ["rec", "i"])
    whole = cells.groupBy("rec", "g").agg(F.abs(F.degrees(F.sum(F.when(F.col("i") > F.col("i0"), F.col("_area")).otherwise(0.0)))).alias("turn_deg"), (F.sum(k * F.col("s_m")) / F.sum(k)).alias("apex"))
    kept = merged.join(whole, ["rec", "g"]).where((F.col("exit") - F.col("enter") >= CONFIG.corner_min_m) & (F.col("turn_deg") >= CONFIG.corner_min_deg))
    return kept.select("rec", F.row_number().over(along(REC, "enter")).alias("cid"), rounded("enter", 3).alias("enter"), rounded("exit", 3).alias("exit"), rounded("apex", 3).alias("apex"), "direction", rounded("turn_deg", 3).alias("turn_deg"))


def segments(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """(rec, lap_id, part, cid, time_s): a lap cut at all corners' ends; even parts are straights, the sum is the lap's time.

    ``windows`` are the corners on each lap (rec, lap_id, cid, enter, exit, total).
    """
    edges = windows.groupBy(*LAP).agg(F.sort_array(F.collect_list(F.struct("cid", "enter", "exit"))).alias("cs"), F.max("total").alias("total"))
    flat = F.flatten(F.transform("cs", lambda c: F.array(c["enter"], c["exit"])))
    grid = edges.select(*LAP, F.posexplode(F.concat(F.array(F.lit(0.0)), flat, F.array("total"))).alias("part", "dist"))
    at = interp_join(samples, grid.select(*LAP, "dist", "part"), LAP, "dist", ["elapsed"])
    nxt = at.withColumn("next", F.lead("elapsed").over(along(LAP, "part"))).where("next is not null")
    return nxt.select(*LAP, "part", F.when(F.col("part") % 2 == 1, F.expr("(part + 1) div 2")).alias("cid"), rounded(F.col("next") - F.col("elapsed"), 4).alias("time_s"))


def stats(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """(rec, lap_id, cid, time_s, enter, exit, apex, v_enter, v_exit, v_apex): each lap in each corner.

    The apex is the slowest sample inside, the first of equals; without any it is the middle of the window.
    Corners' ends are interpolated and samples are given to corners in one sweep of a lap each.
    """
    middle = (F.col("enter") + F.col("exit")) / 2
    places = F.array(*[F.struct(F.lit(e).alias("e"), d.alias("dist")) for e, d in enumerate((F.col("enter"), F.col("exit"), middle))])
    asked = windows.select(*LAP, "cid", F.explode(places).alias("p")).select(*LAP, "p.dist", "cid", "p.e")
    at = interp_join(samples, asked, LAP, "dist", ["elapsed", "v"])
    pair = at.groupBy(*LAP, "cid").agg(*[F.max(F.when(F.col("e") == e, F.col(c))).alias(f"{c}{e}") for e in range(3) for c in ("elapsed", "v")])
    # A sample is in the last corner that begins at or before it, if that hasn't ended.
    begins = windows.select(*LAP, F.col("enter").alias("dist"), F.lit(0).alias("_k"), F.struct("cid", "exit").alias("_c"), F.lit(None).cast("double").alias("v"))
    both = united(begins, samples.select(*LAP, "dist", F.lit(1).alias("_k"), F.lit(None).cast(begins.schema["_c"].dataType).alias("_c"), F.col("v").cast("double").alias("v")))
    inside = both.withColumn("_c", F.last("_c", ignorenulls=True).over(along(LAP, "dist", "_k").rowsBetween(Window.unboundedPreceding, 0))).where((F.col("_k") == 1) & (F.col("dist") <= F.col("_c.exit")))
    low = inside.groupBy(*LAP, F.col("_c.cid").alias("cid")).agg(F.min(F.struct("v", "dist")).alias("low"))
    out = windows.join(pair, [*LAP, "cid"]).join(low, [*LAP, "cid"], "left")
    return out.select(*LAP, "cid", rounded(F.col("elapsed1") - F.col("elapsed0"), 4).alias("time_s"), "enter", "exit", F.coalesce("low.dist", middle).alias("apex"), F.col("v0").alias("v_enter"), F.col("v1").alias("v_exit"), F.coalesce("low.v", "v2").alias("v_apex"))


def markers(samples: DataFrame, stats_: DataFrame) -> DataFrame:
    """(rec, lap_id, cid, t_enter, x, y): when each lap enters each corner, and where its apex is."""
    ends = F.array(F.struct(F.lit(0).alias("e"), F.col("enter").alias("dist")), F.struct(F.lit(1).alias("e"), F.col("apex").alias("dist")))
    at = interp_join(samples, stats_.select(*LAP, "cid", F.explode(ends).alias("p")).select(*LAP, "p.dist", "cid", "p.e"), LAP, "dist", ["t", "x", "y"])
    of = lambda c, e, name: F.max(F.when(F.col("e") == e, F.col(c))).alias(name)
    return at.groupBy(*LAP, "cid").agg(of("t", 0, "t_enter"), of("x", 1, "x"), of("y", 1, "y"))


def against(stats_: DataFrame, base: DataFrame) -> DataFrame:
    """``stats_`` with ``delta_s`` and ``apex_delta`` against the laps ``base`` (rec, lap_id): a recording's best, or a reference lap of each."""
    own = stats_.join(base.select(*LAP), LAP, "left_semi").select("rec", "cid", F.col("time_s").alias("_t"), F.col("v_apex").alias("_v"))
    return stats_.join(own, ["rec", "cid"], "left").withColumns({"delta_s": rounded(F.col("time_s") - F.col("_t"), 4), "apex_delta": F.col("v_apex") - F.col("_v")}).drop("_t", "_v")


def against_reference(stats_: DataFrame, reference: DataFrame) -> DataFrame:
    """``stats_`` with ``delta_s`` and ``apex_delta`` against a lap of another recording, whose corners are ``reference`` (cid, time_s, v_apex); null where it has none."""
    own = reference.select("cid", F.col("time_s").alias("_t"), F.col("v_apex").alias("_v"))
    return stats_.join(own, "cid", "left").withColumns({"delta_s": rounded(F.col("time_s") - F.col("_t"), 4), "apex_delta": F.col("v_apex") - F.col("_v")}).drop("_t", "_v")


def phases(samples: DataFrame, windows: DataFrame, points: int = 64) -> DataFrame:
    """(rec, lap_id, cid, phase, time_s): entry, middle and exit of each corner, by thirds of its window: the integral of 1 / v on ``points`` places."""
    width = F.col("exit") - F.col("enter")
    thirds = F.array(*[F.struct(F.lit(p).alias("phase"), (F.col("enter") + width * p / 3).alias("a"), (F.col("enter") + width * (p + 1) / 3).alias("b")) for p in range(3)])
    cells = windows.select(*LAP, "cid", F.explode(thirds).alias("w")).select(*LAP, "cid", "w.*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"))
    grid = cells.select(*LAP, (F.col("a") + (F.col("b") - F.col("a")) * F.col("j") / (points - 1)).alias("dist"), "cid", "phase", "j")
    at = interp_join(samples, grid, LAP, "dist", ["v"])
    w = along([*LAP, "cid", "phase"], "j")
    at = at.withColumn("_r", 1 / F.greatest(F.col("v"), F.lit(1 / 3.6)))
    part = (F.col("_r") + F.lag("_r").over(w)) / 2 * (F.col("dist") - F.lag("dist").over(w))
    return at.withColumn("_p", part).groupBy(*LAP, "cid", "phase").agg(F.sum("_p").alias("time_s"))


def phase_losses(phases_: DataFrame, best: DataFrame) -> DataFrame:
    """(rec, lap_id, cid, phase, loss_s): what other laps than the best lose to it in each phase."""
    base = phases_.join(best.select(*LAP), LAP, "left_semi").select("rec", "cid", "phase", F.col("time_s").alias("base"))
    others = phases_.join(best.select(*LAP), LAP, "left_anti")
    return others.join(base, ["rec", "cid", "phase"]).select(*LAP, "cid", "phase", (F.col("time_s") - F.col("base")).alias("loss_s"))


def phase_matrix(losses: DataFrame) -> DataFrame:
    """(rec, cid, phase, loss_s, share): median loss to the best lap, and its share of all that is lost in the recording."""
    m = losses.groupBy("rec", "cid", "phase").agg(F.median("loss_s").alias("loss"))
    lost = F.greatest("loss", F.lit(0.0))
    return m.select("rec", "cid", "phase", rounded("loss", 4).alias("loss_s"), rounded(F.try_divide(lost, F.sum(lost).over(Window.partitionBy(*REC))), 4).alias("share"))


def phase_shares(losses: DataFrame) -> DataFrame:
    """(rec, entry_s, apex_s, exit_s): what is lost in each phase, all corners' positive median losses together."""
    m = losses.groupBy("rec", "cid", "phase").agg(F.greatest(F.median("loss_s"), F.lit(0.0)).alias("lost"))
    return m.groupBy(*REC).agg(*[rounded(F.sum(F.when(F.col("phase") == p, F.col("lost"))), 4).alias(n) for p, n in enumerate(("entry_s", "apex_s", "exit_s"))])


def straights(samples: DataFrame, segments_: DataFrame, stats_: DataFrame, best: DataFrame) -> DataFrame:
    """(rec, k, label, ring, n, best_s, median_s, sigma_s, trap_best_kmh, trap_median_kmh, exit_delta_kmh, leverage) of the straights, k from 0.

    Straight k leads into corner k + 1, the last one to the line.  Its trap speed is that at its
    end.  The exit's delta is the median speed out of the corner before against the best
    lap's; straight 0 has none, since its corner is the last straight's.  Leverage is slowness
    out of the corner times what the median loses on the straight.
    """
    times = segments_.where(F.col("part") % 2 == 0).groupBy("rec", F.expr("part div 2").cast("int").alias("k")).agg(F.count("*").alias("n"), F.min("time_s").alias("b"), F.median("time_s").alias("m"), F.stddev_samp("time_s").alias("s"))
    count = stats_.groupBy(*REC).agg(F.max("cid").alias("last"))
    final = samples.groupBy(*LAP).agg(F.max_by("v", "dist").alias("v")).join(count, REC).select("rec", F.col("last").alias("k"), "v")
    traps = united(stats_.select("rec", (F.col("cid") - 1).cast("int").alias("k"), F.col("v_enter").alias("v")), final.select("rec", F.col("k").cast("int").alias("k"), F.col("v").cast("double").alias("v")))
    traps = traps.groupBy("rec", "k").agg(F.max("v").alias("tb"), F.median("v").alias("tm"))
    own = stats_.join(best.select(*LAP), LAP, "left_semi").select("rec", "cid", F.col("v_exit").alias("_b"))
    exits = stats_.groupBy("rec", "cid").agg(F.median("v_exit").alias("x")).join(own, ["rec", "cid"]).select("rec", F.col("cid").cast("int").alias("k"), ((F.col("x") - F.col("_b")) * 3.6).alias("d"))
    all_ = times.join(count, REC).join(traps, ["rec", "k"], "left").join(exits, ["rec", "k"], "left")
    line, last = F.lit("S/F"), F.col("last").cast("int")
    name = F.when(F.col("k") == 0, F.concat(line, F.lit(" → C1"))).when(F.col("k") == last, F.format_string("C%d → S/F", "k")).otherwise(F.format_string("C%d → C%d", "k", F.col("k") + 1))
    gain = F.coalesce(F.greatest(-F.col("d"), F.lit(0.0)) * F.greatest(F.col("m") - F.col("b"), F.lit(0.0)), F.lit(0.0))
    return all_.select(
        "rec", "k", name.alias("label"), F.when(F.col("k") == 0, last).otherwise(F.col("k")).alias("ring"), "n", rounded("b", 4).alias("best_s"), rounded("m", 5).alias("median_s"), rounded("s", 4).alias("sigma_s"),
        rounded(F.col("tb") * 3.6, 3).alias("trap_best_kmh"), rounded(F.col("tm") * 3.6, 3).alias("trap_median_kmh"), rounded("d", 3).alias("exit_delta_kmh"), rounded(gain, 5).alias("leverage"),
    )
