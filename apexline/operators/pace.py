"""Statistics of lap times: spread, trend, records, totals.  All take (rec, lap_id, lap_s)."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clock_text, rounded
from .house import along
from .trace import moving_time, path_distance

REC = ["rec"]


def pace(laps: DataFrame) -> DataFrame:
    a = laps.groupBy(*REC).agg(F.count("*").alias("n"), F.min("lap_s").alias("best_s"), F.median("lap_s").alias("median_s"), F.stddev_samp("lap_s").alias("s"))
    return a.select("rec", "n", "best_s", rounded("median_s", 4).alias("median_s"), rounded("s", 4).alias("sigma_s"), rounded(F.col("median_s") - F.col("best_s"), 4).alias("gap_s"), rounded(F.col("s") / F.col("median_s") * 100, 4).alias("cov_pct"))


def _pairs_up_to(y: np.ndarray, p: int, q: int) -> int:
    """How many pairs i < j have a slope (y_j - y_i) / (j - i) of at most p / q.

    These are the pairs that q y - p i puts in descending order or ties: inversions of its ranks, counted bit by bit.
    """
    n = len(y)
    at = np.arange(n)
    big = max(abs(int(y.max())), abs(int(y.min()))) * q + abs(p) * n >= 1 << 62
    z = q * y.astype(object) - p * at.astype(object) if big else q * y - p * at
    rank = np.empty(n, np.int64)
    # Equal ones count, so later ones rank lower.
    rank[np.lexsort((-at, z)) if not big else np.array(sorted(range(n), key=lambda i: (z[i], -i)))] = at
    found = 0
    for bit in range(max(1, (n - 1).bit_length()) - 1, -1, -1):
        # In order of place within equal higher bits: ones before zeros are inversions that this bit decides.
        group, one = rank >> (bit + 1), (rank >> bit) & 1
        order = np.argsort(group, kind="stable")
        one, group = one[order], group[order]
        ones = np.cumsum(one) - one
        begin = np.append(True, group[1:] != group[:-1])
        found += int(np.sum((ones - ones[np.maximum.accumulate(np.where(begin, at, 0))])[one == 0]))
    return found


def _slope_of_rank(y: np.ndarray, k: int) -> Fraction:
    """The k-th smallest slope (from 1) of all pairs: halved until one fraction with a possible denominator is left."""
    n = len(y)
    steps = 2 * n.bit_length() + 2
    lo, hi = (int(y.min()) - int(y.max()) - 1) << steps, (int(y.max()) - int(y.min())) << steps
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if _pairs_up_to(y, mid, 1 << steps) >= k else (mid, hi)
    return Fraction(lo + hi, 2 << steps).limit_denominator(n - 1)


def median_slope(y: np.ndarray) -> float:
    """The median of (y_j - y_i) / (j - i) over all pairs i < j of two integers and more, exact, without making the pairs."""
    pairs = len(y) * (len(y) - 1) // 2
    low = _slope_of_rank(y, (pairs + 1) // 2)
    if pairs % 2 or _pairs_up_to(y, low.numerator, low.denominator) > pairs // 2:
        return float(low)
    return float((low + _slope_of_rank(y, pairs // 2 + 1)) / 2)


def theil_sen(laps: DataFrame, least: int = 6) -> DataFrame:
    """(rec, n, slope): median slope over all pairs of a recording's laps, in seconds a lap; null with too few.

    Lap times are taken in milliseconds.  The pairs aren't made: the slope is found by counting
    inversions, in n log n for each of some tens of halvings.  Laps without a time are left out.
    """
    timed = laps.where("lap_s is not null")
    kind = laps.schema["rec"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y = np.rint(part.sort_values("lap_id")["lap_s"].to_numpy(float) * 1000).astype(np.int64)
        return pd.DataFrame({"rec": part["rec"].iloc[:1], "n": [len(y)], "slope": [median_slope(y) / 1000 if len(y) >= max(least, 2) else None]})

    found = timed.select("rec", "lap_id", F.col("lap_s").cast("double").alias("lap_s")).groupBy(*REC).applyInPandas(run, f"rec {kind}, n bigint, slope double")
    return found.select("rec", "n", rounded("slope", 4).alias("slope"))


def race_pace(laps: DataFrame, width: int = 3) -> DataFrame:
    """The best mean of ``width`` laps in a row."""
    w = along(REC, "lap_id").rowsBetween(-(width - 1), 0)
    full = laps.withColumns({"m": F.avg("lap_s").over(w), "k": F.count("lap_s").over(w)}).where(F.col("k") == width)
    return full.groupBy(*REC).agg(rounded(F.min("m"), 4).alias("race_pace_s"))


def within(laps: DataFrame, percent: float = 2.0) -> DataFrame:
    best = F.min("lap_s").over(Window.partitionBy(*REC))
    return laps.withColumn("_b", best).groupBy(*REC).agg(F.count_if(F.col("lap_s") <= F.col("_b") * (1 + percent / 100)).alias("within"), F.count("*").alias("n"))


def records(laps: DataFrame) -> DataFrame:
    """``laps`` marked where they beat every one before."""
    before = F.min("lap_s").over(along(REC, "lap_id").rowsBetween(Window.unboundedPreceding, -1))
    return laps.select("rec", "lap_id", "lap_s", F.coalesce(F.col("lap_s") < before, F.lit(True)).alias("is_pb"))


def trend(laps: DataFrame) -> DataFrame:
    return laps.select("rec", "lap_id", "lap_s")


def median_lap(laps: DataFrame) -> DataFrame:
    """The lap in the middle by time, the lower one of two."""
    w = along(REC, "lap_s", "lap_id")
    n = F.count("*").over(Window.partitionBy(*REC))
    return laps.withColumns({"_r": F.row_number().over(w), "_n": n}).where(F.expr("_r = (_n + 1) div 2")).select("rec", "lap_id", "lap_s")


def totals(trace: DataFrame) -> DataFrame:
    return trace.groupBy(*REC).agg(F.count("*").alias("fixes"), rounded(F.max("t") - F.min("t"), 3).alias("duration_s"), rounded(F.max("odo") - F.min("odo"), 3).alias("driven_m"), F.max("v").alias("vmax_mps"))


def headlines(trace: DataFrame, clock: DataFrame) -> DataFrame:
    """(rec, duration_s, moving_s, distance_m, start_clock, end_clock) of recordings; ``clock`` (rec, ms) are the fixes' wall-clock times."""
    span = clock.where("ms > 0").groupBy(*REC).agg(F.min("ms").alias("_a"), F.max("ms").alias("_b"))
    whole = trace.groupBy(*REC).agg(rounded(F.max("t") - F.min("t"), 3).alias("duration_s"))
    both = whole.join(moving_time(trace), REC).join(path_distance(trace), REC).join(span, REC, "left")
    return both.select("rec", "duration_s", "moving_s", F.col("path_m").alias("distance_m"), clock_text(F.col("_a")).alias("start_clock"), clock_text(F.col("_b")).alias("end_clock"))


def lap_stats(samples: DataFrame, laps: DataFrame, forces: DataFrame, brakes: DataFrame, coasts: DataFrame) -> DataFrame:
    """(rec, lap_id, lap_s, vmax_kmh, vmin_kmh, mean_kmh, lateral_g, braking_g, brake_s, brake_n, coast_s, coast_share) of laps.

    ``forces`` (rec, lap_id, lat_g, long_g) are the samples of a force series in each lap, null where there are none;
    a lap without events has sums of 0.
    """
    key = ["rec", "lap_id"]
    v = samples.groupBy(*key).agg(F.max("v").alias("_hi"), F.min("v").alias("_lo"), F.max("dist").alias("_d"))
    g = forces.groupBy(*key).agg(F.max(F.abs("lat_g")).alias("_lat"), F.greatest(F.max(-F.col("long_g")), F.lit(0.0)).alias("_brake"))
    b = brakes.groupBy(*key).agg(F.sum("seconds").alias("_bs"), F.count("*").alias("_bn"))
    c = coasts.groupBy(*key).agg(F.sum("seconds").alias("_cs"))
    all_ = laps.select(*key, "lap_s").join(v, key).join(g, key, "left").join(b, key, "left").join(c, key, "left")
    none = lambda x, zero=0.0: F.coalesce(x, F.lit(zero))
    return all_.select(
        *key, "lap_s", (F.col("_hi") * 3.6).alias("vmax_kmh"), (F.col("_lo") * 3.6).alias("vmin_kmh"), F.try_divide(F.col("_d") * 3.6, F.col("lap_s")).alias("mean_kmh"), F.col("_lat").alias("lateral_g"), F.col("_brake").alias("braking_g"),
        none(F.col("_bs")).alias("brake_s"), F.coalesce("_bn", F.lit(0)).alias("brake_n"), none(F.col("_cs")).alias("coast_s"), F.try_divide(none(F.col("_cs")), F.col("lap_s")).alias("coast_share"),
    )


def lap_vmax(samples: DataFrame) -> DataFrame:
    """(rec, lap_id, vmax_kmh): the top speed of each lap."""
    return samples.groupBy("rec", "lap_id").agg((F.max("v") * 3.6).alias("vmax_kmh"))


def tops(stats: DataFrame, coasts: DataFrame) -> DataFrame:
    """(rec, vmax_kmh, vmax_lap, longest_coast_s), from laps (rec, lap_id, vmax_kmh): a recording's top speed and the first lap that has it, and its longest coast (0 without any)."""
    top = stats.groupBy(*REC).agg(F.min(F.struct((-F.col("vmax_kmh")).alias("v"), "lap_id")).alias("p"))
    longest = coasts.groupBy(*REC).agg(F.max("seconds").alias("s"))
    return top.join(longest, REC, "left").select("rec", (-F.col("p.v")).alias("vmax_kmh"), F.col("p.lap_id").alias("vmax_lap"), F.coalesce("s", F.lit(0.0)).alias("longest_coast_s"))


def lap_speeds(laps: DataFrame) -> DataFrame:
    return laps.select("rec", "lap_id", rounded(F.col("v_max") * 3.6, 3).alias("vmax_kmh"), rounded(F.col("v_min") * 3.6, 3).alias("vmin_kmh"), rounded(F.col("dist_m") / F.col("lap_s") * 3.6, 3).alias("mean_kmh"))


def spreads(times: DataFrame, part: str, value: str) -> DataFrame:
    """(rec, part, n, sigma, median, loss, score) over laps, for sectors or corners; those seen once are left out."""
    a = times.groupBy("rec", part).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("s"), F.median(value).alias("m"), F.min(value).alias("b")).where("n > 1")
    return a.select("rec", part, "n", rounded("s", 4).alias("sigma_s"), rounded("m", 4).alias("median_s"), rounded(F.col("m") - F.col("b"), 4).alias("loss_s"), rounded(F.col("s") * (F.col("m") - F.col("b")), 6).alias("score"))


def ranked(spreads_: DataFrame, part: str) -> DataFrame:
    return spreads_.withColumn("rank", F.row_number().over(Window.partitionBy(*REC).orderBy(F.desc("score"), part)))


def residuals(pairs: DataFrame) -> DataFrame:
    """Statistics of measured minus reference times, with the deviation of the whole population."""
    d = pairs.withColumn("d", F.col("measured") - F.col("reference")).where("d is not null and not isnan(d)")
    return d.groupBy(*REC).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.stddev_pop("d").alias("std"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rms"))


def clock_rate(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*REC).agg((F.sum(F.col("reference") * F.col("measured")) / F.sum(F.col("reference") ** 2)).alias("rate"))


def offset(measured: DataFrame, reference: DataFrame, most: int = 400) -> DataFrame:
    """The shift of lap numbers at which both series of lap times agree best.

    ``reference`` (rec, lap_no, ref_s) is one transponder's list; an exploded shift makes the match an equi-join.
    """
    shifted = measured.where("lap_s <= 72").select("rec", "lap_s", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("shift"), "lap_id").withColumn("lap_no", F.col("lap_id") + F.col("shift"))
    both = shifted.join(reference.where("ref_s <= 72"), ["rec", "lap_no"])
    n = measured.groupBy(*REC).agg(F.count("*").alias("laps"))
    # F.corr divides by the spreads, which fails where all times of a shift are alike; such a shift has no correlation and can't win.
    spread = F.sqrt(F.var_pop("lap_s") * F.var_pop("ref_s"))
    fit = both.groupBy("rec", "shift").agg(F.try_divide(F.covar_pop("lap_s", "ref_s"), spread).alias("r"), F.count("*").alias("k")).join(n, REC).where((F.col("k") >= F.greatest(F.lit(5), 0.7 * F.col("laps"))) & F.col("r").isNotNull())
    return fit.groupBy(*REC).agg(F.max(F.struct("r", (-F.col("shift")).alias("s"))).alias("b")).select("rec", (-F.col("b.s")).alias("shift"), "b.r")
