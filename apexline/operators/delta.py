"""Laps compared at the same fraction of their distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CONFIG
from ..functions.scalars import rounded
from .house import along, interp_join
from .laps import lap_at

REC, LAP = ["rec"], ["rec", "lap_id"]


def to_baseline(grid: DataFrame, baseline: DataFrame) -> DataFrame:
    """(rec, lap_id, i, delta_s): elapsed time less that of the recording's baseline lap (rec, lap_id)."""
    base = grid.join(baseline.select(*LAP), LAP, "left_semi").select("rec", "i", F.col("elapsed").alias("base"))
    return grid.join(base, ["rec", "i"]).select(*LAP, "i", rounded(F.col("elapsed") - F.col("base"), 4).alias("delta_s"))


def curves(grid: DataFrame, baseline: DataFrame) -> DataFrame:
    """(rec, lap_id, i, x_m, x_s, speed_kmh, delta_s): a lap's curves over the baseline's distance or over its own time.

    ``grid`` has ``elapsed``, ``v`` and the lap's ``total`` at even fractions of each lap; a fraction is one place for all laps.
    """
    base = grid.join(baseline.select(*LAP), LAP, "left_semi").select("rec", "i", F.col("elapsed").alias("_e"), F.col("dist").alias("x_m"))
    both = grid.join(base, ["rec", "i"])
    return both.select(*LAP, "i", "x_m", F.col("elapsed").alias("x_s"), (F.col("v") * 3.6).alias("speed_kmh"), (F.col("elapsed") - F.col("_e")).alias("delta_s"))


def speed_at(asked: DataFrame, curves_: DataFrame) -> DataFrame:
    """``asked`` (rec, lap_id, x_m) with the speed of the lap's own curve at that place of the axis, clamped at its ends."""
    return interp_join(curves_, asked, LAP, "x_m", ["speed_kmh"])


def last_deltas(curves_: DataFrame) -> DataFrame:
    """(rec, lap_id, delta_s) at the finish: what the lap took longer."""
    return curves_.groupBy(*LAP).agg(F.max_by("delta_s", "i").alias("delta_s"))


def at_time(times: DataFrame, samples: DataFrame, baseline: DataFrame, laps_: DataFrame) -> DataFrame:
    """``times`` (rec, t) with the lap that is on, its ``dist``, ``elapsed`` and ``delta_s``: how far it is behind the baseline at the same place; null between laps.

    The place is the share of the lap's distance.  Times meet samples in two sweeps, one over time and one over distance.
    """
    extra = [c for c in times.columns if c not in ("rec", "t")]
    on = lap_at(times, laps_)
    total = samples.groupBy(*LAP).agg(F.max("dist").alias("_total"), F.min("t").alias("_t0"))
    here = interp_join(samples, on.where("lap_id is not null").select(*LAP, "t", *extra), LAP, "t", ["dist"]).join(total, LAP)
    base = samples.join(baseline.select(*LAP), LAP, "left_semi").select("rec", F.col("dist").alias("_d"), "elapsed")
    length = base.groupBy("rec").agg(F.max("_d").alias("_length"))
    asked = here.join(length, REC).select("rec", (F.col("dist") / F.col("_total") * F.col("_length")).alias("_d"), "lap_id", "t", "dist", (F.col("t") - F.col("_t0")).alias("_own"), *extra)
    met = interp_join(base, asked, REC, "_d", ["elapsed"])
    found = met.select("rec", "t", *extra, "lap_id", "dist", F.col("_own").alias("elapsed"), (F.col("_own") - F.col("elapsed")).alias("delta_s"))
    return found.unionByName(on.where("lap_id is null"), allowMissingColumns=True)


def following(grid: DataFrame) -> DataFrame:
    """(rec, lap_id, i, delta_s): of each lap, what the next one takes longer."""
    nxt = grid.select("rec", (F.col("lap_id") - 1).alias("lap_id"), "i", F.col("elapsed").alias("next"))
    return grid.join(nxt, [*LAP, "i"]).select(*LAP, "i", rounded(F.col("next") - F.col("elapsed"), 4).alias("delta_s"))


def ideal(grid: DataFrame) -> DataFrame:
    """(rec, i, ideal_s): at each place the least elapsed time of all laps, never falling."""
    least = grid.groupBy("rec", "i").agg(F.min("elapsed").alias("e"))
    return least.withColumn("ideal_s", F.max("e").over(along(REC, "i").rowsBetween(Window.unboundedPreceding, 0))).select("rec", "i", "ideal_s")


def to_ideal(grid: DataFrame) -> DataFrame:
    return grid.join(ideal(grid), ["rec", "i"]).select(*LAP, "i", rounded(F.col("elapsed") - F.col("ideal_s"), 4).alias("delta_s"))


def ideal_to_best(grid: DataFrame, baseline: DataFrame) -> DataFrame:
    """(rec, i, x_m, delta_s): the ideal lap of ``grid`` on the baseline's axis; where it is below 0 it is faster."""
    base = grid.join(baseline.select(*LAP), LAP, "left_semi").select("rec", "i", F.col("elapsed").alias("_e"), F.col("dist").alias("x_m"))
    return ideal(grid).join(base, ["rec", "i"]).select("rec", "i", "x_m", (F.col("ideal_s") - F.col("_e")).alias("delta_s"))


def ideal_total(grid: DataFrame, cells: int = CONFIG.grid) -> DataFrame:
    return ideal(grid).where(F.col("i") == cells - 1).select("rec", rounded("ideal_s", 4).alias("ideal_s"))


def ideal_gap(total: DataFrame, laps_: DataFrame) -> DataFrame:
    """(rec, best_s, ideal_s, gap_s): by how much the ideal lap beats the best one."""
    best = laps_.groupBy(*REC).agg(F.min("lap_s").alias("best_s"))
    return best.join(total, REC).select("rec", "best_s", "ideal_s", rounded(F.col("best_s") - F.col("ideal_s"), 4).alias("gap_s"))


def rebased(grid: DataFrame, reference: DataFrame) -> DataFrame:
    """Laps against a lap of another recording: ``reference`` (i, elapsed) is one lap on the same grid."""
    other = reference.select("i", F.col("elapsed").alias("base"))
    return grid.join(other, "i").select(*LAP, "i", rounded(F.col("elapsed") - F.col("base"), 4).alias("delta_s"))
