"""Corners' ends on each lap: scaled by distance, or found by place where a lap's length has drifted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .house import along, interp_join, united
from .laps import AROUND, AROUND_SHARE, MATCH_COS, MATCH_M, headed

REC, LAP, END = ["rec"], ["rec", "lap_id"], ["rec", "lap_id", "cid", "edge"]
#: Fixed value: the drift of a lap's length, against the best lap's, up to which ends are scaled.
DRIFT = 0.005


def ends(corners: DataFrame) -> DataFrame:
    """(rec, cid, edge, d): where corners begin (edge 0) and end (1) on the best lap."""
    both = F.array(F.struct(F.lit(0).alias("edge"), F.col("enter").alias("d")), F.struct(F.lit(1).alias("edge"), F.col("exit").alias("d")))
    return corners.select("rec", "cid", F.explode(both).alias("e")).select("rec", "cid", "e.*")


def _foot(a: str, b: str) -> tuple[Column, Column]:
    """(squared distance, dist) of the anchor's foot on the step from the sample with suffix ``a`` to that with ``b``."""
    at = lambda c, k: F.coalesce(F.col(c + k), F.col(c))
    vx, vy = at("x", b) - at("x", a), at("y", b) - at("y", a)
    l2 = vx * vx + vy * vy
    u = F.when(l2 > 0, F.least(F.greatest(((F.col("ax") - at("x", a)) * vx + (F.col("ay") - at("y", a)) * vy) / l2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return (at("x", a) + u * vx - F.col("ax")) ** 2 + (at("y", a) + u * vy - F.col("ay")) ** 2, at("dist", a) + u * (at("dist", b) - at("dist", a))


def by_place(asked: DataFrame, samples: DataFrame, best: DataFrame) -> DataFrame:
    """(rec, lap_id, cid, edge, found): for ends (rec, lap_id, cid, edge, d, scaled) of drifted laps, the distance at which the lap passes the place.

    The place is the best lap's at d.  Samples within AROUND_SHARE of the lap's samples
    (AROUND at least) of the scaled distance, of like heading, come into question; the
    nearest is refined on the steps beside it and must be within MATCH_M metres, else
    there is no row.  Ends meet samples by their number: an equi-join.
    """
    laps = asked.select(*LAP).distinct()
    own = headed(samples.join(laps, LAP, "left_semi")).where("n >= 2")
    ref = headed(samples.join(best.select(*LAP), LAP, "left_semi"))
    places = asked.select("rec", "cid", "edge", F.col("d").alias("dist")).distinct()
    anchor = interp_join(ref.select("rec", "dist", "x", "y", "hx", "hy"), places, REC, "dist", ["x", "y", "hx", "hy"])
    anchor = anchor.select("rec", "cid", "edge", *[F.col(c).alias(f"a{c}") for c in ("x", "y", "hx", "hy")])
    # The number of samples before the scaled distance: a sweep of samples and ends together.
    known = own.select(*LAP, "dist", F.lit(1).alias("_k"), F.lit(None).cast("int").alias("cid"), F.lit(None).cast("int").alias("edge"))
    both = united(known, asked.select(*LAP, F.col("scaled").alias("dist"), F.lit(0).alias("_k"), "cid", "edge"))
    before = F.sum("_k").over(along(LAP, "dist", "_k").rowsBetween(Window.unboundedPreceding, 0))
    centre = both.withColumn("c", before).where("_k = 0").select(*END, "c")
    centre = centre.join(own.groupBy(*LAP).agg(F.count("*").alias("m")), LAP)
    half = F.greatest(F.lit(AROUND), F.floor(F.col("m") * AROUND_SHARE))
    middle = F.least(F.col("c"), F.col("m") - 1)
    tries = centre.withColumn("i", F.explode(F.sequence(F.greatest(middle - half, F.lit(0)).cast("int"), F.least(middle + half, F.col("m") - 1).cast("int")))).join(anchor, ["rec", "cid", "edge"])
    w = along(LAP, "i")
    beside = {f"{c}{k}": f(c).over(w) for c in ("x", "y", "dist") for k, f in (("_", F.lag), ("__", F.lead))}
    met = tries.join(own.withColumns(beside).select(*LAP, "i", "x", "y", "dist", "hx", "hy", *beside), [*LAP, "i"]).where(F.col("ahx") * F.col("hx") + F.col("ahy") * F.col("hy") >= MATCH_COS)
    d2 = (F.col("x") - F.col("ax")) ** 2 + (F.col("y") - F.col("ay")) ** 2
    near = met.groupBy(*END).agg(F.min(F.struct(d2.alias("d2"), "i", "ax", "ay", "x", "y", "dist", *beside)).alias("p")).select(*END, "p.*")
    (lo, at_lo), (hi, at_hi) = _foot("_", ""), _foot("", "__")
    return near.where(F.least(lo, hi) <= MATCH_M**2).select(*END, F.when(lo <= hi, at_lo).otherwise(at_hi).alias("found"))


def projected(corners: DataFrame, samples: DataFrame, best: DataFrame, lengths: DataFrame) -> DataFrame:
    """(rec, lap_id, cid, edge, dist): corners' ends on each lap.

    A lap whose length is within DRIFT of the best one's (rec, length) is scaled; on others an
    end is where the lap passes its place, or scaled where it doesn't; ends never run backwards.
    """
    total = samples.groupBy(*LAP).agg(F.max("dist").alias("total"))
    base = total.join(lengths.select("rec", "length"), REC).join(ends(corners), REC).withColumn("scaled", F.col("d") * F.col("total") / F.col("length"))
    drifted = base.where(F.abs(F.col("total") - F.col("length")) / F.col("length") > DRIFT)
    found = by_place(drifted.select(*END, "d", "scaled"), samples, best)
    all_ = base.join(found, END, "left").withColumn("_p", F.least(F.greatest(F.coalesce("found", "scaled"), F.lit(0.0)), F.col("total")))
    return all_.select(*END, F.max("_p").over(along(LAP, "cid", "edge").rowsBetween(Window.unboundedPreceding, 0)).alias("dist"))


def windows(corners: DataFrame, samples: DataFrame, best: DataFrame, lengths: DataFrame) -> DataFrame:
    """(rec, lap_id, cid, enter, exit, total): each lap's corners in metres from its line, and its length."""
    at = projected(corners, samples, best, lengths)
    pair = at.groupBy(*LAP, "cid").agg(F.max(F.when(F.col("edge") == 0, F.col("dist"))).alias("enter"), F.max(F.when(F.col("edge") == 1, F.col("dist"))).alias("exit"))
    return pair.join(samples.groupBy(*LAP).agg(F.max("dist").alias("total")), LAP)
