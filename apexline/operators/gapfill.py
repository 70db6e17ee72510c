"""Laps with holes, drawn as other laps went there.

A gap is a step of a lap that takes too long.  A gap of few missing fixes is a
cubic through its mouths.  A longer one borrows the way of another lap of the
recording, or of a reference line where no lap covers it: the donor's path between
the places nearest to both mouths, turned and scaled so that its ends meet them.
What was measured stays as it is.

Mouths and donors meet in cells that are as large as a donor may be off, so the
join is on cells; a path's length is a difference of running sums, and its points
are fetched by their numbers.  The work grows with gaps times laps of a
recording, as each lap may be the donor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CONFIG
from ..functions.scalars import rounded
from .house import along, united
from .shape import hermite

LAP, GAP = ["rec", "lap_id"], ["rec", "lap_id", "i"]
#: Missing fixes up to which a gap is a curve, how far a donor may be off (share of the chord, metres at least), and its length to the chord's.
FEW, OFF_SHARE, OFF_M, SHORTEST, LONGEST = 3, 0.25, 5.0, 0.4, 3.0


def numbered(samples: DataFrame) -> DataFrame:
    """(rec, lap_id, i, t, x, y, s): samples by their number in the lap from 0, and the length of the line up to each."""
    w = along(LAP, "t", "dist")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    s = samples.withColumns({"i": F.row_number().over(w) - 1, "_d": F.coalesce(step, F.lit(0.0))})
    return s.select(*LAP, "i", "t", "x", "y", F.sum("_d").over(along(LAP, "i").rowsBetween(Window.unboundedPreceding, 0)).alias("s"))


def gaps(points: DataFrame) -> DataFrame:
    """(rec, lap_id, i, t0, dt, missing, a, b, before, after, chord): the long steps of numbered laps of three samples and more; i is the sample before.

    ``a`` and ``b`` are the mouths, ``before`` and ``after`` the samples beside them (the mouths themselves at a lap's ends).
    """
    w = along(LAP, "i")
    at = F.struct("x", "y")
    s = points.withColumns({"_t": F.lead("t").over(w), "_p": F.coalesce(F.lag(at).over(w), at), "_n": F.lead(at).over(w), "_m": F.coalesce(F.lead(at, 2).over(w), F.lead(at).over(w)), "_k": F.count("*").over(Window.partitionBy(*LAP))})
    s = s.withColumn("dt", F.col("_t") - F.col("t"))
    usual = F.median(F.when((F.col("dt") > 0) & (F.col("dt") <= CONFIG.dropout_s), F.col("dt"))).over(Window.partitionBy(*LAP))
    s = s.withColumn("_u", F.greatest(F.coalesce(usual, F.lit(0.1)), F.lit(1e-3))).where((F.col("dt") > CONFIG.dropout_s) & (F.col("_k") >= 3))
    missing = F.greatest(F.bround(F.col("dt") / F.col("_u")) - 1, F.lit(1.0)).cast("int")
    chord = F.sqrt((F.col("_n.x") - F.col("x")) ** 2 + (F.col("_n.y") - F.col("y")) ** 2)
    return s.select(*GAP, F.col("t").alias("t0"), "dt", missing.alias("missing"), at.alias("a"), F.col("_n").alias("b"), F.col("_p").alias("before"), F.col("_m").alias("after"), chord.alias("chord"))


def donors(points: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(rec, ref, donor, k, x, y, s): lines to borrow from, of three points and more: laps, and a reference line (rec, k, x, y)."""
    own = points.select("rec", F.lit(False).alias("ref"), F.col("lap_id").alias("donor"), F.col("i").alias("k"), "x", "y", "s")
    if reference is not None:
        w = along(["rec"], "k")
        step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
        line = reference.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        own = united(own, line.select("rec", F.lit(True).alias("ref"), F.lit(-1).cast("long").alias("donor"), F.col("k").cast("int").alias("k"), "x", "y", "s"))
    return own.withColumn("_n", F.count("*").over(Window.partitionBy("rec", "ref", "donor"))).where("_n >= 3").drop("_n")


def matched(gaps_: DataFrame, donors_: DataFrame) -> DataFrame:
    """(rec, lap_id, i, ref, donor, ka, kb, pa, pb, error): the line that each gap of many missing fixes borrows from, if any does.

    It is the lap, or else the reference, whose ends are nearest to the mouths; of equal ones the first.
    """
    off = F.greatest(OFF_SHARE * F.col("chord"), F.lit(OFF_M))
    wide = gaps_.where(F.col("missing") > FEW).withColumns({"_off": off, "_level": F.ceil(F.log2(off)).cast("int")})
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    mouth = F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("a.x").alias("x"), F.col("a.y").alias("y")), F.struct(F.lit(1).alias("e"), F.col("b.x").alias("x"), F.col("b.y").alias("y"))))
    mouths = wide.select(*GAP, "chord", "_off", "_level", mouth.alias("m")).select(*GAP, "chord", "_off", "_level", "m.e", F.col("m.x").alias("mx"), F.col("m.y").alias("my"))
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    mouths = mouths.withColumn("_cx", F.explode(F.transform(around, lambda d: cell(F.col("mx")) + d))).withColumn("_cy", F.explode(F.transform(around, lambda d: cell(F.col("my")) + d)))
    levels = wide.select("rec", "_level").distinct()
    placed = donors_.join(levels, ["rec"]).withColumns({"_cx": cell(F.col("x")), "_cy": cell(F.col("y"))})
    both = mouths.join(placed, ["rec", "_level", "_cx", "_cy"]).where("ref or donor <> lap_id")
    d2 = (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2
    near = both.where(d2 <= F.col("_off") ** 2).groupBy(*GAP, "chord", "ref", "donor").agg(*[F.min(F.when(F.col("e") == e, F.struct(d2.alias("d2"), "k", "s", "x", "y"))).alias(n) for e, n in ((0, "na"), (1, "nb"))])
    ratio = F.abs(F.col("nb.s") - F.col("na.s")) / F.greatest("chord", F.lit(1e-6))
    fits = near.where((F.col("na.k") != F.col("nb.k")) & ratio.between(SHORTEST, LONGEST)).withColumn("error", F.sqrt(F.greatest("na.d2", "nb.d2")))
    best = fits.groupBy(*GAP).agg(F.min(F.struct("ref", rounded("error", 9).alias("_e"), "donor", "error", "na", "nb")).alias("b"))
    return best.select(*GAP, "b.ref", "b.donor", F.col("b.na.k").alias("ka"), F.col("b.nb.k").alias("kb"), F.struct("b.na.x", "b.na.y").alias("pa"), F.struct("b.nb.x", "b.nb.y").alias("pb"), "b.error")


def _laid(c: str, px: Column, py: Column) -> Column:
    """The place of a donor's point when its ends are laid on the mouths, by the similarity that does so (a straight line where both ends are one place)."""
    dx, dy = F.col("pb.x") - F.col("pa.x"), F.col("pb.y") - F.col("pa.y")
    ex, ey = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    size = dx * dx + dy * dy
    re, im = (ex * dx + ey * dy) / size, (ey * dx - ex * dy) / size
    ux, uy = px - F.col("pa.x"), py - F.col("pa.y")
    turned, straight = (re * ux - im * uy, ex) if c == "x" else (im * ux + re * uy, ey)
    start = F.col(f"a.{c}")
    inside = F.when(size < 1e-18, start + straight * F.col("j") / F.col("n")).otherwise(start + turned)
    return F.when(F.col("j") == 0, start).when(F.col("j") == F.col("n"), F.col(f"b.{c}")).otherwise(inside)


def filled(points: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(rec, lap_id, i, j, n, t, x, y, source, donor, error): the points that fill each gap; 0 and n are its mouths.

    ``source`` is curve, borrowed, reference, or uncovered (a curve where nothing covers the gap).
    """
    g = gaps(points)
    lines = donors(points, reference)
    m = matched(g, lines)
    # The points of the borrowed path, by their numbers.
    path = g.join(m, GAP).withColumn("n", F.abs(F.col("kb") - F.col("ka"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n"))))
    path = path.withColumn("k", F.col("ka") + F.signum(F.col("kb") - F.col("ka")).cast("int") * F.col("j"))
    path = path.join(lines.select("rec", "ref", "donor", "k", F.col("x").alias("_x"), F.col("y").alias("_y")), ["rec", "ref", "donor", "k"])
    when = F.col("t0") + F.col("dt") * F.col("j") / F.col("n")
    borrowed = path.select(*GAP, "j", "n", when.alias("t"), _laid("x", F.col("_x"), F.col("_y")).alias("x"), _laid("y", F.col("_x"), F.col("_y")).alias("y"), F.when(F.col("ref"), "reference").otherwise("borrowed").alias("source"), F.when(~F.col("ref"), F.col("donor")).alias("donor"), "error")
    left = g.join(m.select(*GAP), GAP, "left_anti").withColumn("n", F.col("missing") + 1).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n"))))
    curve = lambda c: hermite(*[F.col(f"{p}.{c}") for p in ("before", "a", "b", "after")], F.col("j") / F.col("n"))
    curved = left.select(*GAP, "j", "n", when.alias("t"), curve("x").alias("x"), curve("y").alias("y"), F.when(F.col("missing") <= FEW, "curve").otherwise("uncovered").alias("source"), F.lit(None).cast("long").alias("donor"), F.lit(0.0).alias("error"))
    return united(borrowed, curved)


def report(points: DataFrame, filled_: DataFrame) -> DataFrame:
    """(rec, lap_id, i, dt, missing, chord_m, source, donor, fill_m, error_m): each gap and what fills it."""
    w = along(GAP, "j")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    of = filled_.withColumn("_d", F.coalesce(step, F.lit(0.0))).groupBy(*GAP).agg(F.first("source").alias("source"), F.first("donor").alias("donor"), F.sum("_d").alias("fill_m"), F.first("error").alias("error_m"))
    return gaps(points).select(*GAP, "dt", "missing", F.col("chord").alias("chord_m")).join(of, GAP).select(*GAP, "dt", "missing", "chord_m", "source", "donor", "fill_m", "error_m")


def drawn(points: DataFrame, filled_: DataFrame) -> DataFrame:
    """(rec, lap_id, i, j, t, x, y, source): the lap's measured samples (j = 0) and, after those before gaps, the points that fill them."""
    measured = points.select(*GAP, F.lit(0).alias("j"), "t", "x", "y", F.lit("measured").alias("source"))
    return united(measured, filled_.where("j > 0 and j < n").select(*GAP, "j", "t", "x", "y", "source"))


def totals(report_: DataFrame) -> DataFrame:
    """(rec, source, gaps, fill_m, worst_m): how much was filled from where, and how far donors' ends were off at most."""
    return report_.groupBy("rec", "source").agg(F.count("*").alias("gaps"), F.sum("fill_m").alias("fill_m"), F.max("error_m").alias("worst_m"))
