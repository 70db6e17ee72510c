"""Timing lines that are edited: a table of versions, undo, and laps cut anew only where lines changed.

A history has a row for each version of a recording's lines: (rec, version, line, sectors,
confirmed), ``line`` and each of ``sectors`` a struct (x1, y1, x2, y2).  The last version holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import laps as lp
from ..functions.scalars import rounded
from .house import along, united
from .lines import same_line

REC = ["rec"]
#: Fixed value: versions before the current one that are kept.
DEPTH = 32
#: Edited recordings that a filter names.
NAMED = 1000
ENDS = "struct<x1: double, y1: double, x2: double, y2: double>"
HISTORY = f"version long, line {ENDS}, sectors array<{ENDS}>, confirmed boolean"


def current(history: DataFrame) -> DataFrame:
    """(rec, version, line, sectors, confirmed): the version that holds."""
    return history.groupBy(*REC).agg(F.max_by(F.struct("version", "line", "sectors", "confirmed"), "version").alias("c")).select("rec", "c.*")


def edited(history: DataFrame, edits: DataFrame) -> DataFrame:
    """The history after ``edits`` (rec, line, sectors, confirmed), one for a recording, as new versions; the oldest beyond DEPTH go.

    An edit that leaves everything as it is makes no version.
    """
    now = current(history).select("rec", F.col("version").alias("_v"), F.struct("line", "sectors", "confirmed").alias("_now"))
    new = edits.join(now, REC, "left").where(~F.col("_now").eqNullSafe(F.struct("line", "sectors", "confirmed")))
    both = united(history.select("rec", "version", "line", "sectors", "confirmed"), new.select("rec", (F.coalesce("_v", F.lit(-1)) + 1).cast("long").alias("version"), "line", "sectors", "confirmed"))
    place = F.row_number().over(Window.partitionBy(*REC).orderBy(F.desc("version")))
    return both.withColumn("_p", place).where(F.col("_p") <= DEPTH + 1).drop("_p")


def undoable(history: DataFrame) -> DataFrame:
    """(rec, steps): how often each recording's lines can be set back."""
    return history.groupBy(*REC).agg((F.count("*") - 1).alias("steps"))


def undone(history: DataFrame, recs: DataFrame, trace: DataFrame) -> DataFrame:
    """The history without the last version of ``recs`` (rec), where the version before gives a valid lap of ``trace``.

    Where it gives none, or there is none, the recording's history stays as it is, so that
    nothing is lost by going back to lines that don't fit.
    """
    place = F.row_number().over(Window.partitionBy(*REC).orderBy(F.desc("version")))
    ranked = history.withColumn("_p", place)
    before = ranked.where("_p = 2").join(recs.select("rec").distinct(), REC, "left_semi").select("rec", "line")
    good = fitting(trace, before).withColumn("_ok", F.lit(True))
    return ranked.join(good, REC, "left").where("_p > 1 or _ok is null").select(*history.columns)


def fitting(trace: DataFrame, lines: DataFrame) -> DataFrame:
    """(rec): recordings whose lines (rec, line) give a valid lap; only their fixes are read."""
    own = trace.join(lines.select("rec").distinct(), REC, "left_semi")
    return lp.valid(lp.laps(own, lp.numbered(lp.line_crossings(own, lines)))).select("rec").distinct()


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(same_line(a, b), F.lit(False))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rec): recordings whose start line in ``after`` isn't that of ``before`` (rec, line), or that ``before`` hasn't."""
    old = before.select("rec", F.col("line").alias("_old"))
    return after.select("rec", "line").join(old, REC, "left").where(F.col("_old").isNull() | ~_same(F.col("line"), F.col("_old"))).select("rec")


def recut(trace: DataFrame, crossings: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Crossings (rec, seq, lap_id, t_cross, ...) of the lines ``after`` from those of the lines ``before``.

    Recordings whose line is the same keep theirs; only the others' fixes are read: up to NAMED of them
    are named in the filter, so that of a trace that is partitioned by ``rec`` no other files are
    opened; more are met by a join.
    """
    moved = changed(before, after)
    named = [r.rec for r in moved.limit(NAMED + 1).collect()]  # NAMED + 1 keys
    own = trace.where(F.col("rec").isin(named)) if len(named) <= NAMED else trace.join(moved, REC, "left_semi")
    cols = ["rec", "seq", "lap_id", "t_cross"]
    new = lp.numbered(lp.line_crossings(own, after.select("rec", "line").join(moved, REC, "left_semi"))).select(*cols)
    kept = crossings.join(moved, REC, "left_anti").join(after.select("rec"), REC, "left_semi").select(*cols)
    return united(kept, new)


def steps(history: DataFrame) -> DataFrame:
    """(rec, version, moved_m): how far a version's start line lies from the one before, by its middle."""
    mid = lambda c: (F.col(f"line.{c}1") + F.col(f"line.{c}2")) / 2
    w = along(REC, "version")
    h = history.withColumns({"_x": mid("x"), "_y": mid("y")})
    return h.select("rec", "version", rounded(F.sqrt((F.col("_x") - F.lag("_x").over(w)) ** 2 + (F.col("_y") - F.lag("_y").over(w)) ** 2), 4).alias("moved_m"))
