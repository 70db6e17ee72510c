"""Timing lines: proposed, fitted, restored; and places, times and laps that lie nearest to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import laps as lp
from .house import along, interp_join, known_after, known_before, united

REC, LAP = ["rec"], ["rec", "lap_id"]
#: Half lengths of proposed lines, how far ahead headings look, and widenings tried.
MEDIAN_HALF_M, PEAK_HALF_M, AHEAD, AROUND = 5.0, 15.0, 20, 5
WIDER = (1.15, 1.3, 1.5)


def _across(x: Column, y: Column, hx: Column, hy: Column, half: float) -> Column:
    """A line of twice ``half`` through a point, across a heading; null without one."""
    n = F.sqrt(hx * hx + hy * hy)
    px, py = -hy / n * half, hx / n * half
    return F.when(n > 1e-6, F.struct((x - px).alias("x1"), (y - py).alias("y1"), (x + px).alias("x2"), (y + py).alias("y2")))


def median_line(trace: DataFrame) -> DataFrame:
    """(rec, line) across the trace at its middle fix."""
    w = along(REC, "seq")
    n = F.count("*").over(Window.partitionBy(*REC))
    t = trace.withColumns({"_i": F.row_number().over(w) - 1, "_n": n, "_hx": F.lead("x", AHEAD).over(w) - F.col("x"), "_hy": F.lead("y", AHEAD).over(w) - F.col("y")})
    return t.where(F.expr("_i = _n div 2")).select("rec", _across(F.col("x"), F.col("y"), F.col("_hx"), F.col("_hy"), MEDIAN_HALF_M).alias("line"))


def peak_line(trace: DataFrame) -> DataFrame:
    """(rec, line) across the trace where it is fastest, the first of equals; null with too few fixes."""
    w = along(REC, "seq")
    t = trace.withColumns({f"_{k}{c}": f(c, AROUND).over(w) for k, f in (("a", F.lag), ("b", F.lead)) for c in ("x", "y")})
    ends = {f"_{k}{c}": F.coalesce(f"_{k}{c}", c) for k in "ab" for c in ("x", "y")}
    top = t.withColumns(ends).groupBy(*REC).agg(F.min(F.struct((-F.col("v")).alias("v"), "seq", "x", "y", (F.col("_bx") - F.col("_ax")).alias("hx"), (F.col("_by") - F.col("_ay")).alias("hy"))).alias("p"), F.count("*").alias("n"))
    line = _across(F.col("p.x"), F.col("p.y"), F.col("p.hx"), F.col("p.hy"), PEAK_HALF_M)
    return top.select("rec", F.when(F.col("n") >= 2 * AROUND + 1, line).alias("line"))


def widened(line: Column, factor: float) -> Column:
    mx, my = (line["x1"] + line["x2"]) / 2, (line["y1"] + line["y2"]) / 2
    return F.struct(*[(m + (line[c] - m) * factor).alias(c) for m, c in ((mx, "x1"), (my, "y1"), (mx, "x2"), (my, "y2"))])


def fitted_line(trace: DataFrame, base: DataFrame) -> DataFrame:
    """(rec, line, factor, laps): the base line, or its first widening with more valid laps.

    Candidates are told apart by a suffix of the recording, so all are segmented in one plan.
    """
    tries = F.array(*[F.struct(F.lit(i).alias("try"), F.lit(float(f)).alias("factor"), widened(F.col("line"), f).alias("line")) for i, f in enumerate((1.0, *WIDER))])
    lines = base.where("line is not null").select("rec", F.explode(tries).alias("c")).select("rec", "c.*")
    many = trace.join(lines.select(F.col("rec"), "try"), REC).withColumn("rec", F.struct("rec", "try")).drop("try")
    found = lp.numbered(lp.line_crossings(many, lines.select(F.struct("rec", "try").alias("rec"), "line")))
    n = lp.valid(lp.laps(many, found)).groupBy("rec").agg(F.count("*").alias("laps")).select("rec.*", "laps")
    scored = lines.join(n, ["rec", "try"], "left").withColumn("laps", F.coalesce("laps", F.lit(0)))
    plain = scored.where("try = 0").select("rec", F.col("laps").alias("_b"))
    better = scored.join(plain, REC).where("try = 0 or laps > _b").withColumn("_w", F.col("try") > 0)
    best = better.groupBy(*REC).agg(F.min(F.struct((~F.col("_w")).alias("w"), "try", "factor", "line", "laps")).alias("b"))
    return best.select("rec", "b.line", "b.factor", "b.laps")


def suggested_sectors(samples: DataFrame, best: DataFrame, have: int) -> DataFrame:
    """(rec, line): the next sector line, across the best lap where it evens out the ``have`` there are."""
    share = (have + 1) / (have + 2)
    own = samples.join(best.select(*LAP), LAP, "left_semi")
    w = along(LAP, "t")
    t = own.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*LAP)), "_hx": F.lead("x", AROUND).over(w) - F.lag("x", AROUND).over(w), "_hy": F.lead("y", AROUND).over(w) - F.lag("y", AROUND).over(w)})
    return t.where(F.col("_i") == F.floor((F.col("_n") - 1) * share)).select("rec", _across(F.col("x"), F.col("y"), F.col("_hx"), F.col("_hy"), PEAK_HALF_M).alias("line"))


def restored(trace: DataFrame, saved: DataFrame, current: DataFrame) -> DataFrame:
    """(rec, line, reverted): saved lines, but the current one where the saved gives no valid lap."""
    found = lp.numbered(lp.line_crossings(trace, saved))
    n = lp.valid(lp.laps(trace, found)).groupBy(*REC).agg(F.count("*").alias("n"))
    both = current.select("rec", F.col("line").alias("_c")).join(saved.select("rec", "line"), REC, "left").join(n, REC, "left")
    good = F.coalesce(F.col("n") > 0, F.lit(False))
    return both.select("rec", F.when(good, F.col("line")).otherwise(F.col("_c")).alias("line"), (F.col("line").isNotNull() & ~good).alias("reverted"))


def index_at(times: DataFrame, trace: DataFrame) -> DataFrame:
    """``times`` (rec, t) with ``seq`` of the first fix at or after t, the last one beyond the end."""
    extra = [c for c in times.columns if c not in ("rec", "t")]
    known = trace.select("rec", "t", F.lit(1).alias("_k"), F.col("seq").alias("_s"), *[F.lit(None).cast(times.schema[c].dataType).alias(c) for c in extra])
    both = united(known, times.select("rec", "t", F.lit(0).alias("_k"), F.lit(None).cast("long").alias("_s"), *extra))
    both = both.withColumns({"_b": known_after("_s", REC, "t", "_k"), "_a": known_before("_s", REC, "t", "_k")}).where("_k = 0")
    return both.select("rec", "t", *extra, F.coalesce("_b", "_a").alias("seq"))


def locked_seek(times: DataFrame, samples: DataFrame) -> DataFrame:
    """(rec, lap_id, other, t, t_other): for times in a lap, when lap ``other`` is at the same share of its distance."""
    total = samples.groupBy(*LAP).agg(F.max("dist").alias("total"))
    a = interp_join(samples, times, LAP, "t", ["dist"]).join(total, LAP).withColumn("_share", F.col("dist") / F.col("total"))
    b = a.select("rec", F.col("lap_id").alias("_lap"), F.col("other").alias("lap_id"), F.col("t").alias("_t"), "_share").join(total, LAP).select("rec", "lap_id", (F.col("_share") * F.col("total")).alias("dist"), "_lap", "_t")
    return interp_join(samples, b, LAP, "dist", ["t"]).select("rec", F.col("_lap").alias("lap_id"), F.col("lap_id").alias("other"), F.col("_t").alias("t"), F.col("t").alias("t_other"))


def in_windows(rows: DataFrame, laps_: DataFrame) -> DataFrame:
    """The rows (rec, t) that lie in a valid lap, from its start to before its finish."""
    return lp.lap_at(rows, laps_).where("lap_id is not null").drop("lap_id")


def completions(measured: DataFrame) -> DataFrame:
    """``measured`` (rec, lap_no, ref_s) with the time at which each lap is done."""
    return measured.withColumn("done_s", F.sum("ref_s").over(along(REC, "lap_no").rowsBetween(Window.unboundedPreceding, 0)))


def pit_brackets(measured: DataFrame, least_s: float = 120.0) -> DataFrame:
    """``measured`` with the nearest lap before and after that takes ``least_s`` or more, as in a pit."""
    stop = F.when(F.col("ref_s") >= least_s, F.col("lap_no"))
    w = lambda *order: Window.partitionBy(*REC).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return measured.withColumns({"pit_before": F.last(stop, ignorenulls=True).over(w("lap_no")), "pit_after": F.last(stop, ignorenulls=True).over(w(F.desc("lap_no")))})


def same_line(a: Column, b: Column) -> Column:
    return sum((F.when(F.abs(a[c] - b[c]) < 1e-6, 0).otherwise(1) for c in ("x1", "y1", "x2", "y2")), F.lit(0)) == 0
