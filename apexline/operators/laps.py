"""Laps and sectors: where a trace crosses its timing line, and what lies between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CONFIG
from ..functions.scalars import crosses, rounded
from .house import along, interp_join, united

REC, LAP = ["rec"], ["rec", "lap_id"]
#: How near sector lines may be, and where a place of a lap is looked for in the next.
SECTOR_GAP, AROUND, AROUND_SHARE, MATCH_COS, MATCH_M = 0.002, 5, 0.02, 0.5, 3.0


def line_crossings(trace: DataFrame, lines: DataFrame) -> DataFrame:
    """(rec, seq, t_cross, x, y, v): steps of the trace that straddle the recording's line (rec, line).

    ``lines`` has a row for each recording.  Any direction counts; touching the line doesn't.
    """
    w = along(REC, "seq")
    s = trace.join(lines, REC).withColumns({c + "0": F.lag(c).over(w) for c in ("x", "y", "t", "v")})
    hit, r = crosses(F.col("x0"), F.col("y0"), F.col("x"), F.col("y"), F.col("line"))
    at = lambda c: F.col(c + "0") + (F.col(c) - F.col(c + "0")) * r
    return s.where(hit).select("rec", "seq", rounded(at("t"), 3).alias("t_cross"), at("x").alias("x"), at("y").alias("y"), at("v").alias("v"))


def sector_crossings(trace: DataFrame, starts: DataFrame, sectors: DataFrame) -> DataFrame:
    """(rec, n, line, seq, t_cross): crossings in the order start, S1, ..., Sn, start, ...; line 0 is the start.

    Of all lines only the next one counts, from the step after the last that counted.  ``starts`` is
    (rec, line), ``sectors`` (rec, sector, line) with sectors from 1.  What counts depends on what did
    before, so it is a fold over a recording's crossings, which are a few for each lap.
    """
    lines = united(starts.select("rec", F.lit(0).alias("no"), "line"), sectors.select("rec", F.col("sector").cast("int").alias("no"), "line"))
    many = trace.join(lines.select("rec", "no"), REC).withColumn("rec", F.struct("rec", "no")).drop("no")
    met = line_crossings(many, lines.select(F.struct("rec", "no").alias("rec"), "line")).select("rec.*", "seq", "t_cross")
    count = sectors.groupBy(*REC).agg((F.count("*") + 1).cast("int").alias("k"))
    all_ = met.groupBy(*REC).agg(F.sort_array(F.collect_list(F.struct("seq", "no", "t_cross"))).alias("c")).join(count, REC)
    none = F.expr("cast(array() as array<struct<seq: bigint, no: int, t_cross: double>>)")
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1))["seq"], F.lit(-1))
    keep = lambda done, c: F.when((c["no"] == F.size(done) % F.col("k")) & (c["seq"] > last(done)), F.concat(done, F.array(c))).otherwise(done)
    return all_.select("rec", F.posexplode(F.aggregate("c", none, keep)).alias("n", "c")).select("rec", "n", F.col("c.no").alias("line"), "c.seq", "c.t_cross")


def numbered(crossings: DataFrame) -> DataFrame:
    """Crossings with ``lap_id`` in their order, if they come without."""
    return crossings.withColumn("lap_id", (F.row_number().over(along(REC, "seq")) - 1).cast("long"))


def laps(trace: DataFrame, crossings: DataFrame) -> DataFrame:
    """(rec, lap_id, t_start, t_finish, lap_s, samples, dist_m, max_dt, v_max, v_min): complete laps.

    A crossing opens a lap and closes the one before; what comes before the first
    and after the last is no lap.  A lap's samples are its fixes and both crossings.
    """
    w = along(REC, "lap_id")
    whole = crossings.select("rec", "lap_id", F.col("t_cross").alias("t_start"), F.lead("t_cross").over(w).alias("t_finish")).where("t_finish is not null")
    inner = lap_samples(trace, crossings).groupBy(*LAP).agg(F.count_if("inner").alias("n"), F.max("dist").alias("dist_m"), F.max("dt").alias("max_dt"), F.max(F.when(F.col("inner"), F.col("v"))).alias("v_max"), F.min(F.when(F.col("inner"), F.col("v"))).alias("v_min"))
    out = whole.join(inner, LAP)
    return out.select(*LAP, "t_start", "t_finish", rounded(F.col("t_finish") - F.col("t_start"), 3).alias("lap_s"), (F.col("n") + 2).alias("samples"), rounded("dist_m", 3).alias("dist_m"), rounded("max_dt", 3).alias("max_dt"), "v_max", "v_min")


def lap_samples(trace: DataFrame, crossings: DataFrame) -> DataFrame:
    """(rec, lap_id, t, elapsed, dist, v, x, y, dt, inner): fixes of complete laps and their two crossings, from 0.

    The lap of a fix is the number of crossings before it: crossings and fixes
    are united and swept once, with no join on times.
    """
    w = along(REC, "seq", "kind")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    t_of = crossings.select("rec", "seq", "lap_id", "t_cross")
    cols = ["t", "odo", "v", "x", "y"]
    fixes = trace.select("rec", "seq", *cols, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("lap_id"))
    prev = along(REC, "seq")
    # A crossing's values lie between the fix it is found at and the one before.
    joined = trace.withColumns({c + "0": F.lag(c).over(prev) for c in cols}).join(t_of, ["rec", "seq"])
    share = (F.col("t_cross") - F.col("t0")) / (F.col("t") - F.col("t0"))
    at = lambda c: F.col(c + "0") + (F.col(c) - F.col(c + "0")) * share
    cuts = joined.select("rec", "seq", F.col("t_cross").alias("t"), *[at(c).alias(c) for c in cols[1:]], F.lit(0).alias("kind"), "lap_id")
    all_ = united(fixes, cuts)
    all_ = all_.withColumn("lap", F.last("lap_id", ignorenulls=True).over(before))
    ends = cuts.where("lap_id > 0").withColumn("lap", F.col("lap_id") - 1).withColumn("kind", F.lit(2))
    closed = Window.partitionBy("rec", "lap")
    both = united(all_.where("lap is not null"), ends).withColumn("_done", F.count_if(F.col("kind") == 2).over(closed)).where("_done > 0")
    first = along(["rec", "lap"], "t", "kind")
    run = first.rowsBetween(Window.unboundedPreceding, 0)
    return both.select(
        "rec", F.col("lap").alias("lap_id"), "t", (F.col("t") - F.first("t").over(run)).alias("elapsed"), (F.col("odo") - F.first("odo").over(run)).alias("dist"),
        "v", "x", "y", (F.col("t") - F.lag("t").over(first)).alias("dt"), (F.col("kind") == 1).alias("inner"),
    )


def swept(trace: DataFrame, line: Column) -> DataFrame:
    """:func:`lap_samples` of the crossings of ``line`` (a struct of each fix's recording), found and cut in one sweep by recording.

    A crossing is a step's own two rows: the finish of the lap before and the start of its
    own.  All windows are by recording, or by recording and lap, so a trace that is dealt by recording isn't dealt anew.
    """
    w = along(REC, "seq")
    cols = ["t", "odo", "v", "x", "y"]
    s = trace.select("rec", "seq", *[F.col(c).cast("double").alias(c) for c in cols], line.alias("_line")).withColumns({f"{c}0": F.lag(c).over(w) for c in cols})
    hit, r = crosses(F.col("x0"), F.col("y0"), F.col("x"), F.col("y"), F.col("_line"))
    s = s.withColumns({"_hit": F.coalesce(hit, F.lit(False)), "_at": rounded(F.col("t0") + (F.col("t") - F.col("t0")) * r, 3)})
    s = s.withColumn("_g", F.sum(F.col("_hit").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.max("_g").over(Window.partitionBy(*REC)))
    share = (F.col("_at") - F.col("t0")) / (F.col("t") - F.col("t0"))
    cut = [F.col("_at").alias("t"), *[(F.col(f"{c}0") + (F.col(c) - F.col(f"{c}0")) * share).alias(c) for c in cols[1:]]]
    row = lambda lap, kind, values: F.struct(lap.alias("lap_id"), F.lit(kind).alias("kind"), *values)
    fix = row(F.col("_g") - 1, 1, [F.col(c) for c in cols])
    rows = F.when(F.col("_hit"), F.array(row(F.col("_g") - 2, 2, cut), row(F.col("_g") - 1, 0, cut), fix)).otherwise(F.array(fix))
    whole = s.select("rec", "_all", F.explode(rows).alias("r")).select("rec", "_all", "r.*").where("lap_id >= 0 and lap_id <= _all - 2")
    order = along(LAP, "t", "kind")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    return whole.select(
        "rec", "lap_id", "t", (F.col("t") - F.first("t").over(run)).alias("elapsed"), (F.col("odo") - F.first("odo").over(run)).alias("dist"),
        "v", "x", "y", (F.col("t") - F.lag("t").over(order)).alias("dt"), (F.col("kind") == 1).alias("inner"),
    )


def facts(samples: DataFrame) -> DataFrame:
    """What :func:`laps` says of laps, from their samples: one grouping."""
    inner = lambda c: F.when(F.col("inner"), F.col(c))
    a = samples.groupBy(*LAP).agg(F.min("t").alias("t_start"), F.max("t").alias("t_finish"), F.count_if("inner").alias("n"), F.max("dist").alias("d"), F.max("dt").alias("m"), F.max(inner("v")).alias("v_max"), F.min(inner("v")).alias("v_min"))
    return a.select(*LAP, "t_start", "t_finish", rounded(F.col("t_finish") - F.col("t_start"), 3).alias("lap_s"), (F.col("n") + 2).alias("samples"), rounded("d", 3).alias("dist_m"), rounded("m", 3).alias("max_dt"), "v_max", "v_min")


def valid(laps_: DataFrame) -> DataFrame:
    """Laps with enough samples and time, in the band of the median time, and then of the median distance of those."""
    enough = laps_.where((F.col("samples") >= CONFIG.lap_samples_min) & (F.col("lap_s") >= CONFIG.lap_time_min_s))
    all_ = Window.partitionBy(*REC)
    lo, hi = CONFIG.lap_time_band
    timed = enough.withColumn("_m", F.median("lap_s").over(all_)).where((F.col("lap_s") >= lo * F.col("_m")) & (F.col("lap_s") <= hi * F.col("_m")))
    lo, hi = CONFIG.lap_distance_band
    return timed.withColumn("_m", F.median("dist_m").over(all_)).where((F.col("dist_m") >= lo * F.col("_m")) & (F.col("dist_m") <= hi * F.col("_m"))).drop("_m")


def excluded(laps_: DataFrame) -> DataFrame:
    """Substantial laps that aren't valid."""
    enough = laps_.where((F.col("samples") >= CONFIG.lap_samples_min) & (F.col("lap_s") >= CONFIG.lap_time_min_s))
    return enough.join(valid(laps_).select(*LAP), LAP, "left_anti")


def with_dropout(laps_: DataFrame) -> DataFrame:
    return laps_.withColumn("dropout", F.col("max_dt") > CONFIG.dropout_s)


def clean(laps_: DataFrame) -> DataFrame:
    return with_dropout(valid(laps_)).where("not dropout")


def candidates(laps_: DataFrame) -> DataFrame:
    """Valid laps without dropouts, or all valid ones of a recording that has no such lap."""
    marked = with_dropout(valid(laps_)).withColumn("_n", F.count_if(~F.col("dropout")).over(Window.partitionBy(*REC)))
    return marked.where("not dropout or _n = 0").drop("_n")


def best(laps_: DataFrame) -> DataFrame:
    """(rec, lap_id, lap_s): the fastest candidate, the first of equals."""
    return candidates(laps_).groupBy(*REC).agg(F.min(F.struct("lap_s", "lap_id")).alias("b")).select("rec", "b.lap_id", "b.lap_s")


def lap_table(laps_: DataFrame) -> DataFrame:
    """Valid laps with their distance from the best time."""
    return valid(laps_).select(*LAP, "lap_s", "samples", "dist_m", rounded(F.col("lap_s") - F.min("lap_s").over(Window.partitionBy(*REC)), 3).alias("delta_s"))


def capped(laps_: DataFrame, most: int) -> DataFrame:
    """The ``most`` fastest laps of a recording, ties by lap."""
    return laps_.withColumn("_r", F.row_number().over(along(REC, "lap_s", "lap_id"))).where(F.col("_r") <= most).drop("_r")


def lap_at(times: DataFrame, laps_: DataFrame) -> DataFrame:
    """``times`` (rec, t) with the valid lap that is on at t, if any: a sweep, since laps follow each other."""
    w = along(REC, "t", "_k")
    starts = valid(laps_).select("rec", F.col("t_start").alias("t"), F.lit(0).alias("_k"), F.struct("lap_id", "t_finish").alias("_l"))
    extra = [c for c in times.columns if c not in ("rec", "t")]
    both = united(starts.select("rec", "t", "_k", "_l", *[F.lit(None).cast(times.schema[c].dataType).alias(c) for c in extra]), times.select("rec", "t", F.lit(1).alias("_k"), F.lit(None).cast(starts.schema["_l"].dataType).alias("_l"), *extra))
    both = both.withColumn("_l", F.last("_l", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_k = 1")
    return both.select("rec", "t", *extra, F.when(F.col("t") < F.col("_l.t_finish"), F.col("_l.lap_id")).alias("lap_id"))


def sector_places(samples: DataFrame, sectors: DataFrame) -> DataFrame:
    """(rec, lap_id, sector, dist): where each lap passes nearest to the middle of each sector line (rec, line), in order.

    A line nearer than SECTOR_GAP of the lap to the one kept before is left out; that
    depends on what was kept, so it is a fold over a lap's few lines.
    """
    middle = sectors.select("rec", ((F.col("line.x1") + F.col("line.x2")) / 2).alias("_mx"), ((F.col("line.y1") + F.col("line.y2")) / 2).alias("_my"))
    d2 = (F.col("x") - F.col("_mx")) ** 2 + (F.col("y") - F.col("_my")) ** 2
    near = samples.join(middle, REC).groupBy(*LAP, "_mx", "_my").agg(F.min(F.struct(d2.alias("d2"), "dist")).alias("p"), F.max("dist").alias("total"))
    rows = near.groupBy(*LAP).agg(F.sort_array(F.collect_list("p.dist")).alias("s"), F.max("total").alias("total"))
    keep = lambda done, d: F.when((F.size(done) == 0) | (d - F.try_element_at(done, F.lit(-1)) > SECTOR_GAP * F.col("total")), F.concat(done, F.array(d))).otherwise(done)
    return rows.select(*LAP, F.posexplode(F.aggregate("s", F.expr("cast(array() as array<double>)"), keep)).alias("sector", "dist"))


def splits(samples: DataFrame, sectors: DataFrame) -> DataFrame:
    """(rec, lap_id, sector, split_s): times between the sector lines (rec, line), by the places where a lap passes them; they sum to the lap's time."""
    total = samples.groupBy(*LAP).agg(F.max("dist").alias("total"))
    inner = sector_places(samples, sectors)
    ends = total.select(*LAP, F.explode(F.array(F.lit(0.0), F.col("total"))).alias("dist"))
    grid = united(inner.select(*LAP, "dist", F.lit(1).alias("edge")), ends.select(*LAP, "dist", F.when(F.col("dist") == 0, 0).otherwise(2).alias("edge")))
    at = interp_join(samples, grid, LAP, "dist", ["elapsed"])
    w = along(LAP, "dist", "edge")
    at = at.withColumns({"sector": F.row_number().over(w) - 1, "next": F.lead("elapsed").over(w)})
    return at.where("next is not null").select(*LAP, "sector", rounded(F.col("next") - F.col("elapsed"), 4).alias("split_s"))


def best_splits(splits_: DataFrame) -> DataFrame:
    return splits_.where("split_s > 0").groupBy("rec", "sector").agg(F.min("split_s").alias("best_s"))


def theoretical(splits_: DataFrame) -> DataFrame:
    """The sum of the best splits; null unless every sector has one."""
    n = splits_.select("rec", "sector").distinct().groupBy("rec").agg(F.count("*").alias("n"))
    b = best_splits(splits_).groupBy("rec").agg(F.sum("best_s").alias("s"), F.count("*").alias("k"))
    return n.join(b, REC, "left").select("rec", rounded(F.when(F.col("n") == F.col("k"), F.col("s")), 4).alias("theoretical_s"))


def headed(samples: DataFrame) -> DataFrame:
    """Samples with their number ``i`` in the lap from 0, ``n``, the ``share`` of the distance, and the unit direction of travel (0 where it stands)."""
    w, all_ = along(LAP, "t", "dist"), Window.partitionBy(*LAP)
    s = samples.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(all_), "share": F.col("dist") / F.max("dist").over(all_), "_gx": _steps("x"), "_gy": _steps("y")})
    size = F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2)
    unit = lambda c: F.when(size > 0, F.col(c) / size).otherwise(0.0)
    return s.withColumns({"hx": unit("_gx"), "hy": unit("_gy")}).drop("_gx", "_gy")


def _steps(c: str) -> Column:
    """Change from the sample before to the one after, halved inside."""
    w = along(LAP, "t", "dist")
    a, b = F.lag(c).over(w), F.lead(c).over(w)
    return F.when(a.isNull(), b - F.col(c)).when(b.isNull(), F.col(c) - a).otherwise((b - a) / 2)


def rolling_best(samples: DataFrame, laps_: DataFrame) -> DataFrame:
    """(rec, rolling_s): the fastest loop from any place of a lap to the same place of the next, or the best lap.

    Both laps are valid and without dropouts.  A sample of the first meets those of the second that are
    within AROUND samples of its share of the distance, of like direction; the nearest is refined on
    the steps beside it, and must be within MATCH_M metres.  They meet in blocks of sample numbers that are as wide as
    what a sample meets, so it is an equi-join in which one of the first is in one block, and one of the second in two.
    """
    ok = clean(laps_).select(*LAP)
    s = headed(samples.join(ok, LAP, "left_semi")).where("n >= 2")
    half = lambda n: F.greatest(F.lit(AROUND), F.floor(F.col(n) * AROUND_SHARE)).cast("int")
    # The steps beside what a sample meets are in its block too.
    block = lambda i, n: F.floor(i / (2 * half(n) + 3)).cast("int")
    # The first sample of the second lap at or beyond an anchor's share: a sweep of the second lap, for which each sample is one of its own (k 0) and the next lap's anchor (k -1).
    roles = F.explode(F.array(F.struct((F.col("lap_id") + 1).alias("second"), F.lit(-1).alias("k")), F.struct(F.col("lap_id").alias("second"), F.lit(0).alias("k"))))
    own = [F.when(F.col("_r.k") == -1, F.col(c)).alias(n) for c, n in (("i", "i"), ("t", "at"), ("x", "ax"), ("y", "ay"), ("hx", "ahx"), ("hy", "ahy"))]
    both = s.select("*", roles.alias("_r")).select("rec", F.col("_r.second").alias("lap_id"), F.col("_r.k").alias("k"), "share", *own)
    later = F.count_if(F.col("k") == 0)
    both = both.withColumns({"c": later.over(along(LAP, "share", "k").rowsBetween(Window.unboundedPreceding, 0)), "m": later.over(Window.partitionBy(*LAP))})
    anchors = both.where("k = -1 and m > 0").withColumn("middle", F.least(F.col("c"), F.col("m") - 1).cast("int"))
    anchors = anchors.select(*LAP, "i", "middle", half("m").alias("half"), block(F.col("middle"), "m").alias("block"), "at", "ax", "ay", "ahx", "ahy")
    first, last = F.greatest(F.col("i") - half("n") - 1, F.lit(0)), F.least(F.col("i") + half("n") + 1, F.col("n") - 1)
    other = s.select(*LAP, F.col("i").alias("j"), "x", "y", "t", "hx", "hy", F.explode(F.sequence(block(first, "n"), block(last, "n"))).alias("block"))
    w = along([*LAP, "block"], "j")
    # Dealt by block before its steps are laid beside it, or they would be shuffled with it.
    other = other.repartition(*LAP, "block").withColumns({f"{c}{k}": f(c).over(w) for c in ("x", "y", "t", "hx", "hy") for k, f in (("_", F.lag), ("__", F.lead))})
    meets = lambda j, k: (F.abs(j - F.col("middle")) <= F.col("half")) & (F.col("ahx") * F.col(f"hx{k}") + F.col("ahy") * F.col(f"hy{k}") >= MATCH_COS)
    d2 = lambda k: (F.col(f"x{k}") - F.col("ax")) ** 2 + (F.col(f"y{k}") - F.col("ay")) ** 2
    # The nearest is among those that no neighbour which is met too is nearer than: only these few are sorted.
    passed = lambda step, k: F.coalesce(meets(F.col("j") + step, k) & (d2(k) < d2("")), F.lit(False))
    met = anchors.join(other, [*LAP, "block"]).where(meets(F.col("j"), "") & ~passed(-1, "_") & ~passed(1, "__"))

    def on(a: str, b: str) -> tuple[Column, Column]:
        """(squared distance, time) of the anchor's foot on the step from the point with suffix ``a`` to that with ``b``."""
        at = lambda c, k: F.coalesce(F.col(c + k), F.col(c))
        vx, vy = at("x", b) - at("x", a), at("y", b) - at("y", a)
        l2 = vx * vx + vy * vy
        u = F.when(l2 > 0, F.least(F.greatest(((F.col("ax") - at("x", a)) * vx + (F.col("ay") - at("y", a)) * vy) / l2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return (at("x", a) + u * vx - F.col("ax")) ** 2 + (at("y", a) + u * vy - F.col("ay")) ** 2, at("t", a) + u * (at("t", b) - at("t", a))

    (d_lo, t_lo), (d_hi, t_hi) = on("_", ""), on("", "__")
    feet = met.select(*LAP, "block", "i", d2("").alias("d2"), "j", F.least(d_lo, d_hi).alias("off"), (F.when(d_lo <= d_hi, t_lo).otherwise(t_hi) - F.col("at")).alias("loop"))
    near = feet.groupBy(*LAP, "block", "i").agg(F.min(F.struct("d2", "j", "off", "loop")).alias("p"))
    loops = near.where(F.col("p.off") <= MATCH_M**2).groupBy(*REC).agg(F.min("p.loop").alias("w"))
    return best(laps_).join(loops, REC, "left").select("rec", rounded(F.least("lap_s", F.coalesce("w", "lap_s")), 4).alias("rolling_s"))


def fraction_grid(samples: DataFrame, cells: int = CONFIG.grid, ys: tuple[str, ...] = ("elapsed",)) -> DataFrame:
    """(rec, lap_id, i, ...): values at ``cells`` even fractions of each lap's distance."""
    total = samples.groupBy(*LAP).agg(F.max("dist").alias("total")).where("total > 0")
    grid = total.select(*LAP, "total", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("i"))
    grid = grid.select(*LAP, (F.col("i") / F.lit(cells - 1.0) * F.col("total")).alias("dist"), "i", "total")
    return interp_join(samples, grid, LAP, "dist", list(ys))


def channels(samples: DataFrame, forces: DataFrame | None = None) -> DataFrame:
    """Columns of a lap's samples for export; ``altitude``, ``lat`` and ``lon`` too where the samples have them, and the g of ``forces`` (rec, t, lat_g, long_g) at their times."""
    also = [c for c in ("altitude", "lat", "lon") if c in samples.columns]
    if forces is not None:
        samples = interp_join(forces, samples, REC, "t", ["long_g", "lat_g"]) if "long_g" not in samples.columns else samples
    g = [rounded(c, 4).alias(n) for c, n in (("long_g", "g_long"), ("lat_g", "g_lat")) if c in samples.columns]
    return samples.select(*LAP, rounded("t", 3).alias("time_s"), rounded("elapsed", 3).alias("elapsed_s"), rounded("dist", 3).alias("distance_m"), rounded(F.col("v") * 3.6, 3).alias("speed_kmh"), rounded("x", 3).alias("x_m"), rounded("y", 3).alias("y_m"), *also, *g)
