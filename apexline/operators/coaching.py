"""Why time is lost in a corner, and the reports that say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CONFIG
from ..functions.scalars import rounded, saturate
from .house import united
from .pace import median_lap

REC, LAP, CORNER = ["rec"], ["rec", "lap_id"], ["rec", "lap_id", "cid"]
#: The evidence that is half as strong as it can be (km/h at the apex, seconds of braking, of coasting, of spread), in order of priority.
HALVES = {"apex": 3.0, "brake": 0.30, "coast": 0.30, "line": 0.15}
#: Losses and strengths below which there is nothing to say, and the share of a loss that makes a phase its main one.
NO_LOSS, NO_DIFFERENCE, NO_PHASE, MAIN_PHASE = 1e-9, 1e-12, 1e-6, 0.5
#: The phases that a reason's remedy acts on; for others the phase is where the loss shows.
REMEDY = {"apex": ["apex"], "brake": ["entry"], "coast": ["apex", "exit"], "line": ["entry", "apex", "exit"], "none": ["entry", "apex", "exit"]}
PHASES = ("entry", "apex", "exit")
#: Metres around a brake point within which no hint is given.
HINT_M = 2.0


def braked(events: DataFrame, windows: DataFrame) -> DataFrame:
    """(rec, lap_id, cid, brake): seconds of brake events that begin in a corner's window or up to ``corner_lead_m`` before it."""
    met = windows.join(events.select(*LAP, "d0", "seconds"), LAP).where((F.col("d0") >= F.col("enter") - CONFIG.corner_lead_m) & (F.col("d0") <= F.col("exit")))
    return met.groupBy(*CORNER).agg(F.sum("seconds").alias("brake"))


def coasted(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """(rec, lap_id, cid, coast): seconds of coasting spans that overlap a corner's window, each in full."""
    met = windows.join(spans.select(*LAP, "d0", "d1", "seconds"), LAP).where((F.col("d1") >= F.col("enter")) & (F.col("d0") <= F.col("exit")))
    return met.groupBy(*CORNER).agg(F.sum("seconds").alias("coast"))


def scaled(corners: DataFrame, totals: DataFrame, lengths: DataFrame) -> DataFrame:
    """(rec, lap_id, cid, enter, exit): corners scaled to laps (rec, lap_id, total)."""
    by = F.col("total") / F.col("length")
    return totals.join(lengths, REC).join(corners.select("rec", "cid", "enter", "exit"), REC).select(*CORNER, (F.col("enter") * by).alias("enter"), (F.col("exit") * by).alias("exit"))


def evidence(corners: DataFrame, stats: DataFrame, brakes: DataFrame, coasts: DataFrame, best: DataFrame, typical: DataFrame, totals: DataFrame, lengths: DataFrame) -> DataFrame:
    """(rec, cid, apex, brake, coast): how much slower the apex of the typical lap is than the best lap's, in km/h, and how much longer it brakes and coasts; never below 0."""
    both = united(best.select(*LAP, F.lit(0).alias("_w")), typical.select(*LAP, F.lit(1).alias("_w")))
    windows = scaled(corners, totals.join(both.select(*LAP).distinct(), LAP), lengths)
    facts = windows.select(*CORNER).join(braked(brakes, windows), CORNER, "left").join(coasted(coasts, windows), CORNER, "left").join(stats.select(*CORNER, "v_apex"), CORNER, "left").join(both, LAP)
    of = lambda c, w: F.coalesce(F.max(F.when(F.col("_w") == w, F.col(c))), F.lit(0.0))
    more = lambda a, b: F.greatest(a - b, F.lit(0.0))
    return facts.groupBy("rec", "cid").agg((more(of("v_apex", 0), of("v_apex", 1)) * 3.6).alias("apex"), more(of("brake", 1), of("brake", 0)).alias("brake"), more(of("coast", 1), of("coast", 0)).alias("coast"))


def reason(loss: Column) -> Column:
    """(reason, strength): the strongest evidence (columns apex, brake, coast, line), the first by priority of equal ones; none where there is none."""
    best = F.struct(F.lit("none").alias("reason"), F.lit(0.0).alias("strength"))
    for name, half in HALVES.items():
        # Each is one step of a chain of a few; a stronger one takes over.
        e = F.greatest(F.coalesce(F.col(name), F.lit(0.0)), F.lit(0.0))
        strength = F.when(loss > NO_LOSS, saturate(e, half)).otherwise(0.0)
        best = F.when(strength > best["strength"] + NO_DIFFERENCE, F.struct(F.lit(name).alias("reason"), strength.alias("strength"))).otherwise(best)
    return best


def clause(reason_: Column) -> Column:
    """Names the phase (columns entry_s, apex_s, exit_s) that holds most of what is lost, as the place of the remedy or as where it shows; empty if none does."""
    total = sum((F.col(f"{p}_s") for p in PHASES), F.lit(0.0))
    # The largest, the first of equals.
    worst = F.array_max(F.array(*[F.struct(F.col(f"{p}_s").alias("s"), F.lit(-i).alias("o"), F.lit(p).alias("p")) for i, p in enumerate(PHASES)]))
    clear = (total > NO_PHASE) & (worst["s"] > NO_PHASE) & (worst["s"] >= MAIN_PHASE * total)
    remedies = F.create_map(*[x for k, v in REMEDY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    place = F.when(worst["p"] == "apex", "the apex").otherwise(worst["p"])
    fits = F.array_contains(F.element_at(remedies, reason_), worst["p"])
    return F.when(clear, F.when(fits, F.concat(F.lit(", mostly at "), place)).otherwise(F.concat(F.lit("; it lasts to "), place))).otherwise("")


def sentence(reason_: Column) -> Column:
    """What the evidence says, in a sentence; seconds of braking and coasting are causes, not what can be won."""
    said = {
        "apex": F.format_string("%.1f km/h slower at the apex", "apex"), "brake": F.format_string("on the brakes %.2f s longer", "brake"),
        "coast": F.format_string("coasts %.2f s longer", "coast"), "line": F.format_string("uneven, by %.2f s from lap to lap", "line"),
    }
    text = F.lit("slower than the best lap")
    for name, words in said.items():
        text = F.when(reason_ == name, words).otherwise(text)
    return F.concat(text, clause(reason_))


def attributed(stats: DataFrame, evidence_: DataFrame, losses: DataFrame, best: DataFrame, typical: DataFrame, top: int = 3, least: int = 3) -> DataFrame:
    """(rec, rank, cid, loss_s, reason, contribution_s, apex, brake, coast, line, entry_s, apex_s, exit_s, text): where laps lose most to the best one, and why.

    ``stats`` are the consistency laps' (at least ``least`` of them, or a recording has no rows) and the best one's.
    The loss is the median over laps; only those above 0 count; the first ``top`` get a reason.  Its contribution
    is its strength's share of the loss.  Evidence and phases (``losses`` of :func:`corners.phase_losses`) are the typical lap's.
    """
    own = stats.join(best.select(*LAP), LAP, "left_semi").select("rec", "cid", F.col("time_s").alias("_b"))
    n = stats.select(*LAP).distinct().groupBy(*REC).agg(F.count("*").alias("laps")).where(F.col("laps") >= least)
    loss = stats.join(n, REC, "left_semi").join(own, ["rec", "cid"]).groupBy("rec", "cid").agg(rounded(F.median(F.col("time_s") - F.col("_b")), 6).alias("loss_s"), F.stddev_samp("time_s").alias("line")).where(F.col("loss_s") > NO_LOSS)
    parts = losses.join(typical.select(*LAP), LAP, "left_semi").groupBy("rec", "cid").agg(*[F.sum(F.when(F.col("phase") == i, F.col("loss_s"))).alias(f"{p}_s") for i, p in enumerate(PHASES)])
    both = loss.join(evidence_, ["rec", "cid"], "left").join(parts, ["rec", "cid"], "left").na.fill(0.0, [*HALVES, *[f"{p}_s" for p in PHASES]])
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy(*REC).orderBy(F.desc("loss_s"), "cid")))
    why = ranked.withColumn("_r", F.when(F.col("rank") <= top, reason(F.col("loss_s"))).otherwise(F.struct(F.lit("none").alias("reason"), F.lit(0.0).alias("strength"))))
    return why.select("rec", "rank", "cid", "loss_s", F.col("_r.reason").alias("reason"), (F.col("loss_s") * F.col("_r.strength")).alias("contribution_s"), *HALVES, *[f"{p}_s" for p in PHASES], F.format_string("C%d: %.2f s; %s", "cid", "loss_s", sentence(F.col("_r.reason"))).alias("text"))


def shown(rows: DataFrame) -> DataFrame:
    """Without those that would show as no loss at all."""
    return rows.where(rounded("loss_s", 2) > 0)


def brake_hint(metres_later: Column) -> Column:
    return F.when(F.abs(metres_later) >= HINT_M, F.when(metres_later > 0, F.format_string("brake %.0f m later", metres_later)).otherwise(F.format_string("brake %.0f m earlier", -metres_later)))


def corner_report(corners: DataFrame) -> DataFrame:
    """(rec, cid, n, best_s, median_s, sigma_s, loss_s, apex_kmh, score) over laps."""
    a = corners.groupBy("rec", "cid").agg(F.count("time_s").alias("n"), F.min("time_s").alias("b"), F.median("time_s").alias("m"), F.stddev_samp("time_s").alias("s"), F.median("v_apex").alias("v"))
    return a.select("rec", "cid", "n", rounded("b", 4).alias("best_s"), rounded("m", 4).alias("median_s"), rounded("s", 4).alias("sigma_s"), rounded(F.col("m") - F.col("b"), 4).alias("loss_s"), rounded(F.col("v") * 3.6, 3).alias("apex_kmh"), rounded(F.coalesce(F.col("s") * (F.col("m") - F.col("b")), F.lit(0.0)), 6).alias("score"))


def corner_bests(corners: DataFrame) -> DataFrame:
    return corners.groupBy("rec", "cid").agg(F.min("time_s").alias("best_s"), F.max("v_apex").alias("best_apex"))


def corner_grip(samples: DataFrame, corners: DataFrame, envelope: DataFrame) -> DataFrame:
    """(rec, lap_id, cid, grip): median total g in a corner against the envelope, at most 1.1; 0 where it has no sample."""
    met = samples.join(corners.select(*CORNER, "enter", "exit"), LAP).where((F.col("dist") >= F.col("enter")) & (F.col("dist") <= F.col("exit")))
    g = met.groupBy(*CORNER).agg(F.median(F.sqrt(F.col("lat_g") ** 2 + F.col("long_g") ** 2)).alias("g"))
    out = corners.select(*CORNER).join(g, CORNER, "left").join(envelope, REC)
    return out.select(*CORNER, rounded(F.coalesce(F.least(F.col("g") / F.col("envelope_g"), F.lit(1.1)), F.lit(0.0)), 4).alias("grip"))


def laps_table(laps: DataFrame, samples: DataFrame, splits: DataFrame, stats: DataFrame) -> DataFrame:
    """(rec, lap_id, lap, lap_s, dist_m, entry_kmh, flag, splits, corners) of valid laps (with ``dropout``), for export.

    ``lap`` counts from 1; ``splits`` are the sector times in order, ``corners`` (cid, time_s, apex_kmh) in order.
    """
    entry = samples.groupBy(*LAP).agg((F.min_by("v", "dist") * 3.6).alias("entry_kmh"))
    s = splits.groupBy(*LAP).agg(F.sort_array(F.collect_list(F.struct("sector", "split_s"))).alias("_s")).select(*LAP, F.col("_s.split_s").alias("splits"))
    c = stats.groupBy(*LAP).agg(F.sort_array(F.collect_list(F.struct("cid", "time_s", (F.col("v_apex") * 3.6).alias("apex_kmh")))).alias("corners"))
    all_ = laps.join(entry, LAP, "left").join(s, LAP, "left").join(c, LAP, "left")
    return all_.select(*LAP, (F.col("lap_id") + 1).alias("lap"), "lap_s", "dist_m", "entry_kmh", F.when(F.col("dropout"), "dropout").otherwise("").alias("flag"), "splits", "corners")


def csv_lines(table: DataFrame, theoretical: DataFrame, rolling: DataFrame) -> DataFrame:
    """(rec, n, line): each recording's laps as lines of text: a head, a line for each lap, an empty line, and the summary of stitched laps.

    Columns are those of the recording's longest lap; a lap that has fewer leaves them empty.  The theoretical best is
    left out without sectors, where it is the best lap again.
    """
    three = lambda c: F.coalesce(F.format_string("%.3f", c), F.lit(""))
    size = table.groupBy(*REC).agg(F.coalesce(F.max(F.size("splits")), F.lit(0)).alias("_ns"), F.coalesce(F.max(F.size("corners")), F.lit(0)).alias("_nc"))
    both = table.join(size, REC)
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    cells = F.concat(
        F.array(F.col("lap").cast("string"), three(F.col("lap_s")), three(F.col("dist_m")), three(F.col("entry_kmh")), F.col("flag")),
        F.transform(up_to(F.col("_ns")), lambda i: three(F.get("splits", i - 1))), F.flatten(F.transform(up_to(F.col("_nc")), lambda i: F.array(three(F.get("corners", i - 1)["time_s"]), three(F.get("corners", i - 1)["apex_kmh"])))),
    )
    laps = both.select("rec", (F.col("lap_id") + 1).alias("n"), F.array_join(cells, ",").alias("line"))
    names = F.concat(F.array(*[F.lit(c) for c in ("lap", "time_s", "dist_m", "entry_kmh", "flag")]), F.transform(up_to(F.col("_ns")), lambda i: F.concat(F.lit("S"), i, F.lit("_s"))), F.flatten(F.transform(up_to(F.col("_nc")), lambda i: F.array(F.concat(F.lit("C"), i, F.lit("_time_s")), F.concat(F.lit("C"), i, F.lit("_apex_kmh"))))))
    head = size.select("rec", F.lit(0).cast("long").alias("n"), F.array_join(names, ",").alias("line"))
    last = 1 << 40
    end = size.join(theoretical, REC, "left").join(rolling, REC, "left")
    tail = F.array(F.struct(F.lit(last).alias("n"), F.lit("").alias("line")), F.struct(F.lit(last + 1).alias("n"), F.lit("summary,time_s").alias("line")), F.struct(F.lit(last + 2).alias("n"), F.when(F.col("_ns") > 1, F.concat(F.lit("summary: Theoretical best,"), three(F.col("theoretical_s")))).alias("line")), F.struct(F.lit(last + 3).alias("n"), F.concat(F.lit("summary: Best rolling,"), three(F.col("rolling_s"))).alias("line")))
    rows = end.select("rec", F.explode(tail).alias("t")).select("rec", "t.n", "t.line").where("line is not null")
    return united(united(head, laps), rows)


def share_card(laps: DataFrame, ideal: DataFrame, trusted: Column) -> DataFrame:
    """(rec, best_s, to_ideal_s, stamp): what a card shows; the stamp tells of times that aren't to be trusted."""
    b = laps.groupBy(*REC).agg(F.min("lap_s").alias("best_s"))
    return b.join(ideal, REC, "left").select("rec", "best_s", rounded(F.col("best_s") - F.col("ideal_s"), 4).alias("to_ideal_s"), F.when(trusted, "verified").otherwise("provisional").alias("stamp"))


def typical(laps: DataFrame) -> DataFrame:
    """The lap that reasons are looked for in."""
    return median_lap(laps)


def pb_text(moment: Column, best: Column, prior: Column) -> Column:
    return F.when(moment == "first", "First time on this track").when(moment == "beat", F.format_string("New best by %.3f s", prior - best))


def html_report(table: DataFrame, title: str) -> DataFrame:
    """(rec, html): a table of each recording's rows as a page."""
    cells = lambda tag, values: F.concat(*[F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>")) for v in values])
    names = [c for c in table.columns if c != "rec"]
    safe = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = table.withColumn("_r", F.struct(*names)).withColumn("_h", cells("td", [safe(c) for c in names]))
    body = rows.groupBy(*REC).agg(F.sort_array(F.collect_list(F.struct("_r", "_h"))).alias("b"))
    lines = F.array_join(F.transform("b", lambda x: F.concat(F.lit("<tr>"), x["_h"], F.lit("</tr>"))), "\n")
    head = "".join(f"<th>{c}</th>" for c in names)
    return body.select("rec", F.concat(F.lit(f"<!doctype html><title>{title}</title><table><tr>{head}</tr>\n"), lines, F.lit("</table>")).alias("html"))
