"""One session: the frames that the reports are made of, from a trace."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coaching, corners, delta, driving, laps, pace, projection
from ..operators import trace as tr
from ..sources.tables import materialised


def _line(ends: tuple[float, float, float, float]):
    return F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), ends, strict=True)])


@dataclass
class Session:
    """Lazy frames over all recordings of ``trace`` (rec, seq, t, v, odo, dop, fix, x, y, lap_no).

    Nothing is computed until a frame is asked for; each is keyed by ``rec``, so any
    number of recordings is one plan.  What is read many times, the samples of laps
    before all, is written as a table once.
    """

    trace: DataFrame
    line: tuple[float, float, float, float]
    sector_lines: tuple[tuple[float, float, float, float], ...] = ()

    @cached_property
    def clean(self) -> DataFrame:
        return tr.gated(self.trace)

    @cached_property
    def crossings(self) -> DataFrame:
        return laps.numbered(laps.line_crossings(self.trace, self.lines)).select("rec", "seq", "lap_id", "t_cross")

    @cached_property
    def lines(self) -> DataFrame:
        """(rec, line): the timing line of each recording."""
        return self.recordings.withColumn("line", _line(self.line))

    @cached_property
    def recordings(self) -> DataFrame:
        return self.trace.select("rec").distinct()

    @cached_property
    def sectors(self) -> DataFrame:
        """(rec, sector, line): the sector lines of each recording, from 1."""
        return self.recordings.select("rec", F.posexplode(F.array(*map(_line, self.sector_lines))).alias("sector", "line")).withColumn("sector", F.col("sector") + 1)

    @cached_property
    def samples(self) -> DataFrame:
        """Samples of complete laps, swept once and kept as a table."""
        return materialised(laps.swept(self.trace, _line(self.line)), "samples")

    @cached_property
    def laps(self) -> DataFrame:
        """Facts of complete laps, a small table."""
        return materialised(laps.facts(self.samples), "laps")

    @cached_property
    def valid(self) -> DataFrame:
        return laps.valid(self.laps)

    @cached_property
    def best(self) -> DataFrame:
        return laps.best(self.laps)

    @cached_property
    def valid_samples(self) -> DataFrame:
        return self.samples.join(self.valid.select("rec", "lap_id"), ["rec", "lap_id"], "left_semi")

    @cached_property
    def clean_samples(self) -> DataFrame:
        """Samples of valid laps without dropouts."""
        return self.samples.join(laps.clean(self.laps).select("rec", "lap_id"), ["rec", "lap_id"], "left_semi")

    @cached_property
    def lap_facts(self) -> DataFrame:
        """``valid_samples`` as a table: the facts that corner times are made from."""
        return materialised(self.valid_samples, "lap-facts")

    @cached_property
    def clean_facts(self) -> DataFrame:
        """``clean_samples`` as a table: the facts that corners are found from."""
        return materialised(self.clean_samples, "clean-facts")

    @cached_property
    def clean_grid(self) -> DataFrame:
        return laps.fraction_grid(self.clean_samples)

    @cached_property
    def grid(self) -> DataFrame:
        return laps.fraction_grid(self.valid_samples)

    @cached_property
    def lengths(self) -> DataFrame:
        """(rec, length): the best lap's distance."""
        found = self.samples.join(self.best.select("rec", "lap_id"), ["rec", "lap_id"], "left_semi").groupBy("rec").agg(F.max("dist").alias("length"))
        return materialised(found, "lengths")

    @cached_property
    def profile(self) -> DataFrame:
        return materialised(corners.pooled(corners.curvature(self.clean_facts), self.lengths), "profile")

    @cached_property
    def corners(self) -> DataFrame:
        return materialised(corners.detect(self.profile, corners.otsu(self.profile)), "corners")

    @cached_property
    def windows(self) -> DataFrame:
        """Each valid lap's corners, in its own metres."""
        return materialised(projection.windows(self.corners, self.lap_facts, self.best, self.lengths), "windows")

    @cached_property
    def corner_stats(self) -> DataFrame:
        return materialised(corners.stats(self.lap_facts, self.windows), "corner-stats")

    @cached_property
    def consistency(self) -> DataFrame:
        """(rec, lap_id, lap_s): valid laps without dropouts, which reports over laps are made of."""
        return materialised(laps.clean(self.laps).select("rec", "lap_id", "lap_s"), "consistency")

    def steady(self, rows: DataFrame) -> DataFrame:
        """The rows (rec, lap_id, ...) of consistency laps."""
        return rows.join(self.consistency.select("rec", "lap_id"), ["rec", "lap_id"], "left_semi")

    @cached_property
    def phase_losses(self) -> DataFrame:
        return materialised(corners.phase_losses(corners.phases(self.lap_facts, self.windows), self.best), "phase-losses")

    @cached_property
    def lap_g(self) -> DataFrame:
        return materialised(driving.lap_g(self.lap_facts), "lap-g")

    @cached_property
    def brakes(self) -> DataFrame:
        return materialised(driving.brake_events(driving.fragments(self.lap_g, self.thresholds), self.windows), "brakes")

    @cached_property
    def totals(self) -> DataFrame:
        """(rec, lap_id, total): the length of each valid lap by its own odometer."""
        return self.lap_facts.groupBy("rec", "lap_id").agg(F.max("dist").alias("total"))

    @cached_property
    def g_trace(self) -> DataFrame:
        return tr.long_g(self.trace)

    @cached_property
    def thresholds(self) -> DataFrame:
        """(rec, theta), a small table that brakes and coasts are both found with."""
        return materialised(driving.brake_threshold(self.g_trace), "thresholds")

    def deltas(self) -> DataFrame:
        return delta.to_baseline(self.grid, self.best)

    def pace(self) -> DataFrame:
        return pace.pace(self.valid)

    def coaching(self) -> DataFrame:
        typical = coaching.typical(self.consistency)
        coasts = driving.lap_coasts(self.lap_g, self.thresholds)
        found = coaching.evidence(self.corners, self.corner_stats, self.brakes, coasts, self.best, typical, self.totals, self.lengths)
        return coaching.attributed(self.steady(self.corner_stats), found, self.steady(self.phase_losses), self.best, typical)
