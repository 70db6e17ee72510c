"""Small operators that the others are made of: interpolation joins, islands, moving windows, gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

Keys = list[str]


def along(keys: Keys, *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` and ``b`` as one frame.

    Spark 4.1 takes a union of frames with one partitioning as so partitioned;
    where an exchange below is reused, rows then miss their partner (a join
    after such a union lost all its rows).  So unions are dealt out anew here.
    """
    a.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return a.unionByName(b)


def known_before(value: str, keys: Keys, *order: str) -> Column:
    """The last value that isn't null, up to a row."""
    return F.last(value, ignorenulls=True).over(along(keys, *order).rowsBetween(Window.unboundedPreceding, 0))


def known_after(value: str, keys: Keys, *order: str) -> Column:
    """The first value that isn't null, from a row on.

    It is looked for backwards: a frame that ends at the last row is gone through anew for each row.
    """
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))


def interp_join(samples: DataFrame, grid: DataFrame, keys: Keys, x: str, ys: list[str]) -> DataFrame:
    """``grid`` with ``ys`` of ``samples`` interpolated at ``x``, clamped at both ends.

    Samples and grid are united and swept in order of ``x``, there and back, so the cost is
    two sorts of each key's rows; a grid row of a key without samples gets nulls.
    """
    extra = [c for c in grid.columns if c not in (*keys, x)]
    point = F.struct(F.col(x).alias("_at"), *[F.col(y).alias(y) for y in ys])
    known = samples.where(F.col(x).isNotNull()).select(*keys, x, *[F.lit(None).cast(grid.schema[c].dataType).alias(c) for c in extra], F.lit(0).alias("_g"), point.alias("_p"))
    asked = grid.select(*keys, x, *extra, F.lit(1).alias("_g"), F.lit(None).cast(known.schema["_p"].dataType).alias("_p"))
    both = united(known, asked).withColumns({"_a": known_before("_p", keys, x, "_g"), "_b": known_after("_p", keys, x, "_g")}).where("_g = 1")
    share = (F.col(x) - F.col("_a._at")) / (F.col("_b._at") - F.col("_a._at"))

    def value(y: str) -> Column:
        a, b = F.col(f"_a.{y}"), F.col(f"_b.{y}")
        return F.when(F.col("_a").isNull(), b).when(F.col("_b").isNull() | (F.col("_b._at") == F.col("_a._at")), a).otherwise(a + (b - a) * share)

    return both.select(*keys, x, *extra, *[value(y).alias(y) for y in ys])


def islands(df: DataFrame, keys: Keys, order: str, inside: Column, name: str = "island") -> DataFrame:
    """The rows where ``inside`` holds, and the number of the unbroken run that each is in."""
    w = along(keys, order)
    flagged = df.withColumn("_in", F.coalesce(inside, F.lit(False)))
    start = F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))
    return flagged.withColumn("_start", start.cast("int")).withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_in").drop("_in", "_start")


def runs(df: DataFrame, keys: Keys, order: str, breaks: Column, name: str = "run") -> DataFrame:
    """``df`` and a run number that rises at each row where ``breaks`` holds."""
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(along(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def boxcar(value: str, keys: Keys, order: str, width: int) -> Column:
    """Mean of ``width`` samples around each, of those there are at the ends."""
    return F.avg(value).over(along(keys, order).rowsBetween(-(width // 2), (width - 1) // 2))


def smooth(value: str, keys: Keys, order: str, width: int) -> Column:
    """:func:`boxcar`, but as it is where there are fewer samples than ``width``."""
    enough = F.count(F.lit(1)).over(Window.partitionBy(*keys)) >= width
    return F.when(enough, boxcar(value, keys, order, width)).otherwise(F.col(value)) if width > 1 else F.col(value)


def boxcar_by(rows: DataFrame, value: str, width: str, keys: Keys, order: str, name: str) -> DataFrame:
    """``rows`` and :func:`smooth` of ``value`` over as many samples as the key's ``width`` says, from running sums.

    A key's rows are laid side by side as an array, in which both ends of each window are looked up, so
    rows that are dealt by key aren't dealt anew or joined; a key is a lap, of some hundred samples.
    """
    w = along(keys, order)
    own = [c for c in rows.columns if c not in keys]
    summed = rows.withColumns({"_i": F.row_number().over(w), "_s": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    laid = summed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_s", *own))).alias("_r"))
    n = F.size("_r")

    def mean(e: Column) -> Column:
        lo, hi = F.greatest(e["_i"] - F.shiftright(e[width], 1) - 1, F.lit(0)), F.least(e["_i"] + F.shiftright(e[width] - 1, 1), n)
        before = F.coalesce(F.get(F.col("_r"), lo - 1)["_s"], F.lit(0.0))
        return F.when((n >= e[width]) & (e[width] > 1), (F.get(F.col("_r"), hi - 1)["_s"] - before) / (hi - lo)).otherwise(e[value])

    met = laid.select(*keys, F.explode(F.transform("_r", lambda e: F.struct(*[e[c].alias(c) for c in own], mean(e).alias(name)))).alias("_e"))
    return met.select(*keys, "_e.*")


def moving_median(value: str, keys: Keys, order: str, width: int = 5) -> Column:
    """Median of ``width`` samples around each, of those there are at the ends; of the few, as an array."""
    near = F.array_sort(F.collect_list(value).over(along(keys, order).rowsBetween(-(width // 2), width // 2)))
    n = F.size(near)
    return (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2


def gradient(y: str, x: str, keys: Keys, order: str) -> Column:
    """Second-order differences on uneven steps inside, one-sided at the ends."""
    w = along(keys, order)
    before, after = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    y0, y1, y2 = F.lag(y).over(w), F.col(y), F.lead(y).over(w)
    inside = (before * before * y2 + (after * after - before * before) * y1 - after * after * y0) / (before * after * (before + after))
    return F.when(before.isNull(), (y2 - y1) / after).when(after.isNull(), (y1 - y0) / before).otherwise(inside)


def uniform_gradient(y: str, keys: Keys, order: str) -> Column:
    w = along(keys, order)
    y0, y1, y2 = F.lag(y).over(w), F.col(y), F.lead(y).over(w)
    return F.when(y0.isNull(), y2 - y1).when(y2.isNull(), y1 - y0).otherwise((y2 - y0) / 2)


def unwrap(df: DataFrame, angle: str, keys: Keys, order: str, name: str) -> DataFrame:
    """``df`` and the angle without jumps of a full turn."""
    w = along(keys, order)
    turn = 2 * F.pi()
    step = F.col(angle) - F.lag(angle).over(w)
    wrapped = step - turn * F.floor((step + F.pi()) / turn)
    df = df.withColumn("_step", F.coalesce(F.when((wrapped == -F.pi()) & (step > 0), F.pi()).otherwise(wrapped), F.lit(0.0)))
    first = F.first(angle).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, first + F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def nearest(points: DataFrame, targets: DataFrame, keys: Keys, index: str) -> DataFrame:
    """For each target (x, y and its own columns) the nearest point of its keys, the first on ties.  Targets are few: lines, markers, cursors."""
    t = targets.withColumnsRenamed({"x": "_tx", "y": "_ty"})
    d2 = (F.col("x") - F.col("_tx")) ** 2 + (F.col("y") - F.col("_ty")) ** 2
    own = [c for c in t.columns if c not in keys]
    best = points.join(t, keys).groupBy(*keys, *own).agg(F.min(F.struct(d2.alias("d2"), F.col(index).alias(index))).alias("_b"))
    return best.select(*keys, *[c for c in own if c not in ("_tx", "_ty")], F.col("_tx").alias("x"), F.col("_ty").alias("y"), F.col(f"_b.{index}").alias(index), F.sqrt("_b.d2").alias("distance"))
