"""Forces on the vehicle: from its motion by GPS, and from an IMU of unknown mounting.

An IMU table has rows (rec, stream, t, w, x, y, z): ``ACCL`` in m/s², ``GRAV`` unit
vectors and ``CORI`` unit quaternions, each at a rate of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..sources.tables import materialised
from .house import along, boxcar, interp_join, known_after, known_before, moving_median, uniform_gradient, united, unwrap

REC = ["rec"]
#: Widths of the smoothing in samples, and the limits of both axes.
HEADING_WIDTH, SPEED_WIDTH, LONG_CLIP, LAT_CLIP = 11, 9, 2.0, 3.0
STEP_S, LOWPASS_S, LEAST_R, LEAST_MOVING = 0.02, 0.15, 0.4, 10


def clipped(value: Column, most: float) -> Column:
    return F.least(F.greatest(value, F.lit(-most)), F.lit(most))


def gps_g(trace: DataFrame) -> DataFrame:
    """(rec, seq, t, v, heading, lat_g, long_g): from positions freed of outliers, smoothed, and turned into heading and speed."""
    t = trace
    for c in ("x", "y"):
        t = t.withColumn(f"_m{c}", moving_median(c, REC, "seq", 5))
    t = t.withColumns({f"_s{c}": boxcar(f"_m{c}", REC, "seq", HEADING_WIDTH) for c in ("x", "y")})
    t = t.withColumn("_dt", uniform_gradient("t", REC, "seq"))
    t = t.withColumns({f"_v{c}": uniform_gradient(f"_s{c}", REC, "seq") / F.col("_dt") for c in ("x", "y")})
    t = unwrap(t.withColumn("_psi", F.atan2("_vy", "_vx")), "_psi", REC, "seq", "_turned")
    t = t.withColumns({"_heading": boxcar("_turned", REC, "seq", HEADING_WIDTH), "_speed": boxcar("v", REC, "seq", SPEED_WIDTH)})
    slope = lambda c: uniform_gradient(c, REC, "seq") / F.col("_dt")
    t = t.withColumns({"_a": slope("_speed"), "_w": slope("_heading")})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return t.select("rec", "seq", "t", "v", zero(F.col("_heading")).alias("heading"), zero(clipped(F.col("_speed") * F.col("_w") / CONFIG.g, LAT_CLIP)).alias("lat_g"), zero(clipped(F.col("_a") / CONFIG.g, LONG_CLIP)).alias("long_g"))


def on_grid(series: DataFrame, columns: list[str], step: float = STEP_S) -> DataFrame:
    """``series`` (rec, t, columns) on an even grid from each recording's first time to before its last."""
    span = series.groupBy(*REC).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    n = F.ceil((F.col("b") - F.col("a")) / step - 1e-9).cast("int")
    grid = span.where("b > a").select("rec", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("k"), (F.col("a") + i * step).alias("t")))).alias("p")).select("rec", "p.t", "p.k")
    return interp_join(series, grid, REC, "t", columns)


def rotated_back(q: str, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A vector turned by the inverse of the unit quaternion in columns {q}w, {q}x, {q}y, {q}z."""
    w, a, b, c = (F.col(f"{q}{n}") for n in "wxyz")
    tx, ty, tz = 2 * (z * b - y * c), 2 * (x * c - z * a), 2 * (y * a - x * b)
    return x - w * tx + (b * tz - c * ty), y - w * ty + (c * tx - a * tz), z - w * tz + (a * ty - b * tx)


def horizontal(imu: DataFrame, keys: list[str] = REC) -> DataFrame:
    """(keys, t, h1, h2): acceleration in the world's horizontal plane, without gravity, low-passed.

    Gravity's vector comes with its first two axes exchanged.  ``h1`` and ``h2``
    are any two axes across the mean direction of gravity.
    """
    stream = lambda name: imu.where(F.col("stream") == name)
    accl = stream("ACCL").select(*keys, "t", "x", "y", "z")
    grav = stream("GRAV").select(*keys, "t", F.col("y").alias("gx"), F.col("x").alias("gy"), F.col("z").alias("gz"))
    cori = stream("CORI").select(*keys, "t", *[F.col(n).alias(f"q{n}") for n in "wxyz"])
    both = interp_join(cori, interp_join(grav, accl, keys, "t", ["gx", "gy", "gz"]), keys, "t", ["qw", "qx", "qy", "qz"])
    length = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2)
    turn = F.sqrt(F.col("qw") ** 2 + F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2)
    both = both.withColumns({**{c: F.col(c) / length for c in ("gx", "gy", "gz")}, **{f"q{n}": F.col(f"q{n}") / turn for n in "wxyz"}})
    # The quaternion's axes are gravity's, so the first two are exchanged back.
    world = rotated_back("q", *[F.col(c) - CONFIG.g * F.col(f"g{c}") for c in "yxz"])
    down = rotated_back("q", F.col("gy"), F.col("gx"), F.col("gz"))
    both = both.select(*keys, "t", *[a.alias(f"a{c}") for a, c in zip(world, "xyz", strict=True)], *[a.alias(f"d{c}") for a, c in zip(down, "xyz", strict=True)])
    # Read for the mean and for the axes: as a table, or the streams would meet twice.
    both = materialised(both, "world")
    mean = both.groupBy(*keys).agg(*[F.avg(f"d{c}").alias(f"m{c}") for c in "xyz"])
    size = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
    mean = mean.select(*keys, *[(F.col(f"m{c}") / size).alias(f"m{c}") for c in "xyz"])
    # The axis least along gravity, made level, and the one across both.
    level = F.when(F.abs("mx") <= F.least(F.abs("my"), F.abs("mz")), 0).when(F.abs("my") <= F.abs("mz"), 1).otherwise(2)
    mean = mean.withColumn("_k", level)
    own = [F.when(F.col("_k") == i, 1.0).otherwise(0.0) for i in range(3)]
    dot = sum((own[i] * F.col(f"m{c}") for i, c in enumerate("xyz")), F.lit(0.0))
    e = [own[i] - dot * F.col(f"m{c}") for i, c in enumerate("xyz")]
    n = F.sqrt(e[0] ** 2 + e[1] ** 2 + e[2] ** 2)
    mean = mean.withColumns({f"e{c}": e[i] / n for i, c in enumerate("xyz")})
    cross = {"fx": ("my", "ez", "mz", "ey"), "fy": ("mz", "ex", "mx", "ez"), "fz": ("mx", "ey", "my", "ex")}
    mean = mean.withColumns({k: F.col(a) * F.col(b) - F.col(c) * F.col(d) for k, (a, b, c, d) in cross.items()})
    flat = both.join(mean, keys)
    flat = flat.select(*keys, "t", *[sum((F.col(f"a{c}") * F.col(f"{axis}{c}") for c in "xyz"), F.lit(0.0)).alias(f"h{i}") for i, axis in ((1, "e"), (2, "f"))])
    # The low-pass is a window in time, so that it needn't know the rate.
    ms = along(keys, "_ms").rangeBetween(-int(LOWPASS_S * 500), int(LOWPASS_S * 500))
    return flat.withColumn("_ms", F.round(F.col("t") * 1000).cast("long")).select(*keys, "t", F.avg("h1").over(ms).alias("h1"), F.avg("h2").over(ms).alias("h2"))


def along_and_across(e: Column, n: Column, heading: Column) -> tuple[Column, Column]:
    """East and north as forward and left of a heading."""
    return e * F.cos(heading) + n * F.sin(heading), n * F.cos(heading) - e * F.sin(heading)


def in_chapters(series: DataFrame, chapters: DataFrame) -> DataFrame:
    """``series`` (rec, t) with ``chapter``: the last of ``chapters`` (rec, chapter, offset) that begins at or before t, the first before all; a sweep."""
    extra = [c for c in series.columns if c not in ("rec", "t")]
    starts = chapters.select("rec", F.col("offset").cast("double").alias("t"), F.lit(0).alias("_k"), "chapter", *[F.lit(None).cast(series.schema[c].dataType).alias(c) for c in extra])
    both = united(starts, series.select("rec", F.col("t").cast("double").alias("t"), F.lit(1).alias("_k"), F.lit(None).cast(chapters.schema["chapter"].dataType).alias("chapter"), *extra))
    now = F.coalesce(known_before("chapter", REC, "t", "_k"), known_after("chapter", REC, "t", "_k"))
    return both.withColumn("chapter", now).where("_k = 1").select("rec", "t", *extra, "chapter")


def fitted(flat: DataFrame, gps: DataFrame, keys: list[str] = REC) -> DataFrame:
    """(keys, c, s, hand, n, r_long, r_lat, rms_long, rms_lat, gps_rms_long, gps_rms_lat, ok): the turn, and reflection, that brings an IMU's level axes to east and north.

    The GPS's forces, turned by its heading, are what the IMU's axes should give.  In
    two dimensions the best turn has a closed form in sums of products, so a
    fit is one aggregation; of both hands the one whose correlations sum to more counts.
    """
    at = interp_join(flat, gps.where(F.col("v") > CONFIG.brake_moving_mps).select(*keys, "t", "lat_g", "long_g", "heading"), keys, "t", ["h1", "h2"]).where("h1 is not null and h2 is not null")
    at = at.withColumns({"_e": F.col("long_g") * F.cos("heading") - F.col("lat_g") * F.sin("heading"), "_n": F.col("long_g") * F.sin("heading") + F.col("lat_g") * F.cos("heading")})
    at = materialised(at, "met")
    hands = at.withColumn("hand", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).withColumns({"_p": F.col("h1") / CONFIG.g, "_q": F.col("h2") * F.col("hand") / CONFIG.g})
    sums = hands.groupBy(*keys, "hand").agg(F.count("*").alias("n"), F.sum(F.col("_p") * F.col("_e") + F.col("_q") * F.col("_n")).alias("_c"), F.sum(F.col("_p") * F.col("_n") - F.col("_q") * F.col("_e")).alias("_s"))
    size = F.sqrt(F.col("_c") ** 2 + F.col("_s") ** 2)
    turns = sums.select(*keys, "hand", "n", F.when(size > 0, F.col("_c") / size).otherwise(1.0).alias("c"), F.when(size > 0, F.col("_s") / size).otherwise(0.0).alias("s"))
    tried = hands.join(turns, [*keys, "hand"])
    long, lat = along_and_across(F.col("c") * F.col("_p") - F.col("s") * F.col("_q"), F.col("s") * F.col("_p") + F.col("c") * F.col("_q"), F.col("heading"))
    tried = tried.withColumns({"_long": long, "_lat": lat})
    r = lambda a, b: F.coalesce(F.when(~F.isnan(F.corr(a, b)), F.corr(a, b)), F.lit(0.0))
    rms = lambda c: F.sqrt(F.avg(F.col(c) ** 2))
    forces = {"rms_long": "_long", "rms_lat": "_lat", "gps_rms_long": "long_g", "gps_rms_lat": "lat_g"}
    scored = tried.groupBy(*keys, "hand", "n", "c", "s").agg(r("_long", "long_g").alias("r_long"), r("_lat", "lat_g").alias("r_lat"), *[rms(c).alias(n) for n, c in forces.items()])
    names = ["c", "s", "hand", "n", "r_long", "r_lat", *forces]
    best = scored.where(F.col("n") >= LEAST_MOVING).groupBy(*keys).agg(F.max(F.struct((F.col("r_long") + F.col("r_lat")).alias("score"), *names)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in names], (F.col("b.r_lat") >= LEAST_R).alias("ok"))


def merged_fits(fits: DataFrame) -> DataFrame:
    """One check for a recording of several chapters (rec, chapter, ...): correlations and forces weighted by samples; one weak chapter doesn't condemn it."""
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n"))
    square = lambda c: F.sqrt(F.try_divide(F.sum(F.col(c) ** 2 * F.col("n")), F.sum("n")))
    all_ = fits.groupBy(*REC).agg(F.sum("n").alias("n"), *[mean(c).alias(c) for c in ("r_long", "r_lat")], *[square(c).alias(c) for c in ("rms_long", "rms_lat", "gps_rms_long", "gps_rms_lat")])
    return all_.withColumn("ok", F.col("r_lat") >= LEAST_R)


def g_series(flat: DataFrame, gps: DataFrame, fit: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """(rec, k, t, lat_g, long_g, origin): 50 a second; from the IMU's level axes (:func:`horizontal`) where their fit holds, else from the GPS.

    With ``chapters`` (rec, chapter, offset), ``flat`` and ``fit`` are by chapter, and each stretch takes its own
    chapter's fit; whether the IMU is trusted is decided for the recording as a whole (:func:`merged_fits`).
    ``flat``, ``gps`` (:func:`gps_g`) and ``fit`` (:func:`fitted`) are read more than once: pass tables.
    """
    grid = on_grid(gps.select("rec", "t", "lat_g", "long_g", "heading"), ["lat_g", "long_g", "heading"])
    if chapters is None:
        keys, good = REC, fit.where("ok")
    else:
        keys, grid = [*REC, "chapter"], in_chapters(grid, chapters)
        good = fit.join(merged_fits(fit).where("ok").select("rec"), REC, "left_semi")
    both = interp_join(flat, grid, keys, "t", ["h1", "h2"]).join(good.select(*keys, "c", "s", "hand"), keys, "left")
    p, q = F.col("h1") / CONFIG.g, F.col("h2") * F.col("hand") / CONFIG.g
    long, lat = along_and_across(F.col("c") * p - F.col("s") * q, F.col("s") * p + F.col("c") * q, F.col("heading"))
    known = F.col("h1").isNotNull() & F.col("c").isNotNull()
    pick = lambda own, most, other: F.when(known, clipped(own, most)).otherwise(F.col(other)).alias(other)
    return both.select("rec", "k", "t", pick(lat, LAT_CLIP, "lat_g"), pick(long, LONG_CLIP, "long_g"), F.when(known, "imu").otherwise("gps").alias("origin"))


def check_text(merged: DataFrame) -> DataFrame:
    """(rec, text): what a recording's check (:func:`merged_fits`) says, in a line."""
    said = F.format_string("%s: lateral r %+.2f, longitudinal r %+.2f over %d samples", F.when(F.col("ok"), "IMU agrees with GPS").otherwise("IMU disagrees with GPS"), "r_lat", "r_long", "n")
    return merged.select("rec", said.alias("text"))


def peaks(series: DataFrame) -> DataFrame:
    """(rec, lateral_g, braking_g): the largest of each."""
    return series.groupBy(*REC).agg(F.max(F.abs("lat_g")).alias("lateral_g"), F.greatest(F.max(-F.col("long_g")), F.lit(0.0)).alias("braking_g"))


def g_at(times: DataFrame, series: DataFrame) -> DataFrame:
    """``times`` (rec, t) with the g of the nearest sample, the later one of two."""
    point = F.struct(F.col("t").alias("t"), "lat_g", "long_g")
    known = series.select("rec", "t", F.lit(0).alias("_k"), point.alias("_p"))
    extra = [c for c in times.columns if c not in ("rec", "t")]
    nothing = F.lit(None).cast(known.schema["_p"].dataType)
    asked = times.select("rec", "t", F.lit(1).alias("_k"), nothing.alias("_p"), *extra)
    both = united(known.select("*", *[F.lit(None).cast(times.schema[c].dataType).alias(c) for c in extra]), asked)
    both = both.withColumns({"_a": known_before("_p", REC, "t", "_k"), "_b": known_after("_p", REC, "t", "_k")}).where("_k = 1")
    later = F.col("_a").isNull() | (F.col("_b.t") - F.col("t") <= F.col("t") - F.col("_a.t"))
    near = F.when(later & F.col("_b").isNotNull(), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("_n", near).select("rec", "t", *extra, "_n.lat_g", "_n.long_g", F.sqrt(F.col("_n.lat_g") ** 2 + F.col("_n.long_g") ** 2).alias("total_g"))
