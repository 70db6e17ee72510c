"""Recordings as files: chapters of a camera, transponder lists, and the JSON stores of lines, tracks and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How a camera names the chapters of a recording.
CHAPTER = r"^G([XHLP])(\d{2})(\d{4})\.MP4$"

LINE = "array<array<double>>"
SIDECAR = f"version int, track string, start {LINE}, sectors array<{LINE}>, confirmed boolean"
ENTRY = "fingerprint string, stem string, track string, date string, lap_count int, best double, theoretical double, verified boolean, degraded boolean, dropout boolean, paths array<string>"
TRACK = f"name string, lat double, lon double, bbox array<double>, start {LINE}, sectors array<{LINE}>"


# Chapters


def chapters(files: DataFrame) -> DataFrame:
    """``files`` (path) with folder, name, prefix, chapter, number; the last three are null where a name isn't a camera's."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    up = F.upper(name)
    part = lambda i: F.nullif(F.regexp_extract(up, CHAPTER, i), F.lit(""))
    return files.withColumns({"folder": F.regexp_replace("path", r"/?[^/]*$", ""), "name": name, "prefix": part(1), "chapter": part(2).cast("int"), "number": part(3)})


def ordered(files: DataFrame) -> DataFrame:
    """Each path once, with ``place`` in its folder: other names first, then by number and chapter."""
    w = Window.partitionBy("folder").orderBy(F.col("number").asc_nulls_first(), "prefix", "chapter", "name")
    return chapters(files.dropDuplicates(["path"])).withColumn("place", F.row_number().over(w))


def siblings(files: DataFrame, path: str) -> DataFrame:
    """The chapters of the recording that ``path`` is part of, in order."""
    all_ = ordered(files)
    own = all_.where(F.col("path") == path).select("folder", "prefix", "number")
    return all_.join(own, ["folder", "prefix", "number"], "left_semi").orderBy("chapter")


def recordings(files: DataFrame) -> DataFrame:
    """(rec, folder, label, paths): chapters of one recording together, any other file by itself."""
    c = ordered(files)
    key = F.when(F.col("number").isNull(), F.col("path")).otherwise(F.concat_ws("/", "folder", F.concat(F.lit("G"), "prefix", "number")))
    g = c.withColumn("rec", key).groupBy("rec", "folder").agg(F.sort_array(F.collect_list(F.struct("chapter", "path", "name"))).alias("cs"))
    one = F.element_at("cs", 1)["name"]
    label = F.when(F.size("cs") > 1, F.format_string("%s (%d chapters)", one, F.size("cs"))).otherwise(one)
    return g.select("rec", "folder", label.alias("label"), F.col("cs.path").alias("paths"))


def chapter_map(durations: DataFrame) -> DataFrame:
    """``durations`` (rec, chapter, duration) with ``offset``: what comes before a chapter."""
    w = Window.partitionBy("rec").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    return durations.withColumn("offset", F.coalesce(F.sum("duration").over(w), F.lit(0.0)))


def to_local(times: DataFrame, mapped: DataFrame) -> DataFrame:
    """(rec, t, chapter, local): where a time of the whole recording is; the first before it, the last from its end on."""
    m = mapped.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("offset", "chapter", "duration"))).alias("_m"))
    begun = F.filter("_m", lambda c: c["offset"] <= F.col("t"))
    at = F.when(F.size(begun) > 0, F.element_at(begun, -1)).otherwise(F.element_at("_m", 1))
    joined = times.join(m, "rec").withColumn("_c", at)
    return joined.select(*times.columns, F.col("_c.chapter").alias("chapter"), F.least(F.greatest(F.col("t") - F.col("_c.offset"), F.lit(0.0)), F.col("_c.duration")).alias("local"))


def to_global(times: DataFrame, mapped: DataFrame) -> DataFrame:
    """(rec, chapter, local, t)."""
    return times.join(mapped.select("rec", "chapter", "offset"), ["rec", "chapter"]).withColumn("t", F.col("local") + F.col("offset")).drop("offset")


def joined_chapters(samples: DataFrame, mapped: DataFrame, t: str = "naive") -> DataFrame:
    """Samples of all chapters (rec, chapter, t) on the recording's one clock."""
    return samples.join(mapped.select("rec", "chapter", "offset"), ["rec", "chapter"]).withColumn(t, F.col(t) + F.col("offset")).drop("offset")


# Transponders


def lap_seconds(text: Column) -> Column:
    """Seconds of ``M:SS.mmm``; null for anything else."""
    ok = text.rlike(r"^\s*\d+:\d{1,2}(\.\d+)?\s*$")
    return F.when(ok, F.split_part(F.trim(text), F.lit(":"), F.lit(1)).cast("double") * 60 + F.split_part(F.trim(text), F.lit(":"), F.lit(2)).cast("double"))


def transponder(spark: SparkSession, path: str) -> DataFrame:
    """(lap_no, ref_s) of a transponder's list: its first and third field; rows without both are left out."""
    fields = F.split("value", ",")
    rows = spark.read.text(path).select(F.expr("try_cast(trim(split(value, ',')[0]) as int)").alias("lap_no"), lap_seconds(F.get(fields, 2)).alias("ref_s"))
    return rows.where("lap_no is not null and ref_s is not null")


# JSON stores: what can't be read is empty, never an error


def _line_ok(line: Column) -> Column:
    """Two points of two finite numbers."""
    point = lambda p: (F.size(p) == 2) & F.forall(p, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(line) == 2) & F.forall(line, point), F.lit(False))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, track, start, sectors, confirmed) of valid sidecars; without ``confirmed`` they are."""
    raw = spark.read.schema(f"{SIDECAR}, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    ok = F.col("_corrupt_record").isNull() & (F.col("version") == 1) & _line_ok(F.col("start")) & F.forall(F.coalesce("sectors", F.array().cast(f"array<{LINE}>")), _line_ok)
    return raw.where(ok).select(F.col("_metadata.file_path").alias("path"), "track", "start", F.coalesce("sectors", F.array().cast(f"array<{LINE}>")).alias("sectors"), F.coalesce("confirmed", F.lit(True)).alias("confirmed"))


def library(spark: SparkSession, path: str) -> DataFrame:
    """Entries of session libraries: those before version 2 get its fields, newer ones what is known of them; invalid ones go."""
    raw = spark.read.schema(f"version int, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    e = raw.where("version >= 1").select("version", F.inline("entries"))
    ok = F.col("fingerprint").isNotNull() & (F.length("fingerprint") > 0) & (F.col("best").isNull() | ((F.col("best") > 0) & (F.col("best") < float("inf")))) & F.coalesce(F.col("lap_count") >= 0, F.lit(True))
    defaults = {"verified": True, "degraded": False, "dropout": False}
    return e.where(ok).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """Known tracks (track, lat, lon, bbox, start, sectors) of a track store."""
    raw = spark.read.schema(f"version int, tracks array<struct<{TRACK.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    t = raw.select(F.inline("tracks"))
    ok = (F.length("name") > 0) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & _line_ok(F.col("start")) & (F.col("bbox").isNull() | (F.size("bbox") == 4))
    return t.where(ok).withColumnRenamed("name", "track")


def write_library(entries: DataFrame, path: str) -> None:
    """One JSON line for each entry, written beside and put in place by Spark's committer."""
    entries.withColumn("version", F.lit(2)).write.mode("overwrite").json(path)


def write_laps(laps: DataFrame, path: str) -> None:
    laps.write.mode("overwrite").option("header", True).csv(path)


def write_channels(channels: DataFrame, path: str) -> None:
    """Channels of each recording's laps, as Parquet by recording."""
    channels.write.mode("overwrite").partitionBy("rec").parquet(path)
