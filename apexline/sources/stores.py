"""Stores of sessions and tracks that are written again and again, by any Hadoop file system.

A store is a folder of JSON objects ``{"version": 2, "entries": [...]}`` (``tracks`` for
tracks), each with up to ENTRIES rows, so that no task writes more.  It is written to a
folder beside, which takes its place by two renames: the old store moves to
``<path>.old``, the new one in.  A write that fails leaves the old store as it was, and a
reader between the renames takes ``<path>.old``.  A store that can't be understood (no object
with a version, or one of a later version) is kept as ``<path>.bak`` instead of being deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of what is written, and rows of one object.
VERSION, ENTRIES = 2, 10_000


def _files(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and a function that makes its paths."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def place(spark: SparkSession, path: str) -> str | None:
    """Where the store is to be read: its path, or what a write has set aside; None without one."""
    files, at = _files(spark, path)
    return next((p for p in (path, f"{path}.old") if files.exists(at(p))), None)


def understood(spark: SparkSession, path: str) -> bool:
    """Whether every object of a store says a version that is known."""
    raw = spark.read.schema("version int, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where(F.col("_bad").isNotNull() | F.col("version").isNull() | (F.col("version") > VERSION) | (F.col("version") < 1)).isEmpty()


def save(rows: DataFrame, path: str, name: str = "entries") -> None:
    """Write ``rows`` as the store at ``path``."""
    spark = rows.sparkSession
    files, at = _files(spark, path)
    aside, old, new = f"{path}.bak", f"{path}.old", f"{path}.{uuid.uuid4().hex}.new"
    count = rows.count()
    parts = max(1, -(-count // ENTRIES))
    placed = rows.select(F.struct(*rows.columns).alias("_e")).withColumn("_part", F.pmod(F.xxhash64(F.to_json("_e")), F.lit(parts)))
    objects = placed.groupBy("_part").agg(F.collect_list("_e").alias(name)).select(F.lit(VERSION).alias("version"), name)
    if not count:
        objects = spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(None).cast(objects.schema[name].dataType).alias(name)).withColumn(name, F.coalesce(name, F.array().cast(objects.schema[name].dataType)))
    try:
        # A reader takes one object from each file.
        objects.write.option("maxRecordsPerFile", 1).json(new)
        if files.exists(at(path)):
            safe = understood(spark, path)
            if files.exists(at(old)):
                files.delete(at(old), True)
            if not files.rename(at(path), at(old)):
                raise OSError(f"can't set {path} aside")
            if not files.rename(at(new), at(path)):
                files.rename(at(old), at(path))
                raise OSError(f"can't put {new} in place")
            if not safe:
                if files.exists(at(aside)):
                    files.delete(at(aside), True)
                files.rename(at(old), at(aside))
            else:
                files.delete(at(old), True)
        elif not files.rename(at(new), at(path)):
            raise OSError(f"can't put {new} in place")
        elif files.exists(at(old)):
            files.delete(at(old), True)
    finally:
        if files.exists(at(new)):
            files.delete(at(new), True)


def clear(spark: SparkSession, path: str) -> None:
    """Remove a store, and what was set aside of it but for ``.bak``."""
    files, at = _files(spark, path)
    for p in (path, f"{path}.old"):
        if files.exists(at(p)):
            files.delete(at(p), True)
