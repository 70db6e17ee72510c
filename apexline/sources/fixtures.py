"""Traces and histories made from the driver's tables, in exact integers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import rounded
from . import gpmf, mp4
from .tables import materialised, new_path

#: Length of the circuit, a straight and an arc in centimetres; the timing line is LINE along the first straight.
LAP_CM, STRAIGHT_CM, ARC_CM, LINE_CM = 38_850, 10_000, 9_425, 5_000
#: Users whose events are one recording; their number grows with the events.
USERS = 25


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, seq, t, v, odo, dop, fix, x, y, lap_no): a drive around a stadium, from ``events``.

    Only the columns that it needs are read; everything is keyed by ``rec``.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(F.expr(f"user_id div {USERS}").alias("rec"), "ts", "event_id", "event_type", "value", k.alias("k"))
    w = Window.partitionBy("rec").orderBy("ts", "event_id")
    rows = rows.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).withColumn("v_cms", 1000 + F.expr("least(cast(round(value * 100) as bigint), 10000) div 5"))
    before = F.coalesce(F.sum("v_cms").over(Window.partitionBy("rec").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("odo_cm", F.floor(before / 10).cast("long"))
    r, d = F.lit(ARC_CM) / F.pi(), (F.col("odo_cm") % LAP_CM).cast("double")
    a, b = -F.pi() / 2 + (d - STRAIGHT_CM) / r, F.pi() / 2 + (d - 2 * STRAIGHT_CM - ARC_CM) / r
    leg = lambda one, two, three, four: F.when(d < STRAIGHT_CM, one).when(d < STRAIGHT_CM + ARC_CM, two).when(d < 2 * STRAIGHT_CM + ARC_CM, three).otherwise(four)
    x = leg(d, STRAIGHT_CM + r * F.cos(a), 2 * STRAIGHT_CM + ARC_CM - d, r * F.cos(b))
    y = leg(F.lit(0.0), r + r * F.sin(a), 2 * r, r + r * F.sin(b))
    return rows.select(
        "rec", "seq", (F.col("seq") * 100 / 1000.0).alias("t"), (F.col("v_cms") / 100.0).alias("v"), (F.col("odo_cm") / 100.0).alias("odo"),
        (F.expr("k * 10 div 9") / 10.0).alias("dop"), F.when((F.col("event_type") == "error") & (F.col("k") < 10), 2).otherwise(3).alias("fix"),
        rounded(x / 100, 6).alias("x"), rounded(y / 100, 6).alias("y"), F.expr(f"(odo_cm + {LAP_CM - LINE_CM}) div {LAP_CM}").alias("lap_no"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of recordings made from ``orders``: (fingerprint, track, date, best, verified, degraded, dropout)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").alias("fingerprint"), F.col("o_orderpriority").alias("track"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("best"),
        (F.col("o_orderstatus") != "P").alias("verified"), (F.col("o_custkey") % 17 == 0).alias("degraded"), (F.col("o_custkey") % 13 == 0).alias("dropout"),
    )


#: Fixes of a payload, and of a chapter.
PAYLOAD, CHAPTER = 10, 600


def camera_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path) of camera files that are written from the traces: a payload a second, a file for each CHAPTER of a recording."""
    folder = new_path(spark, "camera")
    t = trace(spark, sf_dir).select("rec", "seq", "v", "dop", "fix", "x", "y", F.expr(f"cast(seq div {CHAPTER} + 1 as int)").alias("chapter"))

    def write(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        rec, chapter = int(part["rec"].iloc[0]), int(part["chapter"].iloc[0])
        seq, v = part["seq"].to_numpy(np.int64), np.rint(part["v"].to_numpy(float) * 1000)
        rows = np.stack([np.rint((50 + part["y"].to_numpy(float) / 111_000) * 1e7), np.rint((7 + part["x"].to_numpy(float) / 71_000) * 1e7), np.zeros(len(part)), v, v, np.full(len(part), 8766.0), seq * 100.0, np.rint(part["dop"].to_numpy(float) * 100), part["fix"].to_numpy(float)], axis=1).astype(np.int64)
        scale = gpmf.packed("SCAL", "l", np.array([10**7, 10**7, 1000, 1000, 1000, 1, 1000, 100, 1]))
        cut = [rows[i : i + PAYLOAD] for i in range(0, len(rows), PAYLOAD)]
        made = [gpmf.nested("DEVC", gpmf.nested("STRM", scale + gpmf.packed("GPS9", "l", r))) for r in cut]
        path = f"{folder}/{rec // 10_000}/GX{chapter:02d}{rec % 10_000:04d}.MP4"
        where, name = mp4.store(path)
        where.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with where.open_output_stream(name, compression=None) as f:
            f.write(mp4.written(made, video=b"\0" * 5000))
        return pd.DataFrame({"path": [path]})

    return materialised(t.groupBy("rec", "chapter").applyInPandas(write, "path string"), "files")
