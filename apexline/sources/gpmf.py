"""Fixes and motion samples from a camera's metadata payloads.

Input is a table of payloads (rec, chapter, t_in, t_out, payload), the metadata
track's samples as a demuxer gives them, a megabyte or so a minute.  A payload is
nested items in big-endian order: four letters, a type letter, the size of an
element, how many, and the data, filled up to four bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Number types by letter, streams of motion, and the day from which GPS9 counts.
NUMBERS = {"b": "i1", "B": "u1", "s": ">i2", "S": ">u2", "l": ">i4", "L": ">u4", "f": ">f4", "d": ">f8", "j": ">i8", "J": ">u8"}
MOTION = ("ACCL", "GRAV", "CORI")
DAYS_FROM_MS = 946_684_800_000

FIXES = "rec string, chapter int, k int, n int, naive double, lat double, lon double, altitude double, ground_speed double, full_speed double, ts_ms long, utc string, dop double, fix int"
SAMPLES = "rec string, chapter int, stream string, t double, w double, x double, y double, z double"


def items(data: bytes) -> Iterator[tuple[str, str, int, int, bytes]]:
    """(key, type, element size, elements, data); what is cut off or malformed ends it."""
    at = 0
    while at + 8 <= len(data):
        key, kind, size, n = data[at : at + 4], data[at + 4], data[at + 5], struct.unpack_from(">H", data, at + 6)[0]
        end = at + 8 + size * n
        if key == b"\0\0\0\0" or end > len(data):
            return
        yield key.decode("latin-1"), chr(kind) if kind else "", size, n, data[at + 8 : end]
        at = end + -end % 4


def _numbers(kinds: str, size: int, n: int, body: bytes) -> np.ndarray | None:
    """The rows of ``n`` elements of these number types; None if the types don't make up an element's size."""
    kinds = "".join(c for c in kinds if c in NUMBERS)
    if not n or not kinds:
        return None
    if len(set(kinds)) == 1:
        one = np.dtype(NUMBERS[kinds[0]])
        return np.frombuffer(body, one, n * len(kinds)).reshape(n, len(kinds)).astype(float) if one.itemsize * len(kinds) == size else None
    row = np.dtype([(str(i), NUMBERS[c]) for i, c in enumerate(kinds)])
    if row.itemsize != size:
        return None
    table = np.frombuffer(body, row, n)
    return np.stack([table[c].astype(float) for c in row.names], axis=1)


def streams(data: bytes) -> Iterator[tuple[str, np.ndarray, dict]]:
    """(key, scaled rows of numbers, what the stream says besides) of each known stream."""
    for _, kind, _, _, inner in items(data):
        if kind:
            continue
        for key, kind2, _, _, stream in items(inner):
            if key != "STRM" or kind2:
                continue
            said: dict = {}
            for name, k, size, n, body in items(stream):
                if name == "TYPE":
                    said["types"] = body.rstrip(b"\0").decode("latin-1")
                elif name == "GPSU":
                    said["utc"] = body.decode("latin-1").strip("\0 ")
                elif name in ("GPSF", "GPSP") and k in NUMBERS and body:
                    said[name] = float(np.frombuffer(body, NUMBERS[k], 1)[0])
                elif name == "SCAL" and k in NUMBERS:
                    said["scale"] = np.frombuffer(body, NUMBERS[k]).astype(float)
                elif name in (*MOTION, "GPS5", "GPS9"):
                    kinds = said.get("types", "") if k == "?" else k * (size // max(1, np.dtype(NUMBERS.get(k, "u1")).itemsize))
                    values = _numbers(kinds, size, n, body)
                    if values is not None:
                        scale = said.get("scale", np.ones(1))
                        yield name, values / (scale if len(scale) in (1, values.shape[1]) else 1), said


def fixes(payloads: DataFrame) -> DataFrame:
    """(rec, chapter, k, n, naive, lat, lon, ..., ts_ms, dop, fix): every fix, spread evenly over its payload.

    GPS9 fixes carry their own time and quality; the fixes of a GPS5 payload all
    get the time that it names (null without one), and their quality is unknown (-1).
    A batch's columns are put together from its streams' tables, not fix by fix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64()}[t]) for n, t in (c.split() for c in FIXES.split(", "))])
        for batch in batches:
            heads, tables, texts = [], [], []
            for row, data in enumerate(batch.column("payload").to_pylist()):
                for key, v, said in streams(data or b""):
                    n, width = v.shape
                    if n and (key == "GPS9" and width >= 7 or key == "GPS5" and width >= 5):
                        # Place, speeds, day, second, dop and fix; a GPS5 fix has no day and second, what isn't known is -1.
                        full = np.full((n, 9), -1.0)
                        own = min(width, 9) if key == "GPS9" else 5
                        full[:, :own] = v[:, :own]
                        heads.append((row, n, key == "GPS9"))
                        tables.append(full)
                        texts.append(None if key == "GPS9" else said.get("utc"))
            if not heads:
                continue
            rows, counts, timed = (np.array(c) for c in zip(*heads, strict=True))
            v, n, at = np.concatenate(tables), np.repeat(counts, counts), np.repeat(rows, counts)
            k = np.arange(len(v)) - np.repeat(np.cumsum(counts) - counts, counts)
            a, b = (batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("t_in", "t_out"))
            known, ms = np.repeat(timed, counts), np.zeros(len(v))
            ms[known] = DAYS_FROM_MS + v[known, 5] * 86_400_000 + v[known, 6] * 1000
            columns = [
                *[batch.column(c).take(pa.array(at)) for c in ("rec", "chapter")], pa.array(k, pa.int32()), pa.array(n, pa.int32()), pa.array(a + (b - a) * k / n), *[pa.array(np.ascontiguousarray(v[:, i])) for i in range(5)],
                pa.array(ms.astype(np.int64), mask=~known), pa.array(texts, pa.string()).take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(np.ascontiguousarray(v[:, 7])), pa.array(v[:, 8].astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    raw = payloads.select(F.col("rec").cast("string").alias("rec"), F.col("chapter").cast("int").alias("chapter"), F.col("t_in").cast("double").alias("t_in"), F.col("t_out").cast("double").alias("t_out"), "payload")
    named = F.unix_millis(F.try_to_timestamp(F.concat("utc", F.lit("Z")), F.lit("yyMMddHHmmss.SSSX")))
    return raw.mapInArrow(run, FIXES).withColumn("ts_ms", F.coalesce("ts_ms", named)).drop("utc")


def motion(payloads: DataFrame) -> DataFrame:
    """(rec, chapter, stream, t, w, x, y, z): motion samples, spread evenly; only quaternions have w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rec, chapter, a, b, data in zip(*(batch.column(c).to_pylist() for c in ("rec", "chapter", "t_in", "t_out", "payload")), strict=True):
                for key, v, _ in streams(data or b""):
                    if key in MOTION and v.shape[1] in (3, 4):
                        n = len(v)
                        w = pa.array(v[:, 0]) if v.shape[1] == 4 else pa.nulls(n, pa.float64())
                        columns = [pa.array([rec] * n, pa.string()), pa.array([chapter] * n, pa.int32()), pa.array([key] * n), pa.array(a + (b - a) * np.arange(n) / n), w, *[pa.array(np.ascontiguousarray(v[:, i])) for i in (-3, -2, -1)]]
                        yield pa.RecordBatch.from_arrays(columns, names=["rec", "chapter", "stream", "t", "w", "x", "y", "z"])

    raw = payloads.select(F.col("rec").cast("string").alias("rec"), F.col("chapter").cast("int").alias("chapter"), F.col("t_in").cast("double").alias("t_in"), F.col("t_out").cast("double").alias("t_out"), "payload")
    return raw.mapInArrow(run, SAMPLES)


def packed(key: str, kind: str, rows: np.ndarray) -> bytes:
    """An item with rows of numbers; with :func:`nested`, for tests and for writing payloads."""
    body = rows.astype(NUMBERS[kind]).tobytes()
    size = rows.shape[1] * np.dtype(NUMBERS[kind]).itemsize if rows.ndim > 1 else np.dtype(NUMBERS[kind]).itemsize
    return key.encode() + kind.encode() + bytes([size]) + struct.pack(">H", len(rows)) + body + b"\0" * (-len(body) % 4)


def nested(key: str, inner: bytes) -> bytes:
    return key.encode() + b"\0" + bytes([1]) + struct.pack(">H", len(inner)) + inner + b"\0" * (-len(inner) % 4)
