"""Metadata tracks of camera files: the table of samples, and payloads read by byte ranges.

A file's table of samples says where each payload lies and when it was taken; video
and sound are never read.  :func:`payloads` reads the tables of any number of files on
the executors, deals the payloads out by file and SLOT of bytes, and reads neighbours at
once.  :class:`CameraSource` is the same as a data source for the files of one
recording: ``spark.read.format("camera").option("path", ...)``; its partitions are planned by byte
ranges.  Both give (path, n, t_in, t_out, payload), which ``gpmf`` decodes.

A file without a metadata track, or cut off before its table, has no payloads; a
payload that is cut off is left out.  Files are read by ``pyarrow.fs``: folders that all executors share,
HDFS, S3, GCS.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.house import known_after, known_before, united

#: Fixed values of the format: what a metadata track is called, and its samples' format.
HANDLER, FORMAT = b"meta", b"gpmd"
#: Bytes of a file that one task reads payloads of, and bytes between two payloads that are read along.
SLOT, GAP = 64 << 20, 64 << 10
PAYLOADS = "path string, n int, t_in double, t_out double, payload binary"
_ROWS = pa.schema([("path", pa.string()), ("n", pa.int32()), ("t_in", pa.float64()), ("t_out", pa.float64()), ("payload", pa.binary())])


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that Spark knows, and the path there."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest if rest else path)


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the bodies of the boxes in ``data[at:end]``; what is cut off or malformed ends it."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind, head = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8], 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def inside(data: bytes, path: tuple[bytes, ...], at: int = 0, end: int | None = None) -> tuple[int, int] | None:
    """Where the first box with this path of kinds lies."""
    for kind, a, b in boxes(data, at, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else inside(data, path[1:], a, b)
    return None


def _table(data: bytes, span: tuple[int, int] | None, columns: int, skip: int = 4) -> np.ndarray:
    """The rows of 32-bit numbers of a table box, whose count stands after ``skip`` bytes."""
    if span is None:
        return np.empty((0, columns), np.int64)
    a, b = span
    n = min(struct.unpack_from(">I", data, a + skip)[0], (b - a - skip - 4) // (4 * columns)) if b - a >= skip + 4 else 0
    return np.frombuffer(data, ">u4", n * columns, a + skip + 4).reshape(n, columns).astype(np.int64)


def samples(moov: bytes) -> np.ndarray:
    """Rows (offset, size, t_in, t_out) of the metadata track's samples; without such a track none."""
    for kind, a, b in boxes(moov):
        if kind != b"trak":
            continue
        hdlr, mdhd, stbl = (inside(moov, p, a, b) for p in ((b"mdia", b"hdlr"), (b"mdia", b"mdhd"), (b"mdia", b"minf", b"stbl")))
        if None in (hdlr, mdhd, stbl) or moov[hdlr[0] + 8 : hdlr[0] + 12] != HANDLER:
            continue
        part = lambda kind, s=stbl: inside(moov, (kind,), *s)
        stsd = part(b"stsd")
        if stsd is None or moov[stsd[0] + 12 : stsd[0] + 16] != FORMAT:
            continue
        scale = struct.unpack_from(">I", moov, mdhd[0] + (20 if moov[mdhd[0]] else 12))[0] or 1
        sizes = part(b"stsz")
        if sizes is None:
            continue
        fixed, count = struct.unpack_from(">II", moov, sizes[0] + 4)
        size = np.full(count, fixed, np.int64) if fixed else _table(moov, sizes, 1, 8)[:, 0]
        wide = part(b"co64")
        chunk = _table(moov, wide, 2) if wide else _table(moov, part(b"stco"), 1)
        chunk = (chunk[:, 0] << 32 | chunk[:, 1]) if wide else chunk[:, 0]
        # How many samples each chunk has: a run of chunks for each row of the table.
        runs = _table(moov, part(b"stsc"), 3)
        if not len(runs) or not len(chunk):
            continue
        per = np.repeat(runs[:, 1], np.maximum(np.diff(np.append(runs[:, 0], len(chunk) + 1)), 0))[: len(chunk)]
        first = np.cumsum(per) - per
        n = min(int(per.sum()), len(size))
        of = np.repeat(np.arange(len(per)), per)[:n]
        before = np.cumsum(size[:n]) - size[:n]
        starts = np.append(before, 0)[np.minimum(first, n)]
        times = _table(moov, part(b"stts"), 2)
        step = np.repeat(times[:, 1], times[:, 0])[:n]
        step = np.append(step, np.full(n - len(step), step[-1] if len(step) else 0))
        ends = np.cumsum(step)
        return np.stack([chunk[of] + before - starts[of], size[:n], (ends - step) / scale, ends / scale], axis=1)
    return np.empty((0, 4))


def index(path: str) -> np.ndarray:
    """:func:`samples` of a file; only the heads of its boxes and its table are read."""
    where, name = store(path)
    with where.open_input_file(name) as f:
        at, end = 0, f.size()
        while at + 8 <= end:
            head = f.read_at(min(16, end - at), at)
            size, kind = struct.unpack_from(">I", head)[0], head[4:8]
            skip = 8
            if size == 1 and len(head) == 16:
                size, skip = struct.unpack_from(">Q", head, 8)[0], 16
            size = size or end - at
            if size < skip or at + size > end:
                break
            if kind == b"moov":
                return samples(f.read_at(size - skip, at + skip))
            at += size
    return np.empty((0, 4))


def _read(path: str, rows: list[tuple[int, int, int, float, float]]) -> Iterator[tuple]:
    """(path, n, t_in, t_out, payload) of rows (offset, size, n, t_in, t_out); neighbours are read at once."""
    where, name = store(path)
    reads: list[list[tuple]] = []
    for row in sorted(rows):
        if reads and row[0] - (reads[-1][-1][0] + reads[-1][-1][1]) <= GAP:
            reads[-1].append(row)
        else:
            reads.append([row])
    with where.open_input_file(name) as f:
        for group in reads:
            begin = group[0][0]
            data = f.read_at(max(o + s for o, s, *_ in group) - begin, begin)
            for offset, size, n, t_in, t_out in group:
                payload = data[offset - begin : offset - begin + size]
                if len(payload) == size:
                    yield path, n, t_in, t_out, payload


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = index(path)
            if len(rows):
                whole = rows[:, :2].astype(np.int64)
                columns = [pa.array([path] * len(rows), pa.string()), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(np.ascontiguousarray(rows[:, 2])), pa.array(np.ascontiguousarray(rows[:, 3]))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "n", "offset", "size", "t_in", "t_out"])


def table(files: DataFrame) -> DataFrame:
    """(path, n, offset, size, t_in, t_out): the samples of the metadata tracks of ``files`` (path), read on the executors."""
    return _dealt(files.select("path").where("path is not null")).distinct().mapInArrow(_indexed, "path string, n int, offset long, size long, t_in double, t_out double")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by path into as many parts as shuffles have: paths are short, and by their bytes few tasks would open all files."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def payloads(files: DataFrame) -> DataFrame:
    """(path, n, t_in, t_out, payload) of ``files`` (path)."""
    slots = _dealt(table(files)).groupBy("path", F.floor(F.col("offset") / SLOT).alias("slot")).agg(F.collect_list(F.struct("offset", "size", "n", "t_in", "t_out")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(_read(path, [tuple(r.values()) for r in rows]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), _ROWS, strict=True)], schema=_ROWS)

    return slots.select("path", "rows").mapInArrow(run, PAYLOADS)


@dataclass
class Span(InputPartition):
    """Payloads of a file that one task reads."""

    path: str
    rows: list[tuple[int, int, int, float, float]]


class CameraReader(DataSourceReader):
    def __init__(self, paths: list[str], slot: int):
        self.paths, self.slot = paths, slot

    def partitions(self) -> list[Span]:
        out = []
        for path in self.paths:
            spans: dict[int, list] = {}
            for n, (offset, size, t_in, t_out) in enumerate(index(path).tolist()):
                spans.setdefault(int(offset) // self.slot, []).append((int(offset), int(size), n, t_in, t_out))
            out += [Span(path, rows) for _, rows in sorted(spans.items())]
        return out or [Span("", [])]

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.rows:
            yield from _read(partition.path, partition.rows)


class CameraSource(DataSource):
    """``camera``: the files named by ``path`` (several by commas, or a folder's .mp4 files), partitions of ``slotBytes``.

    The files' tables are read where the query is planned, so it is meant for a recording's
    chapters; for many files use :func:`payloads`.
    """

    @classmethod
    def name(cls) -> str:
        return "camera"

    def schema(self) -> str:
        return PAYLOADS

    def reader(self, schema) -> DataSourceReader:
        paths = []
        for path in self.options["path"].split(","):
            where, name = store(path)
            if where.get_file_info(name).type == fs.FileType.Directory:
                prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
                found = where.get_file_info(fs.FileSelector(name))
                paths += sorted(prefix + f.path for f in found if f.is_file and f.path.lower().endswith(".mp4"))
            else:
                paths.append(path)
        return CameraReader(paths, int(self.options.get("slotBytes", SLOT)))


def register(spark: SparkSession) -> None:
    """Make ``camera`` known to a session."""
    spark.dataSource.register(CameraSource)


# The cursor of a recording: spans, durations, and the payload at a time.


def durations(payloads_: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, payloads, duration): how many payloads there are, and when the last one ends."""
    return payloads_.groupBy(*keys).agg(F.count("*").alias("payloads"), F.max("t_out").alias("duration"))


def seek(times: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``times`` (keys, t) with the payload (n, t_in, t_out) that covers t: it begins at or before t and ends after it.

    Before the first payload it is the first, from the last one's end on the last; in a hole between two it is the later one.
    ``at_end`` tells that t lies beyond the last payload.  Payloads and times are swept once, with no join on times.
    """
    extra = [c for c in times.columns if c not in (*keys, "t")]
    mark = F.struct("n", "t_in", "t_out")
    known = spans.select(*keys, F.col("t_out").alias("t"), F.lit(0).alias("_k"), mark.alias("_p"), *[F.lit(None).cast(times.schema[c].dataType).alias(c) for c in extra])
    asked = times.select(*keys, "t", F.lit(1).alias("_k"), F.lit(None).cast(known.schema["_p"].dataType).alias("_p"), *extra)
    # A payload that ends at t is past: times stand after ends that equal them.
    both = united(known, asked).withColumns({"_b": known_after("_p", list(keys), "t", "_k"), "_a": known_before("_p", list(keys), "t", "_k")}).where("_k = 1")
    p = F.coalesce("_b", "_a")
    return both.select(*keys, "t", *extra, *[p[c].alias(c) for c in ("n", "t_in", "t_out")], F.col("_b").isNull().alias("at_end"))


def written(payloads_: list[bytes], scale: int = 1000, step: int = 1000, per_chunk: int = 3, wide: bool = False, video: bytes = b"") -> bytes:
    """A file with a metadata track of these payloads, and ``video`` between its chunks; for tests and fixtures."""
    box = lambda kind, *body: struct.pack(">I", 8 + sum(map(len, body))) + kind + b"".join(body)
    start = box(b"ftyp", b"mp41\0\0\0\0")
    body, offsets = [], []
    for i in range(0, len(payloads_), per_chunk):
        body.append(video)
        offsets.append(len(start) + 16 + sum(map(len, body)))
        body += payloads_[i : i + per_chunk]
    data = b"".join(body)
    mdat = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + len(data)) + data
    full = lambda kind, *numbers: box(kind, b"\0\0\0\0", *[struct.pack(">I", n) for n in numbers])
    last = len(payloads_) % per_chunk
    runs = [(1, per_chunk, 1)] if len(payloads_) >= per_chunk else []
    runs += [(len(offsets), last, 1)] if last else []
    places = full(b"co64", len(offsets), *[x for o in offsets for x in (o >> 32, o & 0xFFFFFFFF)]) if wide else full(b"stco", len(offsets), *offsets)
    stbl = box(
        b"stbl", box(b"stsd", struct.pack(">III", 0, 1, 16), FORMAT, b"\0" * 8),
        full(b"stts", 1, len(payloads_), step), full(b"stsz", 0, len(payloads_), *map(len, payloads_)), full(b"stsc", len(runs), *[x for r in runs for x in r]), places,
    )
    hdlr = lambda kind: box(b"hdlr", b"\0" * 8, kind, b"\0" * 13)
    mdhd = full(b"mdhd", 0, 0, scale, step * len(payloads_), 0)
    other = box(b"trak", box(b"mdia", mdhd, hdlr(b"vide"), box(b"minf", box(b"stbl"))))
    return start + mdat + box(b"moov", other, box(b"trak", box(b"mdia", mdhd, hdlr(HANDLER), box(b"minf", stbl))))
