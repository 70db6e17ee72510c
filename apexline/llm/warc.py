"""Web archives, written and read by their index.

Writing: payloads are told apart by their SHA-256.  Of the records with equal
payloads, that with the largest key is a ``response``; the others are ``revisit``
records that refer to it and hold no payload.  Keys are combined by payload and
salt before they are shuffled, and records meet them by payload and salt, so a
payload that a third of all records share is dealt over ``SALTS`` keys.  Each task
writes archives of at most about ``ARCHIVE_BYTES``, every record a gzip member of
its own.  The index has a row for each record: archive, offset, length, URL, digest.
It is committed by Spark, and an attempt of a task writes archives of its own
names, so what a lost attempt has left is never read.

Reading: the wanted rows of the index are grouped by archive and ``SLOT`` of bytes;
a task sorts them by offset, joins ranges with less than ``GAP`` bytes between them,
reads each such range once and cuts the records out of it.  Lengths and digests
are checked.

Archives are read and written by ``pyarrow.fs``, in any store that it knows (a folder
that all executors share, HDFS, S3, GCS).

Defined results: a null payload is empty, and empty payloads are equal to each
other; payloads below ``min_bytes`` are all responses; a record with a null key is
nobody's response, and with nothing but such keys all are responses; repeated
rows with the response's key are responses too; a null URL is left out of the record;
an empty table has an index without rows and no archives.  Blanks, controls and
other characters than ASCII in URLs are percent-encoded in the archive; the index
has them as they were.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, lean, new_path

ARCHIVE_BYTES = 1 << 30
#: Bytes of an archive that are read by one task at once, and bytes between two records that are read along.
SLOT, GAP = 8 << 20, 64 << 10
SALTS = 64
LEVEL = 4
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION, RECORD = "WARC/1.1", "urn:x-record:"
INDEX = "archive string, offset long, length long, key string, url string, digest string, type string"
RECORDS = "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Spark knows by ``path``, and its path there."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest if rest else path)


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str, nameless: str) -> tuple[bytes, str]:
    """A record, and the digest of its payload."""
    found = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{RECORD}{quote(key, safe='')}>" if key is not None else f"<urn:x-nameless:{nameless}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head.append(("WARC-Payload-Digest", f"sha1:{found}"))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD}{quote(refers_to, safe='')}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "\r\n".join([VERSION, *[f"{k}: {v}" for k, v in head], "", ""]).encode() + block + b"\r\n\r\n", found


def _heads(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    """(first line, fields in lower case, what follows) of a head that an empty line ends."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse(raw: bytes) -> dict:
    """What a record says: key, URL, type, payload and what it refers to; its lengths and digest are checked."""
    version, head, rest = _heads(raw)
    size = int(head["content-length"])
    if version != VERSION or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"not a record of {size} bytes: {head.get('warc-record-id')}")
    _, http, payload = _heads(rest[:size])
    kind, digest_ = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (digest(payload) != digest_ or len(payload) != int(http["content-length"])):
        raise ValueError(f"payload and head differ: {head['warc-record-id']}")
    name = lambda x: unquote(x[1:-1].removeprefix(RECORD)) if x is not None and x[1:].startswith(RECORD) else None
    return {
        "key": name(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": int(http["content-length"]), "payload_digest": digest_,
        "record_type": kind, "refers_to": name(head.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }


def _write(path: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        out, archive, offset = None, "", 0

        def packed(raw: bytes) -> bytes:
            z = zlib.compressobj(LEVEL, wbits=31)
            return z.compress(raw) + z.flush()

        try:
            for batch in batches:
                rows = []
                for key, url, payload, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        archive, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(folder, recursive=True)
                        out = store.open_output_stream(f"{folder}/{archive}", compression=None)
                        info = b"software: apexline\r\nformat: WARC File Format 1.1\r\n"
                        head = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:{archive}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        offset += out.write(packed(head.encode() + info + b"\r\n\r\n"))
                    raw, found = record(key, url, (payload or "").encode(), response, date, f"{archive}:{offset}")
                    member = packed(raw)
                    out.write(member)
                    rows.append((archive, offset, len(member), key, url, found, "response" if response is None else "revisit"))
                    offset += len(member)
                yield pa.RecordBatch.from_pylist([dict(zip(("archive", "offset", "length", "key", "url", "digest", "type"), r, strict=True)) for r in rows], _INDEX)
        finally:
            if out is not None:
                out.close()

    return run


_INDEX = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split() for c in INDEX.split(", "))])
_RECORDS = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split() for c in RECORDS.split(", "))])


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write the pages' archives to ``path`` and give their index, a kept table."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), text.alias("payload"))
    rows = rows.withColumns({"print": F.unhex(F.sha2("payload", 256)), "salt": F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")})
    some = rows.where(F.octet_length("payload") >= min_bytes).groupBy("print", "salt").agg(F.max("key").alias("response"), F.count("*").alias("n"))
    equal = some.groupBy("print").agg(F.max("response").alias("response"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1 and response is not null")
    responses = equal.select("print", F.explode("salts").alias("salt"), "response")  # at most SALTS rows for a payload
    met = rows.join(responses.hint("shuffle_hash"), ["print", "salt"], "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("key")), F.col("response").cast("string"))
    return kept(met.select(F.col("key").cast("string"), "url", "payload", refers.alias("response")).mapInArrow(lean(_write(path, date)), INDEX), "index")


def ranges(places: list[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(from, to, places) of the reads that hold all ``places`` (offset, length), sorted; nearer ones than ``gap`` share a read."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in sorted(places):
        if out and offset - out[-1][1] <= gap:
            begin, end, inside = out[-1]
            inside.append((offset, length))
            out[-1] = (begin, max(end, offset + length), inside)
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def _read(path: str, payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        for batch in batches:
            for archive, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{folder}/{archive}") as f:
                    for begin, end, inside in ranges([(p["offset"], p["length"]) for p in places]):
                        data = memoryview(f.read_at(end - begin, begin))
                        rows = [parse(zlib.decompress(data[o - begin : o - begin + n], wbits=31)) for o, n in inside]
                        if not payload:
                            rows = [r | {"payload": None} for r in rows]
                        yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    return run


def read(index: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` (archive, offset, length) name, in archives at ``path``."""
    slots = index.groupBy("archive", F.floor(F.col("offset") / SLOT).alias("slot")).agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    return slots.select("archive", "places").mapInArrow(lean(_read(path, payload)), RECORDS)


def report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder, read these back and tell what they say."""
    path = new_path(pages.sparkSession, "archives")
    index = write(pages, path, min_bytes=min_bytes)
    return read(index, path, payload=False).select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def brute_force(pages: list[tuple[int | None, str | None]], min_bytes: int = 0) -> list[tuple]:
    """What :func:`report` gives, in one place; for tests."""
    largest: dict[bytes, int] = {}
    for i, html in pages:
        p = (html or "").encode()
        if i is not None and len(p) >= min_bytes:
            largest[p] = max(largest.get(p, i), i)
    out = []
    for i, html in pages:
        p = (html or "").encode()
        to = largest.get(p, i)
        out.append((i, len(p), digest(p), "response" if to == i else "revisit", None if to == i else to))
    return out
