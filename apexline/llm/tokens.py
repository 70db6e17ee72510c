"""Token ids of whole texts in patched frame-of-reference files.

A file is a Parquet table in any store that Spark writes, with a row for each
*segment*: some whole documents' ids in order, the ids packed in blocks.

``part, segment``  place in the file; segments in this order hold the documents
                   in ascending ``doc_id`` order (nulls first, ties by text)
``first``          ids before the segment in its part
``doc_ids, n_tokens``  the segment's documents
``n_ids, payload``     the packed ids

A payload is, in little-endian order::

    u32 n_blocks, u32 block starts[n_blocks + 1]     (bytes from the end of this index)
    for each block of 1,024 ids (the last is filled up with its minimum):
      u32 minimum, u8 width, u16 n_exceptions,
      packed (id - minimum) mod 2**width,
      u16 places[n_exceptions], u32 high parts[n_exceptions]

The width holds the 99th percentile of the block's offsets from its minimum;
what needs more bits is an exception, whose high part is kept apart.  The index
of block starts lets :func:`decode` read a range of ids alone.

Texts are tokenised after the shuffle that orders them, so that text and not
ids are shuffled, and each task writes what it has made.  Defined results: a
null or empty text is the end id alone; repeated rows are all written; ids are
integers (others are an error, or null where casts give null); an empty
table gives an empty file.  No text is cut.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import lean, new_path, small_batches

BLOCK = 1024
PERCENTILE = 99
#: Ids at which a segment ends after the document it is in.
SEGMENT_IDS = 1 << 18
#: Pieces whose ids a task remembers before it starts anew.
REMEMBERED = 200_000
#: Bytes of text whose pieces are told apart at once.
CHUNK = 1 << 20
FILE = "part int, segment int, first long, doc_ids array<bigint>, n_tokens array<bigint>, n_ids long, payload binary"


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of BLOCK * width / 8 bytes, lowest bits first."""
    eights = values.reshape(-1, 8).astype(np.uint64)
    out = np.zeros((len(eights), width), np.uint8)
    for i in range(8):
        at, shift = divmod(i * width, 8)
        x = eights[:, i] << np.uint64(shift)
        for j in range((shift + width + 7) // 8):
            out[:, at + j] |= ((x >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
    return out.reshape(len(values), -1)


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    eights = data.reshape(-1, width).astype(np.uint64)
    out = np.empty((len(eights), 8), np.uint64)
    for i in range(8):
        at, shift = divmod(i * width, 8)
        x = np.zeros(len(eights), np.uint64)
        for j in range((shift + width + 7) // 8):
            x |= eights[:, at + j] << np.uint64(8 * j)
        out[:, i] = (x >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.reshape(len(data), BLOCK).astype(np.uint32)


def encode(ids: np.ndarray) -> bytes:
    """A payload of these ids, each below 2**32."""
    n_blocks = -(-len(ids) // BLOCK)
    filled = np.empty(n_blocks * BLOCK, np.uint32)
    filled[: len(ids)] = ids
    if len(filled) > len(ids):
        filled[len(ids) :] = ids[(n_blocks - 1) * BLOCK :].min()
    blocks = filled.reshape(n_blocks, BLOCK)
    low = blocks.min(axis=1, initial=0xFFFFFFFF)
    offsets = blocks - low[:, None]
    at = (BLOCK - 1) * PERCENTILE // 100
    width = _bit_lengths(np.partition(offsets, at, axis=1)[:, at]) if n_blocks else low.astype(np.int64)
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        data = _pack(offsets[rows] & np.uint32((1 << w) - 1), w)
        for i, row in enumerate(rows.tolist()):
            packed[row] = data[i].tobytes()
    high = offsets.astype(np.uint64) >> width[:, None].astype(np.uint64)
    row, place = np.nonzero(high)
    high, edge = high[row, place].astype("<u4"), np.searchsorted(row, np.arange(n_blocks + 1)).tolist()
    place = place.astype("<u2")
    parts = []
    for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        head = int(low[i]).to_bytes(4, "little") + int(width[i]).to_bytes(1, "little") + (b - a).to_bytes(2, "little")
        parts.append(head + packed[i] + place[a:b].tobytes() + high[a:b].tobytes())
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("<u4")
    return n_blocks.to_bytes(4, "little") + starts.tobytes() + b"".join(parts)


def decode(payload: bytes, n_ids: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids lo to hi - 1 of a payload; reads only their blocks."""
    hi = n_ids if hi is None else min(hi, n_ids)
    if hi <= lo:
        return np.empty(0, np.uint32)
    n_blocks = int.from_bytes(payload[:4], "little")
    starts = np.frombuffer(payload, "<u4", n_blocks + 1, 4)
    body, first, last = 8 + 4 * n_blocks, lo // BLOCK, -(-hi // BLOCK)
    out = np.empty((last - first, BLOCK), np.uint32)
    by_width: dict[int, list[tuple[int, int]]] = {}
    patches = []
    for i in range(first, last):
        at = body + int(starts[i])
        out[i - first] = int.from_bytes(payload[at : at + 4], "little")
        w, n = payload[at + 4], int.from_bytes(payload[at + 5 : at + 7], "little")
        by_width.setdefault(w, []).append((i - first, at + 7))
        if n:
            at += 7 + BLOCK * w // 8
            patches.append((i - first, w, np.frombuffer(payload, "<u2", n, at), np.frombuffer(payload, "<u4", n, at + 2 * n)))
    for w, rows in by_width.items():
        if w:
            data = np.frombuffer(b"".join([payload[at : at + BLOCK * w // 8] for _, at in rows]), np.uint8)
            out[[r for r, _ in rows]] += _unpack(data.reshape(len(rows), -1), w)
    for i, w, at, high in patches:
        out[i, at] += high << np.uint32(w)
    return out.reshape(-1)[lo - first * BLOCK : hi - first * BLOCK]


# Bytes of words that are cut into pieces by numpy: printable ASCII and the two-byte letters from U+00C0 to U+00FF, which are their own normal form.
# Any other word (with an apostrophe, another script, what may begin a special token) goes through the library whole.
_LETTER, _DIGIT, _SIGN, _OTHER, _LEAD = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x27] = _OTHER
_CLASS[0xC3] = _LEAD


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Recent(dict):
    """What ``make`` gives for a key, remembered while it is among the last ``size`` to 2 * ``size`` keys asked for."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: What a tokenizer file must say for words to be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


_loaded: dict[tuple, object] = {}


def _library(path: str):
    """The tokenizer of a file, read once by a process.

    Version 0.23 of the library keeps a cache of each tokenizer that a thread has used until the thread
    ends: a worker that read the file anew for each task grew by some 4 MB a task.
    """
    from tokenizers import Tokenizer

    found = os.stat(path)
    key = (path, found.st_mtime_ns, found.st_size)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer.from_file(path)
    return _loaded[key]


class Encoder:
    """Ids of UTF-8 texts, equal to the library's ``encode(text, add_special_tokens=False)``.

    A file whose normaliser and pre-tokeniser are those above never joins what
    white space parts, so its texts are cut at ASCII white space, each distinct
    word of a chunk is encoded once, and the ids are laid out by numpy.  Texts of
    any other file go through the library whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.remembered = remembered
        self.library = _library(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.begins = [np.frombuffer(x.encode()[:2].ljust(2), np.uint8) for x in self.special]
        plain = all(not t.normalized and not t.lstrip and not t.rstrip and not re.search(r"\s", t.content) for t in self.library.get_added_tokens_decoder().values())
        how = lambda part: json.loads(part.__getstate__()) if part is not None else None
        self.by_words = plain and how(self.library.normalizer) == _NORMALIZER and how(self.library.pre_tokenizer) == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and type(self.model).__name__ == "BPE"

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode() if piece.isascii() else "".join([self.letters[b] for b in piece])
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _known(self, keys: list[bytes], memo: dict[bytes, bytes], make) -> list[bytes]:
        """What ``make`` gives for each key, remembered in ``memo`` until that has more than it may."""
        if len(memo) > self.remembered:
            memo.clear()
        out = list(map(memo.get, keys))
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = memo[keys[i]] = make(keys[i])
        return out

    def _word(self, word: bytes) -> bytes:
        return self._whole(word.decode())

    def _cut(self, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-case bytes of the words without what is between them, begins of pieces or whole words in these, which are whole words, the first piece of each text)."""
        size = w.end - w.start
        first = np.cumsum(size) - size  # where the words begin
        data = w.bytes_[np.repeat(w.start - first, size) + np.arange(int(size.sum()))]
        kind = _CLASS[data]
        lead = np.flatnonzero(kind == _LEAD)  # always followed by a byte of the same character
        second = data[lead + 1]
        fine = (second != 0x97) & (second != 0xB7)
        kind[lead], kind[lead + 1] = np.where(fine, _LETTER, _OTHER), np.where(fine, _LETTER, _OTHER)
        odd = kind == _OTHER
        for a, b in self.begins:
            odd[:-1] |= (data[:-1] == a) & (data[1:] == b)
        odd_words = np.add.reduceat(odd, first, dtype=np.int64) > 0
        cut = np.ones(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[np.repeat(odd_words, size)] = False
        cut[first] = True
        lower = W.LOWER[data]
        upper = lead[fine & (second < 0x9F)] + 1
        lower[upper] = data[upper] + 0x20
        # Whole words keep their case, for the library.
        whole = np.repeat(odd_words, size)
        lower[whole] = data[whole]
        begin = np.flatnonzero(cut)
        at_text = np.searchsorted(begin, np.append(first, len(data)))[w.first]
        return lower, begin, odd_words[np.searchsorted(first, begin, "right") - 1], at_text

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts ``data[offsets[d]:offsets[d + 1]]``, how many each has)."""
        if not self.by_words:
            ids = [self._whole(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.frombuffer(b"".join(ids), "<u4"), np.array([len(i) // 4 for i in ids], np.int64)
        w = W.find(data, offsets)
        if not len(w.start):
            return np.empty(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        lower, begin, whole, text_first = self._cut(w)
        edges = np.append(begin, len(lower)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(lower)])
        # Each distinct piece is encoded once; a whole word may look like a piece, so the two are told apart.
        flat, sizes, at, known = [], [], np.empty(len(begin), np.int64), 0
        for which, memo in ((np.flatnonzero(~whole), (self.pieces, self._piece)), (np.flatnonzero(whole), (self.words, self._word))):
            if len(which):
                some = (runs if len(which) == len(runs) else runs.take(pa.array(which))).dictionary_encode()
                ids = self._known(some.dictionary.to_pylist(), *memo)
                flat += ids
                sizes += map(len, ids)
                at[which] = np.asarray(some.indices) + known
                known += len(ids)
        flat, sizes = np.frombuffer(b"".join(flat), "<u4"), np.array(sizes, np.int64) // 4
        counts = sizes[at]
        ends = np.cumsum(counts)
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - counts), counts)
        return flat[place + np.arange(len(place))], np.diff(np.append(0, ends)[text_first])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, remembered: int = REMEMBERED) -> None:
    """Write the ids of all documents, ``end_id`` after each, to ``path`` in ascending ``doc_id`` order.

    Smaller ``chunk`` (bytes of text worked on at once) and ``remembered`` (pieces) take less memory and more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(tokenizer, remembered), TaskContext.get().partitionId()
        segment, before, doc_ids, n_tokens, held, size = 0, 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            values = [[part], [segment], [before], [pa.concat_arrays(doc_ids)], [np.concatenate(n_tokens)], [len(ids)], [encode(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "segment", "first", "doc_ids", "n_tokens", "n_ids", "payload"])

        for batch in batches:
            for lo, to, data, offsets in W.chunks(batch.column(1), size=chunk):
                found, counts = encoder(data, offsets)
                # The end id after each document's own.
                own, ids = np.arange(len(found)) + np.repeat(np.arange(to - lo), counts), np.full(len(found) + to - lo, end_id, "<u4")
                ids[own] = found
                counts = counts + 1
                ends, at = np.cumsum(counts), 0
                while at < to - lo:
                    done = int(ends[at - 1]) if at else 0
                    stop = min(to - lo, int(np.searchsorted(ends, done + SEGMENT_IDS - size)) + 1)
                    doc_ids.append(batch.column(0).slice(lo + at, stop - at))
                    n_tokens.append(counts[at:stop])
                    held.append(ids[done : int(ends[stop - 1])])
                    size += len(held[-1])
                    at = stop
                    if size >= SEGMENT_IDS:
                        yield row()
                        segment, before, doc_ids, n_tokens, held, size = segment + 1, before + size, [], [], [], 0
        if held:
            yield row()

    ordered = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).repartitionByRange("d", F.xxhash64("t")).sortWithinPartitions("d", F.xxhash64("t"), "t")
    with small_batches(docs.sparkSession):
        ordered.select("d", "t").mapInArrow(lean(run), FILE).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The file's segments, ``start`` being the ids of all documents before each."""
    segments = spark.read.schema(FILE).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each task that wrote
    before, starts = 0, []
    for part, n in totals:
        starts.append((part, before))
        before += n
    table = spark.createDataFrame(starts, "part int, at long")
    return segments.join(F.broadcast(table), "part").withColumn("start", F.col("at") + F.col("first")).drop("at")


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """A row for each document of the file: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, doc_ids, n_tokens, n_ids, payload = (batch.column(k)[i] for k in range(5))
                values = decode(payload.as_py(), n_ids.as_py()).astype("<u4")
                counts = np.array(n_tokens.values, np.int64)
                ends = np.cumsum(counts)
                data = memoryview(values.tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                out = [doc_ids.values, pa.array(start.as_py() + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    columns = read_segments(spark, path).select("start", "doc_ids", "n_tokens", "n_ids", "payload")
    return columns.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def report(docs: DataFrame, tokenizer: str | None = None, chunk: int = CHUNK, remembered: int = REMEMBERED) -> DataFrame:
    """Write all documents' ids to the shared folder and tell, from the file, where each document's ids stand."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer or default_tokenizer(), chunk=chunk, remembered=remembered)
    return read_tokens(docs.sparkSession, path, ids=False)
