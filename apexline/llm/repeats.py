"""Substring deduplication: super-k-mer partitioning.

A window is ``window`` consecutive words of one text.  Every word covered by a
window whose words also start elsewhere, in the same text or another, is
removed; windows are judged on the input.

Each window has a minimiser, the smallest hash of its runs of ``MER`` words.
Consecutive windows with the same minimiser make one super-k-mer, which goes to
the bucket of that minimiser as one row, so that equal windows meet in one
bucket.  What travels is decided in three steps, each smaller than the last:

1.  For each minimiser, sums over its super-k-mers tell whether it has one only
    (no window of it repeats: gone), many that are all equal (128 bits of
    fingerprint; every window of them repeats), or different ones.  The sums
    are combined before the shuffle, so a passage that a third of all texts
    share is a row for each task.
2.  Of different super-k-mers of a minimiser, one of each equal set travels to
    the bucket as a packed string of its words.  There the windows are sorted
    and counted; windows with equal hashes are compared word by word.
3.  A minimiser with more than ``MANY`` different strings is not gathered in
    one task: its strings are cut into windows, which are counted by their
    words with a grouping that combines before it shuffles.

Text moves compressed: once for the packed strings, once for the results.

Defined results: a null, empty or short text has no windows and loses nothing;
repeated rows are different texts with equal windows; an empty table gives an
empty result; columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .decontaminate import _ranges
from .shared import fresh, kept, lean

MER = 8
#: Windows of a super-k-mer, at most: longer runs are cut.
LONGEST = 256
#: Different strings of a minimiser that one task sorts, at most.
MANY = 1 << 15
#: Words that a task sorts at once, besides those of one minimiser.
AT_ONCE = 1 << 20


def _minima(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have, size = g, 1
    while 2 * size <= width:
        have, size = np.minimum(have[: len(have) - size], have[size:]), 2 * size
    return np.minimum(have[: len(g) - width + 1], have[width - size :])


def super_kmers(w: W.Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, first window as a word of the text, windows, minimiser, fingerprint, places of the minimiser) of each."""
    n, mer = len(w.start), min(MER, window)
    empty = np.empty(0, np.int64)
    if n < window:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty
    h = w.hashes()
    g = W.rolling(h, mer)
    width = window - mer + 1
    least = _minima(g, width)
    counts = np.maximum(np.diff(w.first) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.repeat(w.first[:-1], counts) + _ranges(counts)
    least = least[place]
    new = np.ones(len(place), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(place)))
    pieces = -(-run // LONGEST)
    begin = np.repeat(begin, pieces) + LONGEST * _ranges(pieces)
    length = np.diff(np.append(begin, len(place)))
    at, key, text = place[begin], least[begin], text[begin]
    up, down = W.powers(0xA0761D6478BD642F | 1, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    print_ = W.mix((sums[at + length + window - 1] - sums[at]) * down[at] + length.astype(np.uint64))
    span = length + width - 1
    ends = np.cumsum(span)
    same = g[np.repeat(at - (ends - span), span) + np.arange(ends[-1] if len(ends) else 0)] == np.repeat(key, span)
    places = np.add.reduceat(same, ends - span) if len(ends) else empty
    return text, at - w.first[text], length, key, print_, places.astype(np.int64)


def _find_super_kmers(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for lo, _, data, offsets in W.chunks(batch.column(2)):
                text, at, length, key, print_, places = super_kmers(W.find(data, offsets), window)
                if len(text):
                    columns = [key.astype(np.int64), print_.astype(np.int64), k1[lo + text], k2[lo + text], (at << 9) | length, np.minimum(places, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "p", "k1", "k2", "at", "places"])

    return run


def _pack(window: int):
    """Packed strings of the wanted super-k-mers of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                words = plain.decompress(batch.column(0)[i].as_py()).split()
                want = batch.column(1)[i].values
                at = np.asarray(want.field("at"))
                strings = [b" ".join(words[a >> 9 : (a >> 9) + (a & 511) + window - 1]) for a in at.tolist()]
                yield pa.RecordBatch.from_arrays([want.field("h"), want.field("p"), want.field("n"), want.field("many"), pa.array(strings, pa.binary())], names=["h", "p", "n", "many", "words"])

    return run


def _repeated(strings: list[bytes], counts: list[int], bucket: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, which of its windows stand elsewhere in the strings of its bucket (or in a string that stands more than once)."""
    data = np.frombuffer(b" ".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    offsets = np.append(0, np.cumsum(sizes + 1))
    offsets[-1] -= 1
    w = W.find(data, offsets)
    h = w.hashes()
    n = np.diff(w.first) - window + 1
    of = np.repeat(np.arange(len(strings)), n)
    at = np.repeat(w.first[:-1], n) + _ranges(n)
    key = W.rolling(h, window)[at] ^ W.mix(bucket.astype(np.uint64))[of]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    for j in range(window):  # equal hashes: compare the words
        equal = h[a + j] == h[b + j]
        if not equal.all():
            keep = np.flatnonzero(same)
            same[keep[~equal]] = False
            a, b = a[equal], b[equal]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice |= np.array(counts)[of] > 1
    return np.split(twice, np.cumsum(n)[:-1])


def _runs(flags: np.ndarray) -> list[int]:
    """from, to, from, to, ... of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


def _count_in_buckets(window: int):
    """Over rows sorted by minimiser: sorts the windows of whole minimisers, about AT_ONCE words at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def counted(rows):
            flags = _repeated([r[3] for r in rows], [r[2] for r in rows], np.array([r[0] for r in rows]), window)
            found = [(r[0], r[1], _runs(f)) for r, f in zip(rows, flags, strict=True) if f.any()]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["h", "p", "runs"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > 8 * AT_ONCE and held[-1][0] != row[0]:
                    yield counted(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield counted(held)

    return run


def _cut_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, p, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split()
                many = len(words) - window + 1
                cut = [b" ".join(words[i : i + window]) for i in range(many)]
                yield pa.RecordBatch.from_arrays([pa.array([h] * many), pa.array([p] * many), pa.array([n] * many, pa.int64()), pa.array(range(many), pa.int32()), pa.array(cut, pa.binary())], names=["h", "p", "n", "i", "words"])

    return run


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])


def _remove(window: int, keep_text: bool, name: str):
    """The words of each text that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            made = [[], [], [], []]
            for z, a, b in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words = plain.decompress(z.as_py()).split()
                n = len(words)
                if a.is_valid and len(a.values):
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, np.asarray(a.values), 1)
                    np.add.at(change, np.asarray(b.values) + window - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                text = b" ".join(words)
                for column, value in zip(made, (n, n - len(words), hashlib.sha256(text).hexdigest(), text if keep_text else None), strict=True):
                    column.append(value)
            arrays = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.string()), pa.array(made[3], pa.binary()).cast(pa.string())]
            struct = pa.StructArray.from_arrays(arrays, names=["n_words", "n_removed", "kept_sha256", "kept_text"])
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], struct], names=[*batch.schema.names[3:], name])

    return run


def _compressed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with its text compressed in front, for the shuffle."""
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([pack.compress(t.as_buffer()) if t.is_valid else pack.compress(b"") for t in batch.column(0).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([z, *batch.columns[1:]], names=batch.schema.names)

    fields = {f.name: f for f in df.schema.fields}
    return df.select(text, *rest).mapInArrow(lean(run), T.StructType([T.StructField(text, T.BinaryType()), *[fields[c] for c in rest]]))


def find_repeats(keyed: DataFrame, window: int) -> DataFrame:
    """(k1, k2, a, b): runs a to b - 1 of repeated windows of the texts ``keyed`` (k1, k2, text), lists for each text."""
    found = keyed.select("k1", "k2", "text").mapInArrow(lean(_find_super_kmers(window)), "h long, p long, k1 long, k2 int, at long, places long")
    totals = found.groupBy("h").agg(F.count("*").alias("n"), F.sum("places").alias("m"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    shared = totals.where("m > 1").select("h", F.expr("n > 1 and lo = hi").alias("same"))
    hits = kept(found.join(shared, "h").select("h", "p", "k1", "k2", "at", "same"), "super-kmers")

    differ = hits.where("not same")
    strings = differ.groupBy("h", "p").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one"))
    many = strings.groupBy("h").agg(F.count("*").alias("strings")).where(F.col("strings") > MANY).select("h", F.lit(True).alias("many"))
    wanted = strings.join(many, "h", "left").select("h", "p", "n", F.coalesce("many", F.lit(False)).alias("many"), "one.*")
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "p", "n", "many", "at")).alias("want"))
    texts = _compressed(keyed.select("k1", "k2", "text"), "text")
    packed = wanted.join(texts, ["k1", "k2"]).select("text", "want").mapInArrow(lean(_pack(window)), "h long, p long, n long, many boolean, words binary")
    packed = kept(packed, "strings")
    few = packed.where("not many").select("h", "p", "n", "words").repartition("h").sortWithinPartitions("h", "p").mapInArrow(lean(_count_in_buckets(window)), "h long, p long, runs array<int>")
    cut = packed.where("many").select("h", "p", "n", "words").mapInArrow(lean(_cut_windows(window)), "h long, p long, n long, i int, words binary")
    twice = cut.groupBy("words").agg(F.sum("n").alias("m")).where("m > 1").select("words")
    lots = cut.join(twice, "words").groupBy("h", "p").agg(F.flatten(F.transform(F.collect_list("i"), lambda i: F.array(i, i + 1))).alias("runs"))
    runs = few.unionByName(lots)

    start = F.shiftright("at", 9).cast("int")
    whole = hits.where("same").select("k1", "k2", start.alias("a"), (start + F.col("at").bitwiseAND(511).cast("int")).alias("b"))
    part = differ.join(runs, ["h", "p"]).select("k1", "k2", start.alias("s"), "runs")
    part = part.select("k1", "k2", "s", F.inline(F.expr("transform(sequence(0, cast(size(runs) / 2 as int) - 1), i -> named_struct('a', runs[2 * i], 'b', runs[2 * i + 1]))"))).select("k1", "k2", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))
    return whole.unionByName(part).groupBy("k1", "k2").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, keep_text: bool = False, name: str = "repeats") -> tuple[DataFrame, str]:
    """``docs`` without their text column and with a struct column (its name is the second result).

    The struct has ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept
    words joined by one space) and, if ``keep_text``, ``kept_text``.
    """
    name, k1, k2 = fresh(docs, name), fresh(docs, "k1"), fresh(docs, "k2")
    keyed = docs.withColumns({k1: F.xxhash64(doc_id, text), k2: F.hash(text, doc_id)})
    repeats = find_repeats(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(text).alias("text")), window)
    a, b = fresh(docs, "a"), fresh(docs, "b")
    rest = [c for c in docs.columns if c != text]
    joined = _compressed(keyed, text).join(repeats.toDF(k1, k2, a, b), [k1, k2], "left").select(text, a, b, *rest)
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*[fields[c] for c in rest], T.StructField(name, RESULT)])
    return joined.mapInArrow(lean(_remove(window, keep_text, name)), schema), name


def report(docs: DataFrame, window: int = 35) -> DataFrame:
    found, name = remove_repeats(docs.select("doc_id", "text"), window=window)
    return found.select("doc_id", *[F.col(f"{name}.{c}").alias(c) for c in ("n_words", "n_removed", "kept_sha256")])


def brute_force(docs: list[tuple[int, str | None]], window: int = 35) -> list[tuple]:
    """What :func:`report` gives, by counting all windows in one place; for tests."""
    import re
    from collections import Counter

    cut = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    count = Counter(tuple(w[i : i + window]) for _, w in cut for i in range(len(w) - window + 1))
    out = []
    for d, w in cut:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out
