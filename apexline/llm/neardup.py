"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of five words.  Two documents are
linked if their sets have a Jaccard similarity of at least ``percent`` / 100;
components of links are classes, named by their smallest ``doc_id``.

1.  Texts with equal words (128 bits of their digest) are one node, so copies
    cost a grouping only.
2.  Each node gets a SetSketch: for each register the least of the
    exponential values that the set's elements draw for it, stored on an
    exponential scale and truncated.  Registers of equal sets are equal,
    and a register of two sets agrees with about the probability of their
    similarity.  ``BANDS`` bands of ``ROWS`` registers give the buckets: at a
    similarity of 0.85 a pair shares no bucket with a probability of 4e-7.
3.  Pairs of a bucket are tested in rounds.  First each member with one that a
    hash picks, another in each bucket.  Then whoever isn't yet in the component
    of most of the bucket meets the members of its own cell (about ``CELL`` of
    them, by hash), then those of the cells 1-7, 8-63, ... away, until all is
    one component or every pair of different components has met.  So no pair
    that could join two components is left out, pairs of one component are
    not compared, and no task gathers a bucket: cells meet as blocks.
4.  A pair is first judged by its sizes (exact), then by parity bits of the
    sets, whose difference can't be larger than that of the sets (exact), then by
    the likelihood of the similarity given its registers and sizes (pruned if
    0.85 is e**14 times less likely than the best), then by its full sets (exact).

Defined results: a null, empty or wordless text has no set, is linked with
nothing and kept; a text with fewer words than a shingle is one shingle;
repeated rows share a component; ids are integers; a class of rows without a ``doc_id`` has no
name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import relabel
from .decontaminate import _ranges
from .shared import fresh, kept, lean

SHINGLE = 5
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Base and rate of SetSketch; registers are 16 bits wide.
BASE, RATE = 1.001, 20.0
CELL = 128
#: Points that are drawn at once.
DRAWN = 1 << 18
#: Bins of the parity bits of a set.
BINS = 2048
MARGIN = 14.0


def shingle_sets(w: W.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted by text; and where each text's begin."""
    h = w.hashes()
    n = np.diff(w.first)
    long_ = n >= size
    counts = np.where(long_, n - size + 1, 0)
    at = np.repeat(w.first[:-1], counts) + _ranges(counts)
    text = np.repeat(np.arange(len(n)), counts)
    values = W.rolling(h, size)[at] if len(at) else np.empty(0, np.uint64)
    few = np.flatnonzero(~long_ & (n > 0))
    short = np.array([W.rolling(h[w.first[d] : w.first[d + 1]], int(n[d]))[0] ^ W.mix(n[d : d + 1].astype(np.uint64))[0] for d in few], np.uint64)
    text, values = np.concatenate([text, few]), np.concatenate([values, short])
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    text, values = text[new], values[new]
    return values, np.searchsorted(text, np.arange(len(n) + 1))


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of registers for each set ``values[first[d]:first[d + 1]]``.

    Each element runs a Poisson process of points with uniform registers, which
    is an independent exponential value for every register; points past the
    largest of a set's minima can't change it, so an element ends there.
    """
    n = len(first) - 1
    least = np.full(n * REGISTERS, np.inf)
    text = np.repeat(np.arange(n), np.diff(first))
    active = np.arange(len(values))
    x = np.zeros(len(values))
    step, many = 0, 1
    while len(active):
        t = np.arange(step + 1, step + many + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rows = max(1, DRAWN // many)
        for lo in range(0, len(active), rows):  # so many points at once, however many elements there are
            some = active[lo : lo + rows]
            r = W.mix(values[some][:, None] + t)
            points = -np.log(((r >> np.uint64(24)) + np.uint64(1)) * 2.0**-40) / REGISTERS
            points = np.cumsum(points, axis=1) + x[some][:, None]
            place = text[some][:, None] * REGISTERS + ((r & np.uint64(0xFFFFFF)) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(least, place.ravel(), points.ravel())
            x[some] = points[:, -1]
        sets = np.unique(text[active])
        bound = np.zeros(n)
        bound[sets] = least.reshape(n, REGISTERS)[sets].max(axis=1)
        active = active[x[active] < bound[text[active]]]
        step, many = step + many, min(256, many * 2 if step else 1)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(k, 0, 65535).astype("<u2").reshape(n, REGISTERS)


def parities(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of BINS bits for each set: whether an odd number of its elements fall in a bin."""
    n, parts = len(first) - 1, [np.empty((0, BINS // 8), np.uint8)]
    for lo in range(0, n, 256):  # few sets at a time, since their bins are counted in 64 bits
        own = first[lo : lo + 257]
        at = np.repeat(np.arange(len(own) - 1), np.diff(own)) * BINS + (W.mix(values[own[0] : own[-1]]) % np.uint64(BINS)).astype(np.int64)
        odd = (np.bincount(at, minlength=(len(own) - 1) * BINS) & 1).astype(np.uint8)
        parts.append(np.packbits(odd.reshape(-1, BINS), axis=1))
    return np.concatenate(parts)


def _split(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Registers, and parity bits as 64-bit words."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return np.ascontiguousarray(rows[:, : 2 * REGISTERS]).view("<u2"), np.ascontiguousarray(rows[:, 2 * REGISTERS :]).view(np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, to, data, offsets in W.chunks(batch.column(1), lower=True):
            w = W.find(data, offsets)
            values, first = shingle_sets(w)
            rows = registers(values, first)
            digests = np.frombuffer(b"".join([hashlib.blake2b(w.text(a, b), digest_size=16).digest() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]), "<i8").reshape(-1, 2)
            # One value holds the registers and, after them, the parity bits.
            sketches = [a.tobytes() + b.tobytes() for a, b in zip(rows, parities(values, first), strict=True)]
            columns = [batch.column(i).slice(lo, to - lo) for i in (0, 2, 3)] + [pa.array(digests[:, i].copy()) for i in (0, 1)] + [pa.array(np.diff(first), pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "h1", "h2", "n", "sketch"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _split(batch.column(1).to_pylist())[0].reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
        for j in range(ROWS):
            key = W.mix(key * np.uint64(65537) + rows[:, :, j] + np.uint64(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), BANDS)), pa.array(key.ravel().astype(np.int64))], names=["node", "bucket"])


def similar(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of sketches don't rule out a similarity of ``least``, by the joint likelihood of SetSketch."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-9))

    best = np.max([likelihood(np.minimum(j, top)) for j in np.linspace(0, 1, 41)], axis=0)
    near = np.max([likelihood(np.minimum(j, top)) for j in np.linspace(least, 1, 16)], axis=0)
    return (top >= least - 1e-9) & (near >= best - MARGIN)


def likely(n_a, n_b, a, b, percent: int) -> np.ndarray:
    """Which pairs may be links, by sizes, parities and registers; a and b are what :func:`_split` gives."""
    keep = np.flatnonzero(100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
    out = np.zeros(len(n_a), bool)
    differ = np.bitwise_count(a[1][keep] ^ b[1][keep]).sum(axis=1, dtype=np.int64)
    # 100 * both >= percent * union leaves this much for the difference of the sets.
    keep = keep[(100 + percent) * differ <= (100 - percent) * (n_a[keep] + n_b[keep])]
    out[keep] = similar(n_a[keep], n_b[keep], a[0][keep], b[0][keep], percent / 100)
    return out


def _likely(percent: int):
    """Over rows (a, b, na, nb, sa, sb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            a, b = (_split(batch.column(i).to_pylist()) for i in (4, 5))
            yield batch.select([0, 1]).filter(pa.array(likely(n_a, n_b, a, b, percent)))

    return run


def _meet(percent: int):
    """Over pairs of cells (same, main, left, right): pairs of nodes of different components that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                main, left, right = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].values
                (u, lu, nu), (v, lv, nv) = ([np.asarray(side.field(c)) for c in ("node", "label", "n")] for side in (left, right))
                x, y = np.nonzero((lu[:, None] != lv[None, :]) & (lu != main)[:, None])
                if not len(x):
                    continue
                a, b = _split(left.field("sketch").to_pylist()), _split(right.field("sketch").to_pylist())
                for at in range(0, len(x), 1 << 15):
                    p, q = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
                    # Parities first: they are cheap, and leave few.
                    keep = 100 * np.minimum(nu[p], nv[q]) >= percent * np.maximum(nu[p], nv[q])
                    p, q = p[keep], q[keep]
                    ok = likely(nu[p], nv[q], (a[0][p], a[1][p]), (b[0][q], b[1][q]), percent)
                    found.append((np.minimum(u[p[ok]], v[q[ok]]), np.maximum(u[p[ok]], v[q[ok]])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

    return run


def _verify(percent: int):
    """Pairs whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        seen: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(node, z):
            got = seen.get(node)
            if got is None:
                data = W.LOWER[np.frombuffer(plain.decompress(z.as_py()), np.uint8)]
                got = seen[node] = shingle_sets(W.find(data, np.array([0, len(data)])))[0]
                if len(seen) > 64:
                    seen.popitem(last=False)
            else:
                seen.move_to_end(node)
            return got

        for batch in batches:
            keep = []
            for a, b, za, zb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = shingles(a, za), shingles(b, zb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = pa.array([pack.compress(t.as_buffer()) for t in batch.column(2).cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], names=["k1", "k2", "z"])


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, k1, k2): the keys tell rows apart that differ in either."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("k1"), F.hash(text, doc_id).alias("k2"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, k1, k2, n, label, component) for each row of ``docs``; label tells classes apart."""
    rows = _keys(docs, doc_id, text)
    sketches = kept(rows.mapInArrow(lean(_sketch), "doc_id long, k1 long, k2 int, h1 long, h2 long, n long, sketch binary"), "sketches")
    nodes = sketches.where("n > 0").groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("k1", "k2")).alias("k"), F.min("doc_id").alias("least"))
    # Numbered once, in a table.
    nodes = kept(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("node", "sketch").mapInArrow(lean(_bands), "node long, bucket long")
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min_by("node", F.xxhash64("node", "bucket")).alias("centre")).where("size > 1")
    members = kept(bands.join(buckets, "bucket").select("bucket", "node", "size", "centre"), "members")
    # The texts of the nodes that share a bucket: of equal texts the first row's.
    wanted = members.select("node").distinct().join(nodes.select("node", "k"), "node").select("node", "k.*")
    texts = rows.where("text is not null").select("k1", "k2", "text").mapInArrow(lean(_compress), "k1 long, k2 int, z binary")
    texts = kept(texts.join(wanted, ["k1", "k2"]).dropDuplicates(["node"]).select("node", "z"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(texts.toDF("a", "za"), "a").join(texts.toDF("b", "zb"), "b").select("a", "b", "za", "zb")
        return kept(pairs.mapInArrow(lean(_verify(percent)), "a long, b long"), "links")

    stars = members.where("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    slim = nodes.select("node", "n", "sketch")
    stars = stars.join(slim.toDF("a", "na", "sa"), "a").join(slim.toDF("b", "nb", "sb"), "b")
    stars = stars.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb")
    labels = docs.sparkSession.createDataFrame([], "node long, label long")
    labels = relabel(labels, verified(stars.mapInArrow(lean(_likely(percent)), "a long, b long")))
    cells = F.ceil(F.col("size") / CELL).cast("int")
    crowd = members.where("size > 2").select("bucket", "node", cells.alias("cells"), F.pmod(F.xxhash64("node"), cells).cast("int").alias("cell"))
    lo, hi = 0, 0  # cells at these distances meet
    while True:
        now = crowd.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        main = now.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"))
        now = kept(now.join(main.where("labels > 1").select("bucket", "main"), "bucket"), "crowd")
        widest = now.agg(F.max("cells")).first()[0]
        if widest is None or lo > widest // 2:
            break
        one = now.where(f"cells >= {2 * lo}").join(slim, "node").groupBy("bucket", "cell").agg(F.first("cells").alias("cells"), F.first("main").alias("main"), F.bool_or(F.col("label") != F.col("main")).alias("open"), F.collect_list(F.struct("node", "label", "n", "sketch")).alias("cell_nodes"))
        steps = F.flatten(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda d: F.array(F.col("cell") + d, F.col("cell") - d)))
        left = one.where("open").select("bucket", "main", F.col("cell_nodes").alias("left"), F.explode(F.array_distinct(F.transform(steps, lambda c: F.pmod(c, F.col("cells"))))).alias("cell"))
        met = left.join(one.select("bucket", "cell", F.col("cell_nodes").alias("right")), ["bucket", "cell"]).select("main", "left", "right")
        labels = relabel(labels, verified(met.mapInArrow(lean(_meet(percent)), "a long, b long").distinct()))
        crowd = now.select("bucket", "node", "cells", "cell")
        lo, hi = hi + 1, 8 * hi + 7
    # Names are found and met by different texts; copies only meet their text.
    labelled = nodes.select("h1", "h2", "node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).drop("node")
    names = labelled.groupBy("label").agg(F.min("least").alias("component"))
    named = kept(labelled.join(names, "label").select("h1", "h2", "label", "component"), "named")
    found = sketches.select("doc_id", "k1", "k2", "h1", "h2", "n").join(named, ["h1", "h2"], "left")
    return found.select("doc_id", "k1", "k2", "n", "label", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component"))


def report(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: size of its set, name of its class, and whether it is the one that stays."""
    found = classes(docs, percent=percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one row for each class, one with the smallest ``doc_id``; repeated rows become one."""
    found = classes(docs, percent=percent)
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("one")).select("one.k1", "one.k2")
    stay = first.union(found.where("label is null").select("k1", "k2"))
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    keyed = docs.withColumns({k1: F.xxhash64("doc_id", "text"), k2: F.hash("text", "doc_id")})
    return keyed.join(stay.toDF(k1, k2), [k1, k2], "left_semi").dropDuplicates([k1, k2]).drop(k1, k2)


def brute_force(docs: list[tuple[int, str | None]], percent: int = 85) -> list[tuple]:
    """What :func:`report` gives, from all pairs; for tests."""
    import re

    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    label[q] = p
    return [(d, len(sets[d]), find(d), find(d) == d) for d in ids]
