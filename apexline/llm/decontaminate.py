"""Benchmark decontamination by a prefix-filtered set join.

Every window of ``window`` consecutive words of a benchmark item (an item with
fewer words is one window) is looked for in every document.  A window is taken
as the set of its shingles of up to three words, ordered by how rare they are
in the documents.  At full containment the necessary prefix of that order is
one shingle, so a document meets a window only at occurrences of the window's
rarest shingle.  Each such meeting gives the only place where the window can
stand; it is cut off by position (it must begin inside the text) and length
(it must end inside it), and then the words are compared.

The benchmark is held in memory in groups of items of at most ``group_bytes``
of text, so what is broadcast is bounded whatever its size.  With one group
the documents aren't shuffled at all; with more, each group makes one pass over
the documents and only the rows of hit documents are grouped.

Defined results: a null or empty text has no words and no hits; null, empty and
wordless items have no windows; an item without an id is named None; equal items or repeated windows count once for
each item_id; repeated documents give equal rows; an empty benchmark hits
nothing.  Columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import fresh, lean, with_struct

SHINGLE = 3
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


@dataclass
class Windows:
    """Distinct windows of a group of items, and the shingles that lead to them."""

    texts: list[bytes]
    items: list[list[str]]
    length: np.ndarray
    words: np.ndarray  # a row of word hashes for each window
    shingles: dict[int, np.ndarray]  # by shingle length: sorted distinct hashes of all shingles of its windows
    anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None = None

    @classmethod
    def of(cls, rows: list, window: int) -> Windows:
        found: dict[bytes, set[str]] = {}
        hashes: dict[bytes, np.ndarray] = {}
        for item_id, text in rows:
            data = W.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            w = W.find(data, np.array([0, len(data)]), W.NOT_ALNUM)
            n, h = len(w.start), w.hashes()
            for i in range(max(1, n - window + 1) if n else 0):
                key = w.text(i, min(n, i + window))
                found.setdefault(key, set()).add(str(item_id))
                hashes[key] = h[i : i + window]
        texts = sorted(found)
        length = np.array([len(hashes[t]) for t in texts], np.int64)
        table = np.zeros((len(texts), window), np.uint64)
        for i, t in enumerate(texts):
            table[i, : length[i]] = hashes[t]
        parts: dict[int, list[np.ndarray]] = {}
        for i in range(len(texts)):
            s = min(SHINGLE, int(length[i]))
            parts.setdefault(s, []).append(W.rolling(table[i, : length[i]], s))
        return cls(texts, [sorted(found[t]) for t in texts], length, table, {s: np.unique(np.concatenate(p)) for s, p in parts.items()})

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle, by ``counts`` of ``shingles``; the first of equals."""
        chosen: dict[int, list[tuple[int, int, int]]] = {}
        for i in range(len(self.texts)):
            s = min(SHINGLE, int(self.length[i]))
            own = W.rolling(self.words[i, : self.length[i]], s)
            at = int(np.argmin(counts[s][np.searchsorted(self.shingles[s], own)]))
            chosen.setdefault(s, []).append((int(own[at]), at, i))
        self.anchors = {}
        for s, rows in chosen.items():
            rows.sort()
            key = np.array([r[0] for r in rows], np.uint64)
            distinct, first = np.unique(key, return_index=True)
            self.anchors[s] = (distinct, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


class _Lookup:
    """Where the values of an array stand in a sorted one; most of those that don't are told by a bit table."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys, self.mask = keys, np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(keys & self.mask).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``values`` and in ``keys`` of what both have."""
        at = np.flatnonzero(self.table[(values & self.mask).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        same = self.keys[k] == values[at]
        return at[same], k[same]


def _inside(w: W.Words, s: int, at: np.ndarray) -> np.ndarray:
    """Which of the shingles of s words at these words lie in one text."""
    return at + s <= w.first[np.searchsorted(w.first, at, "right")]


def _shingle_counts(docs: DataFrame, text: str, windows: Windows) -> dict[int, np.ndarray]:
    """How often each shingle of the windows stands in all the documents."""
    sizes = sorted(windows.shingles)
    shared = docs.sparkSession.sparkContext.broadcast(windows.shingles)

    def run(batches):
        totals = None
        for batch in batches:
            if totals is None:
                lookups = {s: _Lookup(k) for s, k in shared.value.items()}
                totals = {s: np.zeros(len(k), np.int64) for s, k in shared.value.items()}
            for _, _, data, offsets in W.chunks(batch.column(0), lower=True):
                w = W.find(data, offsets, W.NOT_ALNUM)
                h = w.hashes()
                for s in sizes:
                    at, k = lookups[s].find(W.rolling(h, s))
                    totals[s] += np.bincount(k[_inside(w, s, at)], minlength=len(totals[s]))
        for s in sizes if totals is not None else []:
            k = np.flatnonzero(totals[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), s), pa.int32()), pa.array(k, pa.int32()), pa.array(totals[s][k])], names=["s", "k", "n"])

    counted = docs.select(text).mapInArrow(lean(run), "s int, k int, n long").groupBy("s", "k").agg(F.sum("n").alias("n"))
    counts = {s: np.zeros(len(k), np.int64) for s, k in windows.shingles.items()}
    for s, k, n in counted.collect():  # as many rows at most as the group of items has shingles
        counts[s][k] = n
    return counts


def _matcher(shared, text_at: int):
    def task():
        windows: Windows = shared.value
        lookups = {s: _Lookup(a[0]) for s, a in windows.anchors.items()}

        def match(batch: pa.RecordBatch) -> dict:
            n_words, hits, items = [], [], []
            for lo, to, data, offsets in W.chunks(batch.column(text_at), lower=True):
                w = W.find(data, offsets, W.NOT_ALNUM)
                h = w.hashes()
                starts, which = [], []
                for s, (_, first, shift, window) in windows.anchors.items():
                    at, k = lookups[s].find(W.rolling(h, s))
                    ok = _inside(w, s, at)
                    at, k = at[ok], k[ok]
                    many = first[k + 1] - first[k]
                    row = np.repeat(first[k], many) + _ranges(many)
                    starts.append(np.repeat(at, many) - shift[row])
                    which.append(window[row])
                start = np.concatenate([*starts, np.empty(0, np.int64)]).astype(np.int64)
                window = np.concatenate([*which, np.empty(0, np.int64)]).astype(np.int64)
                anchor_doc = np.searchsorted(w.first, np.maximum(start, 0), "right") - 1
                ok = (start >= 0) & (start + windows.length[window] <= w.first[np.minimum(anchor_doc + 1, len(w.first) - 1)])
                start, window = start[ok], window[ok]
                for j in range(windows.words.shape[1]):
                    longer = windows.length[window] > j
                    same = ~longer
                    same[longer] = h[start[longer] + j] == windows.words[window[longer], j]
                    start, window = start[same], window[same]
                same = [w.text(i, i + int(windows.length[k])) == windows.texts[k] for i, k in zip(start.tolist(), window.tolist(), strict=True)]
                start, window = start[np.array(same, bool)], window[np.array(same, bool)]
                doc = np.searchsorted(w.first, start, "right") - 1
                by = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[by], np.arange(to - lo + 1))
                n_words += np.diff(w.first).tolist()
                for d in range(to - lo):
                    mine = by[cut[d] : cut[d + 1]]
                    if len(mine):
                        covered = np.repeat(start[mine], windows.length[window[mine]]) + _ranges(windows.length[window[mine]])
                        hits.append((np.unique(covered) - w.first[d]).tolist())
                        items.append(sorted({i for k in set(window[mine].tolist()) for i in windows.items[k]}))
                    else:
                        hits.append([])
                        items.append([])
            return {"n_words": n_words, "hits": hits, "items": items}

        return match

    return task


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, name: str = "found", group_bytes: int = 4 << 20) -> tuple[DataFrame, str]:
    """``docs`` and a struct column (its name is the second result): ``n_words``, ``hits`` (positions of hit words), ``items``."""
    name = fresh(docs, name)
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null and t != ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    groups = max(1, -(-size // group_bytes))
    made = []
    for g in range(groups):
        own = items.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == g) if groups > 1 else items
        windows = Windows.of(own.collect(), window)  # about group_bytes of text
        windows.order(_shingle_counts(docs, text, windows) if windows.texts else {})
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        made.append(with_struct(docs, name, RESULT, _matcher(shared, docs.columns.index(text))))
    if groups == 1:
        return made[0], name
    k1, k2, hits, ids = (fresh(docs, c) for c in ("k1", "k2", "hits", "ids"))
    # Maps have no hash of their own.
    hashed = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields]
    key = {k1: F.xxhash64(*hashed), k2: F.sha2(F.coalesce(text, F.lit("")), 256)}
    hit = None
    for df in made:
        own = df.where(F.size(f"{name}.hits") > 0).withColumns(key).select(k1, k2, F.col(f"{name}.hits").alias(hits), F.col(f"{name}.items").alias(ids))
        hit = own if hit is None else hit.unionByName(own)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    hit = hit.groupBy(k1, k2).agg(merged(hits), merged(ids))
    all_ = made[0].withColumns(key).join(hit, [k1, k2], "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    both = F.struct(F.col(f"{name}.n_words").alias("n_words"), none(hits, "array<bigint>").alias("hits"), none(ids, "array<string>").alias("items"))
    return all_.select(*docs.columns, both.alias(name)), name


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts of words, hit words and items, and a digest of the items."""
    found, name = decontaminate(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", F.col(f"{name}.n_words").alias("n_words"), F.size(f"{name}.hits").cast("long").alias("n_hit"), F.size(f"{name}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{name}.items", ","), 256).alias("items_sha256"), (F.size(f"{name}.hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark stands."""
    found, name = decontaminate(docs, benchmark)
    return found.where(F.size(f"{name}.hits") == 0).drop(name)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> list[tuple]:
    """What :func:`report` gives, by plain loops; for tests."""
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc_id, text in docs:
        own, hit, found = cut(text), set(), set()
        for item, t in items:
            w = cut(t)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                part = w[i : i + window]
                for j in range(len(own) - len(part) + 1):
                    if own[j : j + len(part)] == part:
                        hit |= set(range(j, j + len(part)))
                        found.add(str(item))
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
