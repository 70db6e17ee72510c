"""Periodic runs of words, found with the suffix tree of Stoye and Gusfield.

A run is a stretch of consecutive words of one text with smallest period q and a
length of at least ``max(least, times * q)``, which neither neighbour extends.

A task builds the suffix trees of the texts that it holds, as suffix arrays with
common prefix lengths (all texts of about a megabyte at once; suffixes of two
texts share nothing).  An inner node of depth D is left where two suffixes part
after D words.  A branching tandem repeat of period D that starts at word i has
the suffixes i and i + D below one node of depth D, on two sides.  So each node's
smaller side is traversed, and i + D and i - D are looked up on the other side;
a text of n words has at most n log2 n of these lookups.  A run holds exactly one
branching repeat of its period, at its end: repeats are rotated to the left, as
long as the period holds, and repeats of a run's own period taken several times
are merged into it.

A run of the asked length repeats at least ``least * (times - 1) / times`` words
one period later, so trees are built only for texts in which so many consecutive
words stand twice.  Words are compared by 64-bit hashes at first; the words of
the runs found are then compared themselves, and a text that fails has its trees
built from its distinct words, so the result is exact.

Nothing is shuffled: a text is worked on where it is read.  A task holds the texts
of about a megabyte, or one longer text with 4 bytes a word for each doubling of
its longest repeat.

Defined results: a null or empty text, or one without words, has no runs and
collapses to the empty string; repeated rows are told apart by nothing and have
equal results; an empty table gives an empty result; columns of the documents are
kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import fresh, lean

#: Lookups that are made at once.
AT_ONCE = 1 << 20
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("top", RUN), T.StructField("collapsed", T.StringType())])


class Tree:
    """The suffix tree of some texts; ``first[d]:first[d + 1]`` are the words of text d in ``ids``.

    Each text ends in a symbol of its own.  ``ranks[l]`` orders the suffixes by
    their first ``2 ** l`` symbols; those that agree in these have the same rank.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        texts, n = len(first) - 1, len(ids)
        text = np.repeat(np.arange(texts), np.diff(first))
        place = np.arange(n) + text
        order = np.lexsort((ids, text))
        new = np.ones(n, bool)
        new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, n))
        rank = np.empty(n + texts, np.int32)
        rank[place[order]] = np.repeat(begin, sizes)
        self.begin = first[:-1] + np.arange(texts)
        self.end = first[1:] + np.arange(texts)
        rank[self.end] = n + np.arange(texts)
        self.text = np.insert(text, first[1:], np.arange(texts))
        self.ranks = [rank]
        open_, step = place[order[np.repeat(sizes > 1, sizes)]], 1
        while len(open_):  # suffixes that some other still agrees with have no end among their first symbols
            rank = rank.copy()
            key = rank[open_].astype(np.int64) << 32 | rank[open_ + step]
            order = np.argsort(key)
            open_, key = open_[order], key[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(begin, len(key)))
            group = key[begin] >> 32
            leader = np.append(True, group[1:] != group[:-1])
            rank[open_] = np.repeat(group + begin - np.repeat(begin[leader], np.diff(np.append(np.flatnonzero(leader), len(begin)))), sizes)
            self.ranks.append(rank)
            open_, step = open_[np.repeat(sizes > 1, sizes)], 2 * step
        self.suffixes = np.empty(len(rank), np.int64)
        self.suffixes[rank] = np.arange(len(rank))
        self.depth = self._common()

    def _common(self) -> np.ndarray:
        """Symbols that each suffix shares with the next in order."""
        a, b = self.suffixes[:-1].copy(), self.suffixes[1:].copy()
        for level in range(len(self.ranks) - 1, -1, -1):
            same = (self.ranks[level][a] == self.ranks[level][b]).astype(np.int64) << level
            a += same
            b += same
        return a - self.suffixes[:-1]

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` symbols from a on are those from b on."""
        out = length == 0
        level = np.frexp(np.maximum(length, 1))[1] - 1
        for at in np.unique(level[~out]).tolist():
            if at < len(self.ranks):
                which = np.flatnonzero((level == at) & ~out)
                x, y, far, rank = a[which], b[which], length[which] - (1 << at), self.ranks[at]
                out[which] = (rank[x] == rank[y]) & (rank[x + far] == rank[y + far])
        return out

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each place between two suffixes in order, the last such place before with less in common and the first after with no more."""
        before, after, open_ = [], [len(self.depth)] * len(self.depth), []
        depth = self.depth.tolist()
        for k, d in enumerate(depth):
            while open_ and depth[open_[-1]] >= d:
                after[open_.pop()] = k
            before.append(open_[-1] if open_ else -1)
            open_.append(k)
        return np.array(before, np.int64), np.array(after, np.int64)

    def branching_repeats(self, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
        """(end, period) of the branching tandem repeats that may end a long enough run."""
        size = (self.end - self.begin)[self.text[self.suffixes[:-1]]]
        before, after = self.parts()
        node = np.flatnonzero((self.depth > 0) & (np.maximum(least, times * self.depth) <= size))
        left, right = (before[node] + 1, node + 1), (node + 1, after[node] + 1)
        smaller = right[1] - right[0] < left[1] - left[0]
        own = [np.where(smaller, r, l) for l, r in zip(left, right, strict=True)]
        other = [np.where(smaller, l, r) for l, r in zip(left, right, strict=True)]
        count, rank = own[1] - own[0], self.ranks[-1]
        ends, periods, at = [], [], 0
        total = np.cumsum(count)
        while at < len(node):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
            part = np.arange(at, to)
            each = np.repeat(part, count[at:to])
            leaf = np.arange(len(each)) - np.repeat(total[at:to] - count[at:to] - (total[at - 1] if at else 0), count[at:to]) + own[0][each]
            suffix, period = self.suffixes[leaf], self.depth[node][each]
            for begin, partner in ((suffix, suffix + period), (suffix - period, suffix - period)):
                fine = np.flatnonzero((partner >= 0) & (partner < len(rank)))
                found = rank[partner[fine]]
                fine = fine[(found >= other[0][each[fine]]) & (found < other[1][each[fine]])]
                ends.append(begin[fine] + 2 * period[fine])
                periods.append(period[fine])
            at = to
        return (np.concatenate(ends), np.concatenate(periods)) if ends else (np.empty(0, np.int64), np.empty(0, np.int64))

    def runs(self, least: int, times: int) -> list[list[tuple[int, int, int]]]:
        """(start, length, period) of the runs of each text, by start and period."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.begin]
        end, period = self.branching_repeats(least, times)
        length = np.maximum(least, times * period)
        fine = np.flatnonzero(end - length >= self.begin[self.text[end - 1]]) if len(end) else np.empty(0, np.int64)
        end, period, length = end[fine], period[fine], length[fine]
        fine = self.same(end - length, end - length + period, length - period)
        end, period = end[fine], period[fine]
        order = np.lexsort((period, end))
        end, period = end[order], period[order]
        words = self.ranks[0]
        while len(end):
            first = np.append(True, end[1:] != end[:-1])
            for e, q in zip(end[first].tolist(), period[first].tolist(), strict=True):
                text = int(self.text[e - 1])
                begin = int(self.begin[text])
                a = self._rotated(words, begin, e - max(least, times * q), q)
                out[text].append((a - begin, e - a, q))
            q = np.repeat(period[first], np.diff(np.append(np.flatnonzero(first), len(end))))
            # A repeat whose word sequence is a power of the run's is the run again.
            left = np.flatnonzero(~first & ~((period % q == 0) & self.same(end - period, end - period + q, np.maximum(period - q, 0))))
            end, period = end[left], period[left]
        return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]

    @staticmethod
    def _rotated(words: np.ndarray, begin: int, a: int, q: int) -> int:
        """The first word of the stretch with period ``q`` that holds word ``a``."""
        step = 64
        while a > begin:
            step = min(step, a - begin)
            differ = np.flatnonzero(words[a - step : a] != words[a - step + q : a + q])
            if len(differ):
                return a - step + int(differ[-1]) + 1
            a, step = a - step, 4 * step
        return a


def _suspects(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Texts in which ``width`` consecutive words stand twice."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = W.rolling(hashes, width)
    inside = np.flatnonzero(text[: len(key)] == text[width - 1 :]) if len(key) else np.empty(0, np.int64)
    key = key[inside] ^ W.mix(text[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    twice = key[order[1:]] == key[order[:-1]]
    return np.unique(text[inside[order[1:][twice]]])


def runs_of(w: W.Words, least: int, times: int) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of those texts of a chunk that have some."""
    hashes = w.hashes()
    some = _suspects(hashes, w.first, max(1, -(-least * (times - 1) // times)))
    if not len(some):
        return {}
    sizes = np.diff(w.first)[some]
    first = np.append(0, np.cumsum(sizes))
    places = np.repeat(w.first[some] - first[:-1], sizes) + np.arange(first[-1])
    out = {}
    for text, found in zip(some.tolist(), Tree(hashes[places], first).runs(least, times), strict=True):
        if found:
            begin = int(w.first[text])
            same = all(w.text(begin + s, begin + s + n - q) == w.text(begin + s + q, begin + s + n) for s, n, q in found)
            found = found if same else exact_runs(w.text(begin, int(w.first[text + 1])).split(b" "), least, times)
        if found:
            out[text] = found
    return out


def exact_runs(words: list, least: int, times: int) -> list[tuple[int, int, int]]:
    """The runs of one text, from its distinct words."""
    number: dict = {}
    ids = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    return Tree(ids, np.array([0, len(ids)])).runs(least, times)[0]


def _collapse(least: int, times: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, to, data, offsets in W.chunks(batch.column(0)):
                w = W.find(data, offsets)
                found = runs_of(w, least, times)
                texts, raw, at = [], data.tobytes(), offsets.tolist()
                for i in range(to - lo):
                    words = raw[at[i] : at[i + 1]].split()
                    if i in found:
                        change = np.zeros(len(words) + 1, np.int64)
                        for s, n, q in found[i]:
                            change[s + q] += 1
                            change[s + n] -= 1
                        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                    texts.append(b" ".join(words))
                del raw
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(i, ())] for i in range(to - lo)]
                top = [max(r, key=lambda x: (Fraction(x["length"], x["period"]), -x["start"], -x["period"])) if r else None for r in runs]
                kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
                arrays = [pa.array(np.diff(w.first), pa.int64()), pa.array(runs, pa.list_(kind)), pa.array(top, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                struct = pa.StructArray.from_arrays(arrays, names=RESULT.names)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, to - lo) for c in batch.columns[1:]], struct], names=[*batch.schema.names[1:], name])

    return run


def collapse_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3, name: str = "runs") -> tuple[DataFrame, str]:
    """``docs`` without their text column and with a struct column (its name is the second result).

    The struct has ``n_words``, ``runs`` (start, length, period; by start and
    period), ``top`` (the run with the greatest length to period, then the
    smallest start and period) and ``collapsed``, the text's words joined by one
    space, without those that any run has after its first period.
    """
    if least < 1 or times < 2:
        raise ValueError("a run has a word at least, and its period twice")
    name = fresh(docs, name)
    rest = [c for c in docs.columns if c != text]
    fields = {f.name: f for f in docs.schema.fields}
    return docs.select(text, *rest).mapInArrow(lean(_collapse(least, times, name)), T.StructType([*[fields[c] for c in rest], T.StructField(name, RESULT)])), name


def looped(doc_id: Column, text: Column) -> Column:
    """The text that the contract asks about: one text in ten goes on in circles from some word on.

    With h the crc32 of the id, g = h / 10 and n words, word i >= a of a text
    with h % 10 = 0 is word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def turned(x: Column) -> Column:
        n, a = F.size(x["w"]), x["a"]
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x["w"], F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    # Names for steps of the work, by arrays of one element: nothing is done twice.
    with_a = F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), lambda w: F.struct(w.alias("w"), (g % F.size(w)).cast("int").alias("a")))
    return F.when((h % 10 == 0) & text.isNotNull(), F.coalesce(F.get(F.transform(with_a, turned), 0), F.lit(""))).otherwise(text)


def report(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """The contract's digests of :func:`collapse_runs` over the looped texts."""
    found, name = collapse_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")), least=least, times=times)
    runs, top = F.col(f"{name}.runs"), F.col(f"{name}.top")
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), *[top[c].alias(c) for c in RUN.names], F.call_function("div", 1000 * top["length"], top["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col(f"{name}.collapsed"), 256).alias("collapsed_sha256"),
    )


def brute_force(docs: list[tuple[int, str | None]], least: int = 24, times: int = 3) -> list[tuple]:
    """What :func:`report` gives, by trying every period at every word; for tests."""
    import re
    import zlib

    out = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = []
        for q in range(1, n // times + 1):
            i = 0
            while i + q < n:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                length = j + q - i
                if j > i and length >= max(least, times * q) and not any(all(w[k] == w[k + x] for k in range(i, i + length - x)) for x in range(1, q)):
                    runs.append((i, length, q))
                i = max(j, i + 1)
        runs.sort(key=lambda r: (r[0], r[2]))
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        milli = 1000 * top[1] // top[2] if runs else None
        out.append((d, len(runs), *top, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out
