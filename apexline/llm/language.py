"""Language identification by word-first backoff.

A known word scores by the logarithm of its relative frequency in each
language.  A word that no language knows falls back to its character n-grams:
of the longest length of which the model knows some, the known ones are
averaged, else the next shorter length.  A text's score in a language is the
mean over its words; the best mean wins, ties by the language's code points.

The model is fitted on whole texts of about ``SAMPLE`` labelled documents at
most, chosen by hash.  Words and n-grams are counted by Spark in one pass; a
language knows those that it has ``OFTEN`` times at least (what stands once is
mostly noise; the rule is the same at any size).  The model holds a sorted
64-bit key for each word or n-gram and, in one sparse table, its score in the
languages that know it: about 20 bytes for each, in the driver and the workers.

Defined results: ``und`` with score 0 for a null text, one without letters, and
without any labelled document; repeated rows give equal rows; documents
without a ``doc_id`` are neither learned from nor held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import drop_kept, fresh, kept, lean, with_struct

SAMPLE = 20_000
#: Times that a language must have a word or an n-gram to know it.
OFTEN = 2
LENGTHS = (5, 4, 3, 2, 1)
#: Score of what a language lacks, below its rarest: log10 of one in ten million.
MISSING = -7.0
#: Characters that are worked on at once, and bytes of scores.
CHUNK, ROWS_BYTES = 1 << 18, 8 << 20
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def held_out(doc_id: str, folds: int, fold: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold


class Letters:
    """Code points of lower-case texts, with hashes of any run of them."""

    def __init__(self, points: np.ndarray):
        self.points = points
        up, self.down = W.powers(_BASE, len(points) + 1)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(W.mix(points + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def keys(self, start: np.ndarray, size: np.ndarray | int, kind: int) -> np.ndarray:
        """A key of each run: of a word (kind 0) or an n-gram (kind n)."""
        h = (self.sums[start + size] - self.sums[start]) * self.down[start]
        return W.mix(h + np.asarray(size, np.uint64) * np.uint64(_BASE) + np.uint64(kind))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of letters begin, and their sizes."""
        inside = np.zeros(len(self.points) + 2, np.int8)
        inside[1:-1] = _letter_table()[self.points.astype(np.int64)]
        turn = np.diff(inside)
        start = np.flatnonzero(turn == 1)
        return start, np.flatnonzero(turn == -1) - start

    def padded(self, start: np.ndarray, size: np.ndarray) -> tuple[Letters, np.ndarray]:
        """The words at ``start``, each between two spaces, and where they (with the first space) begin."""
        at = np.cumsum(size + 2) - (size + 2)
        points = np.full(int((size + 2).sum()), 0x20, np.uint64)
        inner = ranges(size)
        points[np.repeat(at + 1, size) + inner] = self.points[np.repeat(start, size) + inner]
        return Letters(points), at


_BASE = 0x9FB21C651E98DF25
_table: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.int8, 0x110000))
    return _table[0]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def gram_spans(at: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, place) of the n-grams of padded words; the spaces count for n > 1."""
    counts = np.maximum(size + 3 - n, 0) if n > 1 else size
    return np.repeat(np.arange(len(at)), counts), np.repeat(at + (n == 1), counts) + ranges(counts)


def chunked(texts: list[str | None]) -> Iterator[tuple[Letters, np.ndarray, np.ndarray, np.ndarray]]:
    """(letters, words' begins, sizes, numbers of their texts) of about CHUNK characters at once; longer texts are cut at spaces."""
    held, of, size = [], [], 0

    def made():
        joined = Letters(np.frombuffer("\n".join(held).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64))
        start, sizes = joined.words()
        first = np.cumsum([0, *[len(h) + 1 for h in held[:-1]]])
        return joined, start, sizes, np.array(of)[np.searchsorted(first, start, "right") - 1]

    for i, t in enumerate(texts):
        lower, lo = (t or "").lower(), 0
        while lo < len(lower):
            hi = lo + CHUNK
            if hi < len(lower):
                cut = lower.rfind(" ", lo, hi)
                hi = cut + 1 if cut >= 0 else (lower.find(" ", hi) + 1 or len(lower))
            held.append(lower[lo:hi])
            of.append(i)
            size += len(held[-1])
            lo = hi
            if size >= CHUNK:
                yield made()
                held, of, size = [], [], 0
    if held:
        yield made()


def sampled(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """About ``size`` rows at most, by a hash of ``key``."""
    n = docs.count()
    return docs if n <= size else docs.where((F.xxhash64(F.col(key), F.lit("sample")) / 2.0**64 + 0.5) < size / n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n) of the words and n-grams of rows (text, lang)."""
    for batch in batches:
        of = batch.column(1).to_pylist()
        names = sorted(set(of))
        lang_of = np.array([names.index(x) for x in of], np.int64)
        for letters, start, size, text in chunked(batch.column(0).to_pylist()):
            for lang in np.unique(lang_of[text]).tolist():
                own = np.flatnonzero(lang_of[text] == lang)
                keys, first, n = np.unique(letters.keys(start[own], size[own], 0), return_index=True, return_counts=True)
                first = own[first]
                padded, at = letters.padded(start[first], size[first])
                found = [(0, keys, n)]
                for k in LENGTHS:
                    word, place = gram_spans(at, size[first], k)
                    some, back = np.unique(padded.keys(place, k, k), return_inverse=True)
                    found.append((k, some, np.bincount(back, weights=n[word], minlength=len(some)).astype(np.int64)))
                for kind, some, count in found:
                    yield pa.RecordBatch.from_arrays([pa.array([names[lang]] * len(some), pa.string()), pa.array(np.full(len(some), kind, np.int32)), pa.array(some.view(np.int64)), pa.array(count)], names=["lang", "kind", "key", "n"])


class Model:
    """Keys, sorted; key i is known to the languages ``of[ptr[i]:ptr[i + 1]]``, whose scores are ``gain`` above MISSING."""

    def __init__(self, langs: list[str], keys: np.ndarray, ptr: np.ndarray, of: np.ndarray, gain: np.ndarray):
        self.langs, self.keys, self.ptr, self.of, self.gain = langs, keys, ptr, of, gain

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are known, and their numbers."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        which = np.flatnonzero(self.keys[at] == keys)
        return which, at[which]

    def scores(self, letters: Letters, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A row of scores for each word."""
        n = len(self.langs)
        out = np.full((len(start), n), MISSING)

        def add(words: np.ndarray, known: np.ndarray) -> None:
            """Means over the known pieces of each word."""
            many = self.ptr[known + 1] - self.ptr[known]
            row = np.repeat(self.ptr[known], many) + ranges(many)
            total = np.bincount(np.repeat(words, many) * n + self.of[row], weights=self.gain[row], minlength=out.size).reshape(out.shape)
            count = np.bincount(words, minlength=len(out))
            some = np.flatnonzero(count)
            out[some] += total[some] / count[some, None]

        which, known = self.known(letters.keys(start, size, 0))
        add(which, known)
        open_ = np.ones(len(start), bool)
        open_[which] = False
        left = np.flatnonzero(open_)
        padded, at = letters.padded(start[left], size[left])
        for k in LENGTHS:
            word, place = gram_spans(at, size[left], k)
            which, known = self.known(padded.keys(place, k, k))
            add(left[word[which]], known)
            found = np.zeros(len(left), bool)
            found[word[which]] = True
            left, at = left[~found], at[~found]
            if not len(left):
                break
        return out

    @classmethod
    def fit(cls, docs: DataFrame, text: str, lang: str) -> Model:
        """From rows with a text and a language."""
        counts = docs.select(text, lang).mapInArrow(lean(_count), "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
        counts = kept(counts, "words")
        totals = {(r.lang, r.kind): r.all for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("all")).collect()}  # a few rows for each language
        langs = sorted({of for of, _ in totals})
        # The vocabulary of SAMPLE documents at most, as numbers.
        found = counts.where(F.col("n") >= OFTEN).select(F.array_position(F.lit(langs), F.col("lang")).cast("int") - 1, "kind", "key", "n").toArrow() if langs else None
        drop_kept(counts)
        if not langs:
            return cls([], np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0))
        of, kind, key, n = (np.asarray(c) for c in found.columns)
        key = key.view(np.uint64)
        order = np.lexsort((of, key))
        of, kind, key, n = of[order], kind[order], key[order], n[order]
        share = np.ones((len(langs), 1 + max(LENGTHS)))
        for (name, k), total in totals.items():
            share[langs.index(name), k] = total
        keys, first = np.unique(key, return_index=True)
        return cls(langs, keys, np.append(first, len(key)), of.astype(np.int32), np.log10(n / share[of, kind]) - MISSING)


    def tell(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language and score."""
        n = len(self.langs)
        total, words = np.zeros((len(texts), max(1, n))), np.zeros(len(texts), np.int64)
        for letters, start, size, text in chunked(texts) if n else ():
            words += np.bincount(text, minlength=len(texts))
            _, first, back = np.unique(letters.keys(start, size, 0), return_index=True, return_inverse=True)
            step = max(256, ROWS_BYTES // (8 * n))
            for lo in range(0, len(first), step):  # few distinct words at a time, however many languages
                table = self.scores(letters, start[first[lo : lo + step]], size[first[lo : lo + step]])
                own = np.flatnonzero((back >= lo) & (back < lo + step))
                for j in range(n):
                    total[:, j] += np.bincount(text[own], weights=table[back[own] - lo, j], minlength=len(texts))
        mean = total / np.maximum(words, 1)[:, None]
        best = mean.argmax(axis=1)
        top = mean[np.arange(len(texts)), best]
        # Odds of the means, as if of at most ten words.
        score = 1 / np.sum(10.0 ** ((mean - top[:, None]) * np.minimum(words, 10)[:, None]), axis=1)
        return [self.langs[b] if w else "und" for b, w in zip(best.tolist(), words.tolist(), strict=True)], np.where(words > 0, score, 0.0)


def identify(docs: DataFrame, learn_from: DataFrame, text: str = "text", lang: str = "lang", name: str = "language") -> tuple[DataFrame, str]:
    """``docs`` and a struct column (its name is the second result): ``lang_pred`` and ``score``."""
    model = Model.fit(sampled(learn_from.where(F.col(text).isNotNull() & F.col(lang).isNotNull()), SAMPLE), text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def task():
        model = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            langs, scores = model.tell(batch.column(at).to_pylist())
            return {"lang_pred": langs, "score": scores}

        return run

    name = fresh(docs, name)
    return with_struct(docs, name, RESULT, task), name


def report(docs: DataFrame) -> DataFrame:
    """One row per document; learned from four fifths of the documents, by crc32 of the id."""
    out = held_out("doc_id", 5, 0)
    found, name = identify(docs.select("doc_id", "text"), docs.where(~out))
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), f"{name}.lang_pred", f"{name}.score")


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with a language that is at least this sure."""
    found, name = identify(docs, docs.where(~held_out("doc_id", 5, 0)))
    return found.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).drop(name)
