"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text, one of ordinary and
one of toxic windows.  A window is a word of ``WINDOW`` letters at least,
between spaces; its gain is by how many bytes the toxic dictionary compresses
it better.  It is written ``TIMES`` times, since the format stores what is too
short as it is.  A window counts from a gain of a threshold on; the
number and rate of such windows give a text's score.

What goes into the toxic dictionary: toxic documents are mostly ordinary
text, so of their words those that hold a typical part are taken, a part
being typical if its odds in toxic documents are far above those in ordinary
ones (``RATIO`` times and ``SURE`` standard errors, at any size).  Threshold and
scores are calibrated on one half of the labelled documents with dictionaries made
from the other, which haven't seen it; then the dictionaries are made from all.  All
come from a sample of about ``SAMPLE`` labelled documents at most, chosen by hash.

Words and parts are counted by Spark, and so are the calibration half's windows;
the driver gets typical parts, the dictionaries' words (``TOXIC_BYTES`` and
``ORDINARY_BYTES``, which are the sizes of the dictionaries) and a few numbers for
each document of the calibration half.

Dictionaries that zstandard's trainer makes of longer windows of running text were
tried, and are worse by far (see the README).

Defined results: null, empty and wordless texts score as texts without toxic
windows; without labelled documents of both kinds the score is 0 throughout;
repeated rows give equal rows; labels without a document, or null, teach nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .language import held_out, sampled
from .shared import drop_kept, fresh, kept, lean, with_struct
from .tokens import _Recent

SAMPLE = 12_000
WINDOW, TIMES = 4, 4
PARTS = (6, 8)
RATIO, OFTEN = 8.0, 5
#: Standard errors asked for.
SURE = 4.0
TOXIC_BYTES, ORDINARY_BYTES = 1 << 16, 30_000
THRESHOLDS = (2, 3, 4, 5)
WORD = re.compile(rf"[^\W\d_]{{{WINDOW},}}")
LETTERS = re.compile(r"[^\W\d_]+")
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("windows", T.LongType())])


def _parts(word: str) -> set[str]:
    padded = f" {word} "
    return {padded[i : i + k] for k in PARTS for i in range(max(1, len(padded) - k + 1))}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=15, hash_log=15, search_log=5, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, piece, half, y, n): in how many texts of rows (text, y, half) each word (kind 0) and part (kind 1) stands."""
    for batch in batches:
        seen: dict[tuple[int, int, int], Counter] = {}
        for text, y, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = set(LETTERS.findall(text.as_py().lower()))
            seen.setdefault((0, half, y), Counter()).update(own)
            seen.setdefault((1, half, y), Counter()).update({g for w in own for g in _parts(w)})
        for (kind, half, y), found in seen.items():
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(list(found), pa.string()), pa.array(np.full(n, half, np.int32)), pa.array(np.full(n, y, np.int32)), pa.array(list(found.values()), pa.int64())], names=["kind", "piece", "half", "y", "n"])


class Gains:
    """How many bytes better the toxic dictionary compresses a word."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = toxic, ordinary
        self.ready = None

    def __getstate__(self):
        return {"toxic": self.toxic, "ordinary": self.ordinary, "ready": None}

    @classmethod
    def fit(cls, counts: DataFrame, texts: list[int]) -> Gains:
        """From (kind, piece, n0, n1), in how many ordinary and toxic texts a word or part stands, and how many there are of both."""
        p, q = (F.col("n1") + 0.5) / (texts[1] + 1), (F.col("n0") + 0.5) / (texts[0] + 1)
        errors = (F.log(p / (1 - p)) - F.log(q / (1 - q))) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
        typical = counts.where(f"kind = 1 and n1 >= {OFTEN}").where((p / q > RATIO) & (errors > SURE)).select(F.col("piece").alias("part"))
        padded = F.concat(F.lit(" "), "piece", F.lit(" "))

        def cut(k: int):
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - k + 1, F.lit(1))), lambda i: F.substr(padded, i, F.lit(k)))

        parts = F.flatten(F.array(*map(cut, PARTS)))
        words = counts.where("kind = 0")
        toxic = words.where(F.col("n1") * texts[0] > 4 * F.col("n0") * texts[1]).select("piece", "n1", F.explode(parts).alias("part")).join(typical, "part", "left_semi").groupBy("piece").agg(F.first("n1").alias("n"))

        def joined(found: DataFrame, size: int) -> bytes:
            """Frequent words last, where they are near; a word has two bytes at least."""
            top = found.orderBy(F.desc("n"), F.desc("piece")).limit(size // 2).collect()
            return "".join([f"{r.piece} " for r in reversed(top)]).encode()[-size:]

        return cls(joined(toxic, TOXIC_BYTES), joined(words.where("n0 > 0").select("piece", F.col("n0").alias("n")), ORDINARY_BYTES))

    def __call__(self, word: str) -> int:
        if self.ready is None:
            t = self.toxic
            self.ready = _compressor(t), _compressor(self.ordinary), {t[i : i + 5] for i in range(len(t) - 4)}
        toxic, ordinary, runs = self.ready
        data = f" {word} ".encode()
        # Without five bytes in common, the toxic dictionary has no match that saves what a threshold asks for.
        if all(data[i : i + 5] not in runs for i in range(len(data) - 4)):
            return 0
        data = f" {word}".encode() * TIMES + b" "
        return len(ordinary.compress(data)) - len(toxic.compress(data))


class Model:
    """Gains, the threshold, and the score by the number of windows above it and their rate."""

    def __init__(self, gains: Gains, threshold: int, weights: np.ndarray):
        self.gains, self.threshold, self.weights = gains, threshold, weights

    @staticmethod
    def features(count: np.ndarray, windows: np.ndarray) -> np.ndarray:
        rate = 100 * count / (windows + 30)
        return np.stack([np.ones(len(count)), np.log1p(count), np.minimum(count, 3), np.log1p(rate)], axis=1)

    @classmethod
    def fit(cls, rows: DataFrame) -> Model | None:
        """From (text, y, half)."""
        counts = rows.mapInArrow(lean(_count), "kind int, piece string, half int, y int, n long")
        of = lambda y, half: F.sum(F.when((F.col("y") == y) & F.col("half").isin(half), F.col("n")).otherwise(0))
        counts = kept(counts.groupBy("kind", "piece").agg(of(0, [0]).alias("a0"), of(1, [0]).alias("a1"), of(0, [0, 1]).alias("b0"), of(1, [0, 1]).alias("b1")), "pieces")
        n = {(r.half, r.y): r.n for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}  # four rows at most
        if len(n) < 4:
            return None
        gains = Gains.fit(counts.select("kind", "piece", F.col("a0").alias("n0"), F.col("a1").alias("n1")), [n[0, 0], n[0, 1]])
        shared = rows.sparkSession.sparkContext.broadcast(gains)

        def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = _Recent(shared.value, 200_000)
            for batch in batches:
                values = [[memo[w] for w in WORD.findall(t.as_py().lower())] for t in batch.column(0)]
                counts = [pa.array([sum(g >= t for g in v) for v in values], pa.int64()) for t in THRESHOLDS]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(map(len, values), pa.int64()), *counts], names=["y", "windows", *(f"c{t}" for t in THRESHOLDS)])

        # Some numbers for each text of half a sample.
        test = rows.where("half = 1").select("text", "y").mapInArrow(lean(above), "y int, windows long, " + ", ".join(f"c{t} long" for t in THRESHOLDS)).toArrow()
        y, windows = np.asarray(test["y"]).astype(float), np.asarray(test["windows"])
        best = None
        for threshold in THRESHOLDS:
            x = cls.features(np.asarray(test[f"c{threshold}"]), windows)
            w = np.zeros(x.shape[1])
            for _ in range(25):  # Newton's method, with a small penalty
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
            loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
            if best is None or loss < best[0]:
                best = loss, threshold, w
        whole = Gains.fit(counts.select("kind", "piece", F.col("b0").alias("n0"), F.col("b1").alias("n1")), [n[0, 0] + n[1, 0], n[0, 1] + n[1, 1]])
        drop_kept(counts)
        return cls(whole, best[1], best[2])

    def __call__(self, texts: list[str | None], memo: _Recent) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros((2, len(texts)))
        for i, t in enumerate(texts):
            words = WORD.findall(t.lower()) if t else []
            counts[0, i] = sum([g >= self.threshold for g in map(memo.__getitem__, words)])
            counts[1, i] = len(words)
        return 1 / (1 + np.exp(-np.clip(self.features(*counts) @ self.weights, -30, 30))), counts[0].astype(np.int64)


def score(docs: DataFrame, labelled: DataFrame, text: str = "text", name: str = "toxicity") -> tuple[DataFrame, str]:
    """``docs`` and a struct column (its name is the second result): ``score`` and ``windows``; learned from (doc_id, text, toxic)."""
    rows = sampled(labelled.where("text is not null and toxic is not null"), SAMPLE)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    model = Model.fit(kept(rows.select("text", (F.col("toxic") > 0).cast("int").alias("y"), half.alias("half")), "labelled"))
    name = fresh(docs, name)
    if model is None:
        return docs.withColumn(name, F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("windows"))), name
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def task():
        memo = _Recent(shared.value.gains, 200_000)

        def run(batch: pa.RecordBatch) -> dict:
            scores, windows = shared.value(batch.column(at).to_pylist(), memo)
            return {"score": scores, "windows": windows}

        return run

    return with_struct(docs, name, RESULT, task), name


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; learned from three quarters of the labels, by crc32 of the id."""
    out = held_out("doc_id", 4, 2)
    labelled = labels.where(~out).select("doc_id", "toxic").join(docs.select("doc_id", "text"), "doc_id")
    found, name = score(docs.select("doc_id", "text"), labelled)
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), f"{name}.score", (F.col(f"{name}.score") >= 0.3).cast("int").alias("predicted"))
