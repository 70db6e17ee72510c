"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / size of the source`` times, a
number from 0 to 2.  Its whole part is taken; the fractional parts are rounded
so that the words taken from a source stay what they should be: two documents
with fractional copies are paired, and words of expected mass move from one to
the other, either way with such chances that no document's expectation
changes, until one of them is integral.  The other goes on.  What the
documents of a source are expected to give in words never changes, so the
source ends within one document of its target.

The pairing is a tree: documents are dealt by hash into buckets of about
``BUCKET`` documents of one source, each bucket leaves one document at most,
and ``FAN`` buckets' leftovers meet at the next level.  A source with a third of
all rows has more buckets, not larger ones.  Chances come from hashes of the
documents and ``seed``, so reruns agree whatever the partitions.  Only sizes and
keys are shuffled, no text.

Targets: sources by code point, null last, weigh ``weights`` in turn and share
``amount`` times all sizes; a target stops at twice its source's size, the
excess being shared again by weight.

Defined results: a null or empty text has size 0 (it is copied by chance alone
and takes no words); a source without words has target 0; repeated rows are
documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, kept

BUCKET, FAN = 4096, 256
LARGE = 0.02
#: Most rows of a table of sources that is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def _ranked(stats: DataFrame) -> DataFrame:
    """``stats`` and each source's place in code point order, null last; by ranges, with no task that sees all."""
    placed = stats.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id())
    placed = kept(placed, "sources")
    part = F.shiftright("at", 33)
    before, total = [], 0
    for p, n in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # a row for each partition
        before.append((p, total))
        total += n
    offsets = stats.sparkSession.createDataFrame(before, "p long, before long")
    return placed.join(F.broadcast(offsets), part == F.col("p")).withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("p", "before", "at")


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), amount: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, documents, target) from (source, size)."""
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    stats = kept(_ranked(stats).withColumn("weight", weigh), "weights")
    total = amount * (stats.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # as often as some target is newly above its source's most
        above = F.col("weight") * level > most * F.col("source_size")
        held, free, n = stats.agg(F.coalesce(F.sum(F.when(above, most * F.col("source_size"))), F.lit(0)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == capped or not free:
            break
        capped, level = n, (total - held) / free
    return stats.select("source", "source_size", "documents", F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double")).alias("target"))


def _chance(a: int, b: int, seed: int) -> float:
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * by) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) * 2.0**-53


def pivotal(sizes: list[int], shares: list[float], keys: list[int], seed: int) -> list[float]:
    """The shares, of documents in descending size, after pairing: all 0 or 1 but one at most.

    A document with more than ``LARGE`` of the words of those after it is paired
    with all of them at once, each giving or taking in proportion; pairs of
    documents would leave it to the end, as what doesn't fit.
    """
    out, size = np.array(shares, float), np.array(sizes, float)
    open_ = (out > 0) & (out < 1)
    rest = np.cumsum((size * open_)[::-1])[::-1]
    large = np.flatnonzero(open_[:-1] & (size[:-1] > LARGE * rest[1:]) & (rest[1:] > 0)) if len(out) else []
    for i in large.tolist():
        a, pool = size[i], np.flatnonzero((out > 0) & (out < 1) & (np.arange(len(out)) > i))
        if not 0 < out[i] < 1 or not len(pool):
            continue
        give, has, room = a * out[i], (size * out)[pool].sum(), (size * (1 - out))[pool].sum()
        up, down = min(a - give, has), min(give, room)
        if _chance(keys[i], keys[pool[0]], seed) * (up + down) < down:
            out[i] = 1.0 if up == a - give else (give + up) / a
            out[pool] = 0.0 if up == has else out[pool] * ((has - up) / has)
        else:
            out[i] = 0.0 if down == give else (give - down) / a
            out[pool] = 1.0 if down == room else 1 - (1 - out[pool]) * ((room - down) / room)
    out = out.tolist()
    carry = -1
    for j in range(len(out)):
        if not 0 < out[j] < 1:
            continue
        if carry < 0:
            carry = j
            continue
        i, a, b = carry, sizes[carry], sizes[j]
        give, take = a * out[i], b * out[j]
        up, down = min(a - give, take), min(give, b - take)  # words that can move from j to i, and back
        if _chance(keys[i], keys[j], seed) * (up + down) < down:
            out[i], out[j] = (1.0 if up == a - give else (give + up) / a), (0.0 if up == take else (take - up) / b)
        else:
            out[i], out[j] = (0.0 if down == give else (give - down) / a), (1.0 if down == b - take else (take + down) / b)
        carry = i if 0 < out[i] < 1 else j if 0 < out[j] < 1 else -1
    return out


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **how) -> DataFrame:
    """(doc_id, k1, k2, source, size, source_size, target, copies) for each row of ``docs``."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = kept(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("k1"), F.hash(text, doc_id).alias("k2"), F.col(source).alias("source"), size.alias("size")), "sizes")
    table = kept(targets(sized, **how), "targets")
    n, largest = table.agg(F.count("*"), F.max("documents")).first()
    side = F.broadcast(table) if n <= BROADCAST_ROWS else table
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    rows = sized.withColumnRenamed("source", "s").join(side, F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn("rate", rate)
    whole = F.floor("rate").cast("int")
    rows = rows.withColumns({"whole": whole, "share": F.col("rate") - whole, "bucket": F.pmod(F.col("k1"), F.ceil(F.col("documents") / BUCKET)).cast("long")}).drop("rate", "documents")

    def fold(level: int, last: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["size", "k1", "k2"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            keys = group["k1"].astype("int64").tolist()
            share = group["share"].to_numpy(float).copy()
            for i in np.flatnonzero((group["size"].to_numpy() == 0) & (share > 0)):  # without words: by chance alone
                share[i] = float(_chance(keys[i], 0, seed) < share[i])
            share = pivotal(group["size"].tolist(), share.tolist(), keys, seed + level)
            if last:
                share = [float(_chance(k, 1, seed) < s) if 0 < s < 1 else s for k, s in zip(keys, share, strict=True)]
            return group.assign(share=share, bucket=group["bucket"] // FAN)

        return run

    done, buckets, level = None, max(1, -(-(largest or 0) // BUCKET)), 0
    while True:
        last = buckets == 1
        folded = kept(rows.groupBy("source", "bucket").applyInPandas(fold(level, last), rows.schema), "folded")
        ready = folded if last else folded.where("share = 0 or share = 1")
        done = ready if done is None else done.unionByName(ready)
        if last:
            break
        rows, buckets, level = folded.where("share > 0 and share < 1"), -(-buckets // FAN), level + 1
    return done.select("doc_id", "k1", "k2", "source", "size", "source_size", "target", (F.col("whole") + F.col("share").cast("int")).alias("copies"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    k1, k2, n = fresh(docs, "k1"), fresh(docs, "k2"), fresh(docs, "copies")
    taken = copies(docs, **how).groupBy("k1", "k2").agg(F.sum("copies").alias("n")).where("n > 0").toDF(k1, k2, n)
    keyed = docs.withColumns({k1: F.xxhash64("doc_id", "text"), k2: F.hash("text", "doc_id")})
    once = keyed.join(taken, [k1, k2]).dropDuplicates([k1, k2])
    return once.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(k1, k2, n)
