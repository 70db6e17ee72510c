"""Centroid clustering: Lloyd's rounds on exact integers, by differences.

Vectors become integers, ``floor(scale * x)``, and are packed into blocks of
``BLOCK``, which are written once, bucketed by block.  What a round changes is
kept apart, in a narrow table of the same buckets: owner and squared distance of
each vector.  A round

*  reads the blocks and the last round's owners bucket by bucket, without an
   exchange;
*  compares a vector whose owner has moved with all centroids, and every other
   one only with the centroids that have moved, since its distance to its owner
   is known and what else stayed put was no nearer before;
*  writes the new owners, and with each block the signed transfers of the vectors
   that changed hands: minus their sum for the old owner, plus it for the new;
*  adds up these transfers, one row for each block and centroid, and applies them
   to the global sums and counts, which the driver keeps (``k`` vectors).

When no centroid moves, later rounds would change nothing and are left out.

Sums are carried as two halves of 32 bits and more, so that they are exact.
Where components are so large that a distance might not fit 64 bits, it is computed
with Python's integers, and vectors are compared with all centroids each round.

Defined results: a vector that is null, has another number of components than
``dim`` or a null or non-finite one is not kept; with fewer than ``k`` kept vectors
there are as many clusters; rows with a null id are clustered, but are chosen as
first centroids last; repeated rows are different vectors; ties go to the smaller
centroid; an empty table gives an empty result.  Integers beyond 64 bits, and
distances and sums of them in the result, are taken at the end of their range.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_kept, kept, lean, new_path, small_batches

BLOCK = 4096
#: Bytes of vectors in a bucket, about.
BUCKET_BYTES = 128 << 20
END = 2**63 - 1
BLOCKS = "block long, ids binary, has_id binary, v binary, wide boolean"
STATE = "block long, owner binary, far binary, transfers array<struct<c: int, n: bigint, high: array<bigint>, low: array<bigint>>>"


def usable(vectors: DataFrame, vec_id: str, embedding: str, dim: int, scale: int) -> DataFrame:
    """(id, v): the integers of the vectors that are kept."""
    x = F.col(embedding).cast("array<double>")
    fine = F.col(embedding).isNotNull() & (F.size(embedding) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(fine).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * float(scale))).cast("array<bigint>").alias("v"))


def first_centroids(ints: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``; equal ids by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = ints.orderBy(key.asc_nulls_last(), "v").limit(k).collect()  # k vectors
    return np.array([r.v for r in rows], object)


def _wide(most: int, dim: int) -> bool:
    """Whether distances of vectors whose components are up to ``most`` may not fit 64 bits."""
    return 4 * dim * most * most >= 1 << 62


def _pack(dim: int):
    """Blocks of the rows (id, v) of a task, numbered by task and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def blocks(rows: pa.Table, all_: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held, n
            for at in range(0, rows.num_rows if all_ else rows.num_rows - BLOCK + 1, BLOCK):
                block = rows.slice(at, BLOCK).combine_chunks()
                ids, values = block.column(0).combine_chunks(), np.asarray(block.column(1).combine_chunks().flatten(), np.int64)
                wide = _wide(max(int(values.max()), -int(values.min())), dim)
                columns = [[number], [np.asarray(ids.fill_null(0), np.int64).tobytes()], [np.asarray(ids.is_valid(), bool).tobytes()], [values.astype("<i8" if wide else "<i4").tobytes()], [wide]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], names=["block", "ids", "has_id", "v", "wide"])
                number += 1
            left = rows.slice(0 if all_ else rows.num_rows // BLOCK * BLOCK)
            held, n = left.to_batches(), left.num_rows

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield from blocks(pa.Table.from_batches(held), False)
        if n:
            yield from blocks(pa.Table.from_batches(held), True)

    return run


def _bucketed(df: DataFrame, name: str, buckets: int) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder in buckets by block, as a table; and the table's name."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.bucketBy(buckets, "block").option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table), table


def _drop(df: DataFrame, table: str) -> None:
    drop_kept(df)
    df.sparkSession.sql(f"drop table if exists {table}")


def distances(v: np.ndarray, centroids: np.ndarray, wide: bool) -> np.ndarray:
    """Exact squared distances of the rows of ``v`` to the rows of ``centroids``."""
    most = max((abs(int(x)) for x in centroids.ravel()), default=0)
    if wide or _wide(most, v.shape[1]):
        v, c = v.astype(object), centroids.astype(object)
        return np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)
    kind = np.float64 if max(most, int(np.abs(v).max())) ** 2 * 4 * v.shape[1] < 1 << 53 else np.int64
    v, c = v.astype(kind), centroids.astype(kind)
    return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def reassign(v: np.ndarray, wide: bool, owner: np.ndarray | None, far: np.ndarray | None, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) of each vector; ``owner`` and ``far`` are those of before ``moved`` centroids did."""
    if owner is None or wide or _wide(max(abs(int(x)) for x in centroids.ravel()), v.shape[1]):
        d = distances(v, centroids, wide)
        best = np.argmin(d, axis=1)
        return best.astype(np.int32), d[np.arange(len(d)), best]
    owner, far = owner.copy(), far.copy()
    lost = moved[owner]
    if lost.any():
        d = distances(v[lost], centroids, False)
        owner[lost] = np.argmin(d, axis=1)
        far[lost] = d.min(axis=1)
    stayed = np.flatnonzero(~lost)
    which = np.flatnonzero(moved)
    if len(stayed) and len(which):
        d = distances(v[stayed], centroids[which], False)
        at = np.argmin(d, axis=1)
        near, rival = d[np.arange(len(d)), at], which[at]
        wins = (near < far[stayed]) | ((near == far[stayed]) & (rival < owner[stayed]))
        owner[stayed[wins]], far[stayed[wins]] = rival[wins], near[wins]
    return owner, far


def transfers(v: np.ndarray, wide: bool, before: np.ndarray | None, after: np.ndarray) -> list[dict]:
    """Signed sums of the vectors that changed hands, for each centroid that won or lost some."""
    changed = np.ones(len(after), bool) if before is None else before != after
    v, after = v[changed].astype(object if wide else np.int64), after[changed]
    sides = [(after, 1)] + ([] if before is None else [(before[changed], -1)])
    out = []
    for c in np.unique(np.concatenate([s for s, _ in sides])).tolist():
        n = sum(sign * int((s == c).sum()) for s, sign in sides)
        total = sum(sign * v[s == c].sum(axis=0) for s, sign in sides if (s == c).any())
        out.append({"c": c, "n": n, "high": [int(x) >> 32 for x in total], "low": [int(x) & 0xFFFFFFFF for x in total]})
    return out


def _matrix(payload: pa.Scalar, wide: bool, dim: int) -> np.ndarray:
    return np.frombuffer(payload.as_buffer(), "<i8" if wide else "<i4").reshape(-1, dim).astype(np.int64)


def _round(centroids: list[list[int]], moved: list[bool], dim: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, those = np.array(centroids, object), np.array(moved, bool)
        for batch in batches:
            for i in range(batch.num_rows):
                wide = batch.column(2)[i].as_py()
                v = _matrix(batch.column(1)[i], wide, dim)
                owner = far = None
                if not first:
                    owner = np.frombuffer(batch.column(3)[i].as_buffer(), "<i4")
                    far = np.frombuffer(batch.column(4)[i].as_buffer(), "<i8")
                new, distance = reassign(v, wide, owner, far, to, those)
                held = np.minimum(distance, END).astype("<i8")
                columns = [[batch.column(0)[i].as_py()], [new.astype("<i4").tobytes()], [held.tobytes()], [transfers(v, wide, owner, new)]]
                kind = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), kind), strict=True)], names=["block", "owner", "far", "transfers"])

    return run


def _sums(state: DataFrame) -> list[tuple[int, int, int, int]]:
    """(centroid, component or -1, high, low) sums of a round's transfers; -1 has the counts."""
    each = state.select(F.explode("transfers").alias("t"))
    parts = each.select("t.c", F.lit(-1).alias("i"), F.lit(0).cast("long").alias("high"), F.col("t.n").alias("low")).unionByName(
        each.select("t.c", F.posexplode(F.arrays_zip("t.high", "t.low")).alias("i", "x")).select("c", "i", "x.high", "x.low")
    )
    return [tuple(r) for r in parts.groupBy("c", "i").agg(F.sum("high"), F.sum("low")).collect()]  # k * (dim + 1) rows


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept vector, and the final centroids (k rows of integers)."""
    spark = vectors.sparkSession
    ints = usable(vectors, vec_id, embedding, dim, scale)
    centroids = first_centroids(ints, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"`{vec_id}` long, cluster int, distance long"), centroids
    packed = kept(ints.mapInArrow(lean(_pack(dim)), BLOCKS), "packed")
    size = packed.agg(F.sum(F.length("v"))).first()[0]
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    blocks, blocks_table = _bucketed(packed.repartition(buckets, "block"), "blocks", buckets)
    drop_kept(packed)

    sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), object)
    moved, state, table = np.ones(len(centroids), bool), None, ""
    for n in range(rounds + 1):
        if not moved.any():
            break
        task = lean(_round(centroids.tolist(), moved.tolist(), dim, state is None))
        columns = ["block", "v", "wide"]
        joined = blocks.select(columns) if state is None else blocks.select(columns).join(state.select("block", "owner", "far").hint("shuffle_hash"), "block").select(*columns, "owner", "far")
        new, new_table = _bucketed(joined.mapInArrow(task, STATE), "owners", buckets)
        if state is not None:
            _drop(state, table)
        state, table = new, new_table
        if n == rounds:
            break
        for c, i, high, low in _sums(state):
            if i < 0:
                counts[c] += low
            else:
                sums[c, i] += (high << 32) + low
        next_ = np.array([[x // m for x in s] if m else old.tolist() for s, m, old in zip(sums, counts, centroids, strict=True)], object)
        moved, centroids = (next_ != centroids).any(axis=1), next_
    rows = blocks.select("block", "ids", "has_id").join(state.select("block", "owner", "far").hint("shuffle_hash"), "block").select("ids", "has_id", "owner", "far")
    out = kept(rows.mapInArrow(lean(_unpack), "id long, cluster int, distance long").withColumnRenamed("id", vec_id), "clusters")
    _drop(state, table)
    _drop(blocks, blocks_table)
    return out, centroids


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, has, owner, far = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate(("<i8", bool, "<i4", "<i8")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=~has), pa.array(owner, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])



def report(vectors: DataFrame) -> DataFrame:
    """Each kept vector's cluster, distance, inertias and the digest of its centroid."""
    found, centroids = cluster(vectors)
    totals = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    whole = sum(int(r.d) for r in totals)
    rows = [(r.cluster, min(int(r.d), END), min(whole, END), hashlib.sha256(",".join(str(x) for x in centroids[r.cluster]).encode()).hexdigest()) for r in totals]
    facts = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def brute_force(rows: list[tuple[int | None, list | None]], k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> list[tuple]:
    """What :func:`report` gives, by plain Lloyd rounds with Python's integers; for tests."""
    import math

    held = lambda x: max(-END - 1, min(END, x))
    all_ = [(i, [held(math.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(all_, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in all_]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(all_, owners, strict=True) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    final = [(i, *nearest(v)) for i, v in all_]
    part = {c: sum(min(d, END) for _, d, o in final if o == c) for c in range(len(centroids))}
    return [(i, c, min(d, END), min(part[c], END), min(sum(part.values()), END), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in final]
