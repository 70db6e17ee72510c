"""Exact top-k inner-product search.

Vectors are turned into integers, ``floor(scale * x)``, and sorted by descending
length into blocks of ``BLOCK``; queries are blocked too.

*  Blocks are processed by descending length, in waves of 3, 12, 48, ... blocks.
   After each wave every query's k-th best so far is its floor in the next.  By
   Cauchy-Schwarz a query can't score above |q| |v|, so a pair of blocks whose
   longest query and vector stay below the lowest floor is never made.
*  In a block, coordinates are rotated by the SVD of a sample, which gathers
   length in the first ones.  A partial sum over these, plus the product of
   what is left of both lengths, bounds the score; pairs whose bound stays below
   the query's floor are pruned.
*  The rest is scored exactly, on integers.

The rotation only decides how much is pruned, never the result, so it is fitted
on ``SAMPLE`` vectors, chosen by hash.  Pairs of blocks are made as numbers, dealt
by a salt; a vector block is sent once for each query block it may matter to, a
query block once for each salt.  So no task holds more than two blocks, and equal
or very common vectors make no task larger.  Nothing that grows with the data is
broadcast.

Defined results: vectors null, or with null or non-finite components, take no
part, as query or candidate; vectors of different lengths don't meet; ties go
to the smaller id; a query's own id is no candidate; a query that meets nobody
has no rows.  Rows without an id take no part; of an id that stands in several
rows the smallest vector counts.  Integers and scores beyond 64 bits are taken at
the end of their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import drop_kept, kept, lean

BLOCK, QUERIES = 4096, 2048
#: How many times more blocks each wave has.
GROWTH = 4
#: Queries of a block that are scored at once.
ROWS = 512
SAMPLE = 4096
#: Share of the rotated coordinates in the partial sums.
FIRST = 0.25
BLOCKS = "dim int, block long, most double, bits int, ids binary, whole binary, turned binary, rest binary"
END = 2**63 - 1


def usable(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(id, v): the integers of the vectors that take part."""
    x = F.col(embedding).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = vectors.where(fine).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * float(scale))).cast("array<bigint>").alias("v"))
    return ints.groupBy("id").agg(F.min("v").alias("v"))


def _rotations(ints: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal matrix for each length of vectors, from a sample's SVD; a length without one isn't rotated."""
    rows = ints.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # SAMPLE vectors
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.v), []).append(r.v)
    return {n: np.linalg.svd(np.array(v, float), full_matrices=True)[2] for n, v in by.items() if n}


def _pack(rotations, size: int):
    """Blocks of rows (id, v) that come sorted by length of vector, then by descending norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0

        def block(dim: int, ids: list, vs: list) -> pa.RecordBatch:
            nonlocal made
            v = np.array(vs, np.int64).reshape(len(vs), dim)
            turn = rotations.value.get(dim)
            turned = v.astype(float) @ turn.T if turn is not None else v.astype(float)
            first = max(1, int(dim * FIRST))
            norms, rest = np.sqrt((v.astype(float) ** 2).sum(axis=1)), np.sqrt((turned[:, first:] ** 2).sum(axis=1))
            # As narrow as the integers and the bounds' slack allow: this is what is sent about.
            bits = next(b for b in (16, 32, 64) if b == 64 or not v.size or (-(2 ** (b - 1)) <= v.min() and v.max() < 2 ** (b - 1)))
            row = [dim, part << 32 | made, norms.max(), bits, np.array(ids, np.int64).tobytes(), v.astype(f"<i{bits // 8}").tobytes(), turned[:, :first].astype("<f4").tobytes(), rest.astype("<f4").tobytes()]
            made += 1
            kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["dim", "block", "most", "bits", "ids", "whole", "turned", "rest"])

        ids, vs = [], []
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vs and (len(vs) == size or len(vs[0]) != len(v)):
                    yield block(len(vs[0]), ids, vs)
                    ids, vs = [], []
                ids.append(i)
                vs.append(v)
        if vs:
            yield block(len(vs[0]), ids, vs)

    return run


def _blocks(ints: DataFrame, rotations, size: int) -> DataFrame:
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    ordered = ints.withColumns({"dim": F.size("v"), "norm": norm}).repartitionByRange("dim", F.desc("norm"), "id").sortWithinPartitions("dim", F.desc("norm"), "id")
    return kept(ordered.select("id", "v").mapInArrow(lean(_pack(rotations, size)), BLOCKS), "blocks")


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact; beyond 64 bits the end of the range."""
    a, b = q.astype(float), v.astype(float)
    largest = np.sqrt((a**2).sum(axis=1)).max(initial=0) * np.sqrt((b**2).sum(axis=1)).max(initial=0)
    if largest < 2.0**52:  # then every sum of products is exact in doubles
        return (a @ b.T).astype(np.int64)
    if largest < 2.0**62:
        return q @ v.T
    return np.clip(q.astype(object) @ v.T.astype(object), -END - 1, END).astype(np.int64)


def best_of(q_ids, q, q_first, q_rest, floor, ids, v, first, rest, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's k best of a block, of those that reach its floor."""
    bound = q_first @ first.T + q_rest[:, None] * rest[None, :]
    slack = 1e-5 * (np.sqrt((q_first**2).sum(axis=1)) + q_rest)[:, None] * (np.sqrt((first**2).sum(axis=1)) + rest)[None, :] + 1e-6
    open_ = bound + slack >= floor[:, None]
    open_ &= q_ids[:, None] != ids[None, :]
    out = []
    rows = np.flatnonzero(open_.any(axis=1))
    cols = np.flatnonzero(open_.any(axis=0)) if len(rows) else rows
    whole = products(q[rows], v[cols])
    for n, i in enumerate(rows.tolist()):
        score = whole[n]
        keep = open_[i, cols] & (score >= floor[i])
        at, score = cols[keep], score[keep]
        if len(at) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= edge
            at, score = at[keep], score[keep]
        order = np.lexsort((ids[at], ~score))[:k]
        out += [(int(q_ids[i]), int(ids[at[j]]), int(score[j])) for j in order.tolist()]
    return out


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                dim = row["dim"]
                sides = []
                for side in ("q_", ""):
                    ids, v = np.frombuffer(row[side + "ids"], np.int64), np.frombuffer(row[side + "whole"], f"<i{row[side + 'bits'] // 8}").astype(np.int64)
                    first, rest = (np.frombuffer(row[side + n], "<f4").astype(float) for n in ("turned", "rest"))
                    sides += [ids, v.reshape(len(ids), dim), first.reshape(len(ids), -1), rest]
                floor = np.frombuffer(row["floor"], float)
                found = []
                for lo in range(0, len(sides[0]), ROWS):
                    found += best_of(*[x[lo : lo + ROWS] for x in sides[:4]], floor[lo : lo + ROWS], *sides[4:], k)
                yield pa.RecordBatch.from_arrays([pa.array([row["q_block"]] * len(found), pa.int64()), *[pa.array([f[j] for f in found], pa.int64()) for j in range(3)]], names=["q_block", "query_id", "vec_id", "score"])

    return run


def _floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The floors of a block's queries, in their order, and the lowest."""
    for batch in batches:
        for i in range(batch.num_rows):
            got = dict(batch.column("known")[i].as_py() or [])
            floor = np.array([float("-inf") if got.get(q) is None else got[q] for q in np.frombuffer(batch.column("q_ids")[i].as_py(), np.int64).tolist()], float)
            floor -= np.where(np.abs(floor) > 2.0**52, np.abs(floor) * 1e-15, 0)  # such scores aren't exact in doubles
            yield pa.RecordBatch.from_arrays([batch.column("q_block").slice(i, 1), pa.array([floor.tobytes()], pa.binary()), pa.array([floor.min(initial=np.inf)], pa.float64())], names=["q_block", "floor", "lowest"])


FOUND = "q_block long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best ``vectors`` for each of ``queries``, both (vec_id, embedding)."""
    spark = vectors.sparkSession
    ints = kept(usable(vectors, vec_id, embedding, scale), "integers")
    rotations = spark.sparkContext.broadcast(_rotations(ints))
    blocks = _blocks(ints, rotations, BLOCK)
    asked = _blocks(usable(queries, vec_id, embedding, scale), rotations, QUERIES)
    asked = kept(asked.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("block", "most", "bits", "ids", "whole", "turned", "rest")]), "asked")
    # Blocks are numbered by descending length; numbers only.
    wave = F.floor(F.log(float(GROWTH), F.row_number().over(Window.partitionBy("dim").orderBy("block")).cast("double")) + 1e-9).cast("int")
    order = kept(blocks.select("dim", "block", "most", wave.alias("wave")), "order")
    sizes = [r.n for r in order.groupBy("wave").agg(F.count("*").alias("n")).orderBy("wave").collect()]  # a row for each wave, of which there are few

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)

    top = spark.createDataFrame([], f"{FOUND}, rank int")
    for number, size in enumerate(sizes):
        known = top.where(F.col("rank") == k).groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("known"))
        levels = kept(asked.select("q_block", "q_ids").join(known, "q_block", "left").mapInArrow(lean(_floors), "q_block long, floor binary, lowest double"), "floors")
        salts = min(64, max(1, size // 4))
        salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))  # noqa: E731, B023
        salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt")
        small = salted(asked.select("dim", "q_block", "q_most").join(levels.select("q_block", "lowest"), "q_block"))
        pairs = order.where(F.col("wave") == number).select("dim", "block", "most", salt).join(small, ["dim", "salt"]).where("q_most * most * (1 + 1e-9) + 1e-6 >= lowest").select("block", "q_block", "salt")
        pairs = pairs.join(blocks, "block").join(salted(asked.drop("dim").join(levels.select("q_block", "floor"), "q_block")), ["q_block", "salt"])
        found = pairs.mapInArrow(lean(_score(k)), FOUND)
        before, top = top, kept(best(top.drop("rank").unionByName(found)), "top")
        drop_kept(levels)
        if number:
            drop_kept(before)
    return top.select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The query set: the rows with an id divisible by ``every``, against all rows."""
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
