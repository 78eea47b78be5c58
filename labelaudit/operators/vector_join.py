"""Exact nearest vectors of a whole table of queries, by Euclidean distance, in blocks.

Each vector belongs to the cell of its nearest pivot, and a cell's vectors to blocks by rings of their distance to
the pivot. By the triangle inequality, and by the lengths of both vectors, a query knows a least distance to each
block. It first meets the block that is likely to hold its neighbours, and then only blocks whose least distance is
no larger than the k-th it has found. Pivots are a bounded sample; they decide how much is left out, never what is
found. A task holds one block, and queries pass it in batches; no task and not the driver holds a side, only
the blocks' distances, of which there are MAX_BLOCKS at most.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; nor do null ids, or
vectors of another length than the first pivot's; rows that repeat an id and vector are ranked once as neighbours,
and a query id with several vectors gets the nearest of all of them; ties go to the smaller id; with fewer vectors
than k all are given; without vectors or queries there are no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelaudit.operators.joins import durable, partitions

PIVOTS = 16
#: Vectors of a block, and of all blocks how many there may be.
BLOCK = 65_536
LEAST_BLOCK = 8_192
MAX_BLOCKS = 65_536
#: Blocks besides one a pivot, as long as these hold no more than BLOCK: a query may have to be sent to each block, so
#: their number must not grow with the vectors'.
BLOCKS = 32
#: Queries of a batch that meet a block at once.
BATCH = 256
#: Rounding of a distance in double precision, as a share of the lengths involved.
SLACK = 1e-9


def block_size(n: int) -> int:
    """Vectors of a block, of n in all."""
    return max(min(BLOCK, max(LEAST_BLOCK, n // BLOCKS)), n // MAX_BLOCKS)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: the rows that take part, as doubles."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    found = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return found.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def _gaps(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    return np.stack([_lengths(v - p) for p in pivots], axis=1)


@dataclass
class Blocks:
    """What is known of each block: its pivot, how many vectors it has, and the least and largest distance to the
    pivot and length of these."""

    pivots: np.ndarray
    number: np.ndarray
    pivot: np.ndarray
    count: np.ndarray
    near: np.ndarray
    far: np.ndarray
    short: np.ndarray
    long: np.ndarray

    def least(self, q: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """No vector of a block is nearer to a query than this."""
        g, n = gaps[:, self.pivot], _lengths(q)[:, None]
        low = np.maximum(np.maximum(g - self.far, self.near - g), np.maximum(n - self.long, self.short - n))
        return np.maximum(low, 0) - SLACK * (g + n + self.long)


def blocks_of(vectors: DataFrame, pivots: np.ndarray, block: int) -> tuple[DataFrame, Blocks]:
    """block, id, v; and what is known of the blocks."""
    dim = pivots.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                v = _matrix(part.column("v"))
                gaps = _gaps(v, pivots)
                cell = gaps.argmin(axis=1)
                columns = [part.column("id"), part.column("v"), pa.array(cell.astype(np.int32)), pa.array(gaps[np.arange(len(cell)), cell]), pa.array(_lengths(v))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "cell", "gap", "len"])

    same = vectors.where(F.size("v") == dim)
    placed = durable(same.mapInArrow(assign, "id long, v array<double>, cell int, gap double, len double"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    rings = F.ceil(F.col("n") / block).cast("int")  # of equal numbers, by the distance to the pivot
    shares = F.array(*[F.lit(i / 256) for i in range(1, 256)])
    ringed = placed.join(F.broadcast(sizes.select("cell", rings.alias("rings"))), "cell")
    cuts = ringed.groupBy("cell", "rings").agg(F.percentile_approx("gap", shares, 2000).alias("__cuts"))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.col("rings"), F.lit(1))), lambda i: F.get("__cuts", F.least(F.floor(i * 256 / F.col("rings")).cast("int") - 1, F.lit(254))))
    cuts = cuts.select("cell", "rings", F.slice(every, 1, F.greatest(F.least("rings", F.lit(256)) - 1, F.lit(0))).alias("cuts"))
    ring = F.size(F.filter("cuts", lambda c: c < F.col("gap")))
    # what one ring has too many, because distances repeat or there are few rings, is dealt by a hash
    ringed = placed.join(F.broadcast(cuts), "cell").withColumn("ring", ring)
    held = ringed.groupBy("cell", "ring").agg(F.count("*").alias("__n")).withColumn("pieces", F.ceil(F.col("__n") / (2 * block)).cast("int"))
    piece = F.pmod(F.xxhash64("id", "v"), F.col("pieces").cast("long"))
    keyed = ringed.join(F.broadcast(held.drop("__n")), ["cell", "ring"]).withColumn("block", F.concat_ws(":", "cell", "ring", piece))
    ends = [F.min("gap").alias("near"), F.max("gap").alias("far"), F.min("len").alias("short"), F.max("len").alias("long"), F.first("cell").alias("cell")]
    known = sorted(keyed.groupBy("block").agg(F.count("*").alias("n"), *ends).collect(), key=lambda r: r.block)  # MAX_BLOCKS or so
    column = lambda c: np.array([r[c] for r in known])
    blocks = Blocks(pivots, column("block"), column("cell").astype(np.int64), column("n"), *[column(c).astype(float) for c in ("near", "far", "short", "long")])
    numbers = vectors.sparkSession.createDataFrame([(r.block, i) for i, r in enumerate(known)], "block string, number int")
    return keyed.join(F.broadcast(numbers), "block").select(F.col("number").alias("block"), "id", "v"), blocks


def routed(queries: DataFrame, blocks: Blocks, first: bool) -> DataFrame:
    """block, id, v: each query for the block it meets first, or for all others that its `bound` leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                q = _matrix(part.column("v"))
                gaps = _gaps(q, blocks.pivots)
                # the nearest pivot's ring that the query lies in, or is nearest to
                off = np.maximum(np.maximum(gaps[:, blocks.pivot] - blocks.far, blocks.near - gaps[:, blocks.pivot]), 0)
                home = np.lexsort((off, gaps[:, blocks.pivot]), axis=1)[:, 0]
                if first:
                    row, at = np.arange(len(q)), home
                else:
                    wanted = blocks.least(q, gaps) <= np.array(part.column("bound").to_pylist(), np.float64)[:, None]
                    wanted[np.arange(len(q)), home] = False
                    row, at = np.nonzero(wanted)
                for some in range(0, len(row), 5000):
                    r = pa.array(row[some : some + 5000])
                    yield pa.RecordBatch.from_arrays([pa.array(at[some : some + 5000].astype(np.int32)), part.column("id").take(r), part.column("v").take(r)], names=["block", "id", "v"])

    return queries.mapInArrow(run, "block int, id long, v array<double>")


def met(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance: the k nearest of each block for each query that meets it. A task reads a block and then,
    sorted behind it, its queries."""
    left = vectors.withColumn("asks", F.lit(False))
    both = left.unionByName(asked.withColumn("asks", F.lit(True)))
    dealt = both.repartition(partitions(vectors.sparkSession) * 4, "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, v, norms = None, np.zeros(0, np.int64), None, None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block, asks = batch.column("block").to_numpy(zero_copy_only=False), batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (asks[1:] != asks[:-1]), [True]]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    if block[lo] != at:
                        at, held, v = block[lo], [], None
                    held.append(part)
                    continue
                if block[lo] != at:
                    continue
                if v is None:
                    ids = np.concatenate([h.column("id").to_numpy() for h in held])
                    v = np.concatenate([_matrix(h.column("v")) for h in held])
                    norms, held = (v * v).sum(axis=1), []
                for first in range(0, hi - lo, BATCH):
                    some = part.slice(first, BATCH)
                    found = nearest(_matrix(some.column("v")), some.column("id").to_pylist(), ids, v, norms, k)
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "distance"]
                        )

    return dealt.mapInArrow(run, "query_id long, id long, distance double")


def nearest(q: np.ndarray, names: list[int], ids: np.ndarray, v: np.ndarray, norms: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of a block for each query. Products find who may be among them; what counts is the plain distance."""
    own = (q * q).sum(axis=1)
    rough = own[:, None] + norms[None, :] - 2 * (q @ v.T)
    out = []
    cut = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
    for i, name in enumerate(names):
        near = np.flatnonzero(rough[i] <= cut[i] + SLACK * (own[i] + norms.max()) + SLACK)
        exact = np.sqrt(((v[near] - q[i]) ** 2).sum(axis=1))
        best: dict[int, float] = {}
        for d, x in zip(exact.tolist(), ids[near].tolist(), strict=True):
            best[x] = min(d, best.get(x, d))
        out += [(name, x, d) for d, x in heapq.nsmallest(k, ((d, x) for x, d in best.items()))]
    return out


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query out of those of its blocks; an id counts once."""
    once = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_join(queries: DataFrame, vectors: DataFrame, k: int = 3, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block: int | None = None) -> DataFrame:
    """query_id, rank, id, distance: the k nearest of `vectors` for each of `queries`."""
    spark = vectors.sparkSession
    asked, rows = durable(usable(queries, key, vector)), usable(vectors, key, vector)
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # `pivots` rows
    chosen = [r.v for r in chosen if len(r.v) == len(chosen[0].v)]
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance double")
    size = block or block_size(n)
    placed, blocks = blocks_of(rows, np.array(chosen), size)
    placed, asked = durable(placed), asked.where(F.size("v") == len(chosen[0]))
    first = durable(merged(met(placed, routed(asked, blocks, True), k), k))
    reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("bound"))
    bounded = asked.join(reached, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    rest = met(placed, routed(bounded, blocks, False), k)
    every = first.select("query_id", "id", "distance").unionByName(rest)
    return merged(every, k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance")
