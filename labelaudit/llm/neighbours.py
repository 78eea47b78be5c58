"""Approximate nearest neighbours: robust-pruned directed graphs, one for each shard of vectors.

Equal vectors are combined first, locally and then by their digest: of each distinct vector only the
smallest k + 1 ids can be among the k nearest of any query. Distinct vectors are dealt by digest into
shards of about SHARD, whose number grows with the rows. In a shard, greedy searches propose
neighbours for each vector, relaxed distance pruning keeps diverse edges (a candidate goes if a kept
neighbour is nearer to it by the factor ALPHA), reverse edges are pruned the same way, and a second
round of searches improves the first. A graph is one bounded row.

Queries travel in blocks to every shard; a beam search finds the shard's best, which are scored in
double precision on the original vectors; a query's results from all shards are then ranked.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do null ids; vectors of different lengths never meet; rows that repeat an id and vector count
once; of rows that repeat an id with other vectors the smallest vector, component by component,
counts, as a query and as a candidate; ties go to the smaller id; with fewer candidates than k all
are given; an empty table gives no rows; other columns are ignored. The graphs hold every row; nothing
is fitted on a sample.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelaudit.llm.common import bounded, durable, partitions, read

SHARD = 4096
DEGREE = 32
BEAM = 64
ALPHA = 1.2
BLOCK = 256
K = 5

_SCHEMA_DISTINCT = "digest long, dim int, vector binary, ids array<long>"
_ARROW_DISTINCT = pa.schema([("digest", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary()), ("ids", pa.list_(pa.int64()))])


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: the rows that take part, as doubles."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False)))


def _kept(ids: set[int], most: int) -> list[int]:
    return heapq.nsmallest(most, ids)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """digest, dim, vector, ids: each distinct vector with the `most` smallest ids that have it."""

    def rows_of(found: dict[bytes, set[int]]) -> Iterator[pa.RecordBatch]:
        items = list(found.items())
        for lo in range(0, len(items), 5000):
            part = [(int(np.frombuffer(np.uint64(_digest(v)).tobytes(), np.int64)[0]), len(v) // 8, v, _kept(ids, most)) for v, ids in items[lo : lo + 5000]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _ARROW_DISTINCT.types, strict=True)], schema=_ARROW_DISTINCT)

    def add(found: dict[bytes, set[int]], vector: bytes, ids: list[int]) -> None:
        mine = found.setdefault(vector, set())
        mine.update(ids)
        if len(mine) > 4 * most:
            found[vector] = set(_kept(mine, most))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, set[int]] = {}
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                add(found, (np.array(v, "<f8") + 0.0).tobytes(), [vec_id])
            yield from rows_of(found)

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, set[int]] = {}
        last = None
        for batch in batches:
            for digest, vector, ids in zip(*(batch.column(c).to_pylist() for c in ("digest", "vector", "ids")), strict=True):
                if digest != last and len(found) >= 5000:  # sorted, so what is held is complete
                    yield from rows_of(found)
                    found = {}
                last = digest
                add(found, vector, ids)
        yield from rows_of(found)

    once = rows.mapInArrow(local, _SCHEMA_DISTINCT)
    dealt = once.repartition(partitions(rows.sparkSession), "digest").sortWithinPartitions("digest")
    return dealt.mapInArrow(combined, _SCHEMA_DISTINCT)


def _digest(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


class Graph:
    """Directed graph over unit vectors; -1 fills rows of fewer than `degree` edges."""

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 11) -> None:
        self.unit, self.degree, n = unit, degree, len(unit)
        self.entry = int(np.argmax(unit @ unit.mean(axis=0))) if n else 0
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, degree), -1, np.int32)
        start = min(degree, n - 1)
        if start > 0:
            drawn = np.sort((np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, start))) % n, axis=1)
            drawn[:, 1:][drawn[:, 1:] == drawn[:, :-1]] = -1  # drawn twice
            self.edges[:, :start] = drawn
        for a in (1.0, alpha):
            order = rng.permutation(n)
            for lo in range(0, n, BLOCK):
                block = order[lo : lo + BLOCK]
                near = self.search(unit[block], beam)
                incoming: dict[int, list[int]] = {}
                for i, found in zip(block.tolist(), near, strict=True):
                    self._prune(i, np.concatenate([found, self.edges[i]]), a)
                    for j in self.edges[i][self.edges[i] >= 0].tolist():
                        incoming.setdefault(j, []).append(i)
                for j, new in incoming.items():
                    have = self.edges[j][self.edges[j] >= 0]
                    both = np.unique(np.concatenate([have, np.array(new, np.int32)]))
                    if len(both) <= degree:
                        self.edges[j, : len(both)] = both
                    else:
                        self._prune(j, both, a)

    def _prune(self, i: int, found: np.ndarray, alpha: float) -> None:
        found = np.unique(found[(found >= 0) & (found != i)])
        gap = 1 - self.unit[found] @ self.unit[i]
        found = found[np.argsort(gap, kind="stable")][: 3 * self.degree]
        vectors = self.unit[found]
        gap, among = 1 - vectors @ self.unit[i], 1 - vectors @ vectors.T
        alive = np.ones(len(found), bool)
        kept = []
        for k in range(len(found)):
            if alive[k]:
                kept.append(k)
                if len(kept) == self.degree:
                    break
                alive &= alpha * among[k] > gap
        self.edges[i] = -1
        self.edges[i, : len(kept)] = found[kept]

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """The `beam` nearest found for each query, nearest first, -1 where there are fewer."""
        n, m = len(self.unit), len(queries)
        ids = np.full((m, beam), -1, np.int32)
        near = np.full((m, beam), -np.inf)
        open_ = np.zeros((m, beam), bool)
        ids[:, 0], near[:, 0], open_[:, 0] = self.entry, queries @ self.unit[self.entry], True
        seen = np.zeros((m, n), bool)
        seen[:, self.entry] = True
        active = np.arange(m)
        while len(active):
            pick = np.where(open_[active], near[active], -np.inf).argmax(axis=1)
            open_[active, pick] = False
            next_ = self.edges[ids[active, pick]]
            valid = next_ >= 0
            safe = np.where(valid, next_, 0)
            valid &= ~seen[active[:, None], safe]
            row, column = np.nonzero(valid)
            seen[active[row], safe[row, column]] = True
            score = np.where(valid, np.einsum("qd,qrd->qr", queries[active], self.unit[safe]), -np.inf)
            all_near = np.concatenate([near[active], score], axis=1)
            top = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            near[active] = np.take_along_axis(all_near, top, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(valid, next_, -1)], axis=1), top, 1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], valid], axis=1), top, 1)
            active = active[open_[active].any(axis=1)]
        return np.where(np.isfinite(near), ids, -1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, in double precision. Scaling by powers of two changes no digit and keeps
    the squares of very large and very small components within range."""
    a, b = scaled(a[None])[0], scaled(b)
    return (b @ a) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum()))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest component lies between 1/2 and 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


_GRAPH = "shard long, dim int, vectors binary, edges binary, entry int, ids array<array<long>>"
_GRAPH_ARROW = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("vectors", pa.binary()), ("edges", pa.binary()), ("entry", pa.int32()), ("ids", pa.list_(pa.list_(pa.int64())))])


def build(rows: DataFrame, k: int = K, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """One row per shard: its vectors, edges, entry and ids."""
    spark = rows.sparkSession
    distinct = durable(distinct_vectors(rows, k + 1))
    shards = max(1, -(-distinct.count() // shard))

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of_shards() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("shard", "dim", "vector", "ids")), strict=True)

        for (s, dim), rows in groupby(rows_of_shards(), key=lambda r: r[:2]):  # sorted, so one shard is held at a time
            items = sorted(r[2:] for r in rows)
            v = np.frombuffer(b"".join(x for x, _ in items), "<f8").reshape(-1, dim)
            g = Graph(unit_rows(v), degree, beam, alpha)
            row = {"shard": s, "dim": dim, "vectors": v.tobytes(), "edges": g.edges.tobytes(), "entry": g.entry, "ids": [i for _, i in items]}
            yield pa.RecordBatch.from_pylist([row], schema=_GRAPH_ARROW)

    dealt = distinct.withColumn("shard", F.pmod("digest", F.lit(shards)))
    # by ranges: hashes would put several shards into one task and none into others
    spread = dealt.repartitionByRange(min(shards, 16 * partitions(spark)), "shard").sortWithinPartitions("shard", "dim")
    return durable(spread.mapInArrow(graphs, _GRAPH))


def search(graphs: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, degree: int = DEGREE) -> DataFrame:
    """query_id, rank, vec_id, score for `queries` (vec_id, v) against all shards; a query is no candidate of its own.

    A task reads a shard's graph and then, sorted behind it, the queries, BLOCK at a time.
    """
    spark = queries.sparkSession
    shards = graphs.agg(F.max("shard")).first()[0]
    none = {"vectors": "binary", "edges": "binary", "entry": "int", "ids": "array<array<long>>"}
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards or 0).cast("long"))).alias("shard"), F.size("v").alias("dim"), "vec_id", "v")
    left = graphs.withColumns({"vec_id": F.lit(None).cast("long"), "v": F.lit(None).cast("array<double>")})
    right = asked.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    met = left.unionByName(right).repartition(partitions(spark), "shard", "dim").sortWithinPartitions("shard", "dim", F.col("vectors").isNull())

    def beams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, g, v, ids = None, None, None, None
        for batch in batches:
            rows = batch.to_pylist()
            lo = 0
            while lo < len(rows):
                r = rows[lo]
                if r["vectors"] is not None:
                    at, v, ids = (r["shard"], r["dim"]), np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dim"]), r["ids"]
                    g = Graph.__new__(Graph)
                    g.unit, g.entry, g.edges = unit_rows(v), r["entry"], np.frombuffer(r["edges"], np.int32).reshape(len(v), degree)
                    lo += 1
                    continue
                hi = lo
                while hi < len(rows) and hi < lo + BLOCK and rows[hi]["vectors"] is None and (rows[hi]["shard"], rows[hi]["dim"]) == (r["shard"], r["dim"]):
                    hi += 1
                block, lo = rows[lo:hi], hi
                if (r["shard"], r["dim"]) != at:  # no vector of this length in the shard
                    continue
                q = np.array([x["v"] for x in block], np.float64)
                out = []
                for x, vector, found in zip(block, q, g.search(unit_rows(q), beam), strict=True):
                    found = found[found >= 0]
                    score = cosine(vector, v[found])
                    some = [(-s, i) for s, f in zip(score.tolist(), found.tolist(), strict=True) for i in ids[f] if i != x["vec_id"]]
                    out += [(x["vec_id"], i, -s) for s, i in heapq.nsmallest(k, some)]
                if out:
                    columns = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(beams, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def one_each(rows: DataFrame) -> DataFrame:
    """`rows` with one vector an id. Only ids and digests are dealt, and the rows of ids that have several vectors."""
    digest = F.xxhash64("v")
    several = durable(rows.groupBy("vec_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low != high").select("vec_id"))
    if not several.limit(1).count():
        return rows
    several = bounded(several)
    least = rows.join(several, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.join(several, "vec_id", "left_anti").unionByName(least)


def nearest(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Both sides as `usable` gives them, one vector an id."""
    return search(build(rows, k), queries.dropDuplicates(["vec_id"]), k)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_each(usable(read(spark, sf_dir, "embeddings")))
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
