"""Merkle manifest: a hash tree over the rows of each source, and one over the sources, with proofs.

Leaves are sorted by ranges of (source, doc_id). A source's rows before a partition, from the counts of
its partitions, give each leaf its place, so a task builds by itself all runs of FANOUT nodes whose
children it has, level upon level, holding one open run a level. What is left are the ragged runs
at the ends of partitions, at most two a level and partition. They are shuffled by their coordinate
(source, level, run), joined, and their digests rise to the next level until each source has one node.
The subroots are leaves of one more tree, built the same way. Proofs run down again: a run's proof is
that of its node, and each child's begins with the run's other children.

Only one row a partition is collected: its first and last source with their counts.

Defined cases: null fields are written `-`; a null source comes first and is a source of its own; null
doc_id sorts first and is never tampered with; of rows that repeat a doc_id the one with the smaller
leaf comes first, and rows that repeat entirely are leaves of their own; an empty text is `0:`; very
long texts are hashed whole; a source of one row is its own subroot; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.llm.common import durable, partitions, read

FANOUT = 16
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of an Arrow batch that a task gives out.
OUT_ROWS = 2_000

_PAYLOAD = pa.struct([("name", pa.string()), ("doc_id", pa.int64()), ("changed", pa.binary())])
_RUN = pa.schema(
    [
        ("g", pa.string()),
        ("level", pa.int32()),
        ("run", pa.int64()),
        ("start", pa.int64()),
        ("hashes", pa.binary()),
        ("carried", pa.list_(_PAYLOAD)),
        ("digest", pa.binary()),
        ("top", pa.bool_()),
    ]
)
_RUN_DDL = (
    "g string, level int, run long, start long, hashes binary, "
    "carried array<struct<name: string, doc_id: long, changed: binary>>, digest binary, top boolean"
)


def field(value: Column) -> Column:
    """UTF-8 byte count, `:` and the value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    return F.unhex(F.sha2(F.concat(*[field((changed or {}).get(c, F.col(c))) for c in fields]), 256))


def group_key(source: Column) -> Column:
    """Sorts as the sources do, bytewise and null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """g, h, payload: each row's source, leaf, and what a proof gives back. `changed` is the leaf of the row as
    tampered with, null where it is not."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = F.when(tampered(F.col("doc_id")), leaf_digest({"text": lower}))
    payload = F.struct(F.lit(None).cast("string").alias("name"), F.col("doc_id").cast("long").alias("doc_id"), other.alias("changed"))
    return docs.select(group_key(F.col("source").cast("string")).alias("g"), leaf_digest().alias("h"), payload.alias("payload"))


def placed(rows: DataFrame) -> DataFrame:
    """`rows` sorted by ranges of (g, name, doc_id, h), with the number of their partition. Rows that are equal in
    all of these are told apart by where they come from, so that a frequent one is spread over ranges."""
    order = ["g", "name", "doc_id", "h", "nth"]
    keyed = rows.withColumns({"name": F.col("payload.name"), "doc_id": F.col("payload.doc_id"), "nth": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return durable(ranged.select("g", "h", "payload", F.spark_partition_id().alias("part")))


def boundaries(rows: DataFrame) -> tuple[dict[int, int], dict[int, int], int]:
    """For each partition, how many rows of its first source lie before it, and the total of its last source where
    that goes on behind it; and the largest total of all. One row a partition is collected."""
    counts = rows.groupBy("part", "g").agg(F.count("*").alias("n"))
    ends = counts.groupBy("part").agg(F.min(F.struct("g", "n")).alias("first"), F.max(F.struct("g", "n")).alias("last"), F.max("n").alias("most"))
    ends = sorted(ends.collect(), key=lambda r: r.part)
    before, after, totals = {}, {}, [r.most for r in ends]
    name, n, holders = None, 0, []  # a source, its rows so far, and the partitions that hold them

    def ended() -> None:
        after.update(dict.fromkeys(holders[:-1], n))
        totals.append(n)

    for r in ends:
        goes_on = r.first.g == name
        before[r.part] = n if goes_on else 0
        if goes_on:
            n += r.first.n
            holders.append(r.part)
        else:
            ended()
            name, n, holders = r.first.g, r.first.n, [r.part]
        if r.last.g != name:
            ended()
            name, n, holders = r.last.g, r.last.n, [r.part]
    ended()
    return before, after, max(totals)


def levels(total: int, fanout: int = FANOUT) -> int:
    """Levels of runs over so many leaves; a lone leaf is held by one run that has no digest of its own."""
    n = 1
    while total > fanout:
        total, n = -(-total // fanout), n + 1
    return n


def hash_text(children: bytes) -> bytes:
    """The digest of a run, whose children's digests are hashed as lowercase hex."""
    return hashlib.sha256(children.hex().encode()).digest()


class Builder:
    """Builds the runs of one source from its leaves in order, holding one open run a level. A run is closed when
    the node after it comes, or at the end."""

    def __init__(self, g: str, before: int, fanout: int) -> None:
        self.g, self.fanout, self.at = g, fanout, before
        self.open: list[tuple[int, list, list]] = []  # a level: first index, digests, payloads

    def add(self, digest: bytes, payload: dict) -> Iterator[tuple]:
        yield from self._push(0, self.at, digest, [payload])
        self.at += 1

    def _push(self, level: int, index: int, digest: bytes, payload: list) -> Iterator[tuple]:
        if level == len(self.open):
            self.open.append((index, [], []))
        elif index % self.fanout == 0:
            yield from self._close(level, None)
            self.open[level] = (index, [], [])
        _, digests, payloads = self.open[level]
        digests.append(digest)
        payloads += payload

    def _close(self, level: int, last: int | None) -> Iterator[tuple]:
        """Give out the open run of a level: with its digest if all its children are here, else as a piece. `last` is
        the number of nodes of this level if the source ends with the run."""
        first, digests, payloads = self.open[level]
        run, hashes = first // self.fanout, b"".join(digests)
        if first % self.fanout or (len(digests) < self.fanout and last is None):
            yield self.g, level, run, first, hashes, payloads, None, False
        elif last is not None and last <= self.fanout:  # all nodes of the level
            yield self.g, level, run, first, hashes, payloads, hashes if last == 1 else hash_text(hashes), True
        else:
            digest = hash_text(hashes)
            yield self.g, level, run, first, hashes, payloads, digest, False
            yield from self._push(level + 1, run, digest, [])

    def end(self, goes_on: bool) -> Iterator[tuple]:
        """Close what is open, from the leaves up. `goes_on`: the source has rows behind this partition."""
        n, level = self.at, 0
        while level < len(self.open):
            yield from self._close(level, None if goes_on else n)
            n, level = -(-n // self.fanout), level + 1


def local_runs(rows: DataFrame, before: dict[int, int], after: dict[int, int], fanout: int = FANOUT) -> DataFrame:
    """Runs built where their leaves lie; those without a digest are pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: Builder | None = None
        part = -1

        def given() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RUN.types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_RUN)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "g", "h", "payload"))
            for part, g, h, payload in zip(*columns, strict=True):
                if now is None:  # the partition's first source may have begun before it
                    now = Builder(g, before[part], fanout)
                elif g != now.g:
                    out.extend(now.end(goes_on=False))
                    now = Builder(g, 0, fanout)
                out.extend(now.add(h, payload))
                if len(out) >= OUT_ROWS:
                    yield given()
        if now is not None:
            out.extend(now.end(goes_on=part in after))
        if out:
            yield given()

    return rows.mapInArrow(run, _RUN_DDL)


def forest(rows: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """All runs of the trees over `rows` (g, h, payload), and the number of levels of the highest."""
    sorted_rows = placed(rows)
    before, after, largest = boundaries(sorted_rows)
    high = levels(largest, fanout)
    built = durable(local_runs(sorted_rows, before, after, fanout))
    columns = ["g", "level", "run", "hashes", "carried", "digest", "top"]
    out = built.where(F.col("digest").isNotNull()).select(*columns)
    if not after:  # no source crosses the end of a partition
        return out, high
    pieces = built.where(F.col("digest").isNull()).select("g", "level", "run", "start", "hashes", "carried")
    spans = F.broadcast(spanning(sorted_rows))  # fewer rows than partitions
    none = F.array().cast(pieces.schema["carried"].dataType)
    rising: DataFrame | None = None  # nodes of the level, from pieces below
    for level in range(high):
        here = pieces.where(F.col("level") == level).drop("level")
        here = here if rising is None else here.unionByName(rising)
        joined = here.groupBy("g", "run").agg(F.sort_array(F.collect_list(F.struct("start", "hashes", "carried"))).alias("parts"))
        nodes = F.ceil(F.col("total") / F.lit(fanout ** (level + 1)))  # of the level above
        merged = joined.join(spans, "g").select(
            "g",
            F.lit(level).alias("level"),
            "run",
            F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["hashes"])).alias("hashes"),
            F.flatten(F.col("parts.carried")).alias("carried"),
            (nodes == 1).alias("top"),
        )
        merged = durable(merged.withColumn("digest", F.unhex(F.sha2(F.lower(F.hex("hashes")), 256))).select(*columns))
        out = out.unionByName(merged)
        rising = merged.where(~F.col("top")).select(
            "g", F.floor(F.col("run") / fanout).alias("run"), F.col("run").alias("start"), F.col("digest").alias("hashes"), none.alias("carried")
        )
    return out, high


def spanning(rows: DataFrame) -> DataFrame:
    """g, total of the sources that lie in several partitions: fewer of them than partitions."""
    counts = rows.groupBy("g", "part").agg(F.count("*").alias("n"))
    return durable(counts.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))


def children(runs: DataFrame, fanout: int) -> DataFrame:
    """The children of runs with their paths: a step is the place within the run and the other children's digests."""
    n = F.floor(F.octet_length("hashes") / 32).cast("int")
    at = F.posexplode(F.sequence(F.lit(0), n - 1))
    one = runs.select("*", at.alias("pos", "__p")).drop("__p")
    # substring of binary: Spark's positions begin at 1
    left = F.expr("substring(hashes, 1, pos * 32)")
    right = F.expr("substring(hashes, pos * 32 + 33)")
    step = F.struct(F.col("pos").cast("int").alias("pos"), F.concat(left, right).alias("others"))
    lone = F.col("top") & (F.col("level") == 0) & (n == 1)  # is its own subroot
    return one.select(
        "g",
        "subroot",
        (F.col("run") * fanout + F.col("pos")).alias("index"),
        F.expr("substring(hashes, pos * 32 + 1, 32)").alias("h"),
        F.when(lone, F.col("path")).otherwise(F.concat(F.array(step), F.col("path"))).alias("path"),
        F.expr("get(carried, pos)").alias("payload"),
    )


def paths(runs: DataFrame, high: int, above: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """g, subroot, h, path, payload of each leaf. `above` has the path of each g's subroot in the tree over it."""
    none = F.array().cast("array<struct<pos: int, others: binary>>")
    down: DataFrame | None = None
    for level in reversed(range(high)):
        here = runs.where(F.col("level") == level)
        tops = here.where("top").withColumn("subroot", F.col("digest"))
        tops = tops.withColumn("path", none) if above is None else tops.join(above, "g")
        at = tops.select("g", "level", "run", "hashes", "carried", "top", "subroot", "path")
        if down is not None:
            upper = down.select("g", F.col("index").alias("run"), "subroot", "path")
            at = at.unionByName(here.where(~F.col("top")).drop("digest").join(upper, ["g", "run"]).select(*at.columns))
        down = children(at, fanout)
    return down


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root (as hex), the steps of the proof from the leaf to the root, and `changed`, the leaf
    of a tampered row."""
    runs, high = forest(leaves(docs), fanout)
    runs = durable(runs)
    payload = F.struct(F.col("g").alias("name"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed"))
    subroots = durable(runs.where("top").select(F.lit("").alias("g"), F.col("digest").alias("h"), payload.alias("payload")))
    upper, upper_high = forest(subroots, fanout)
    upper = durable(upper)
    root = upper.where("top").select(F.lower(F.hex("digest")).alias("root")).first()
    sources = durable(paths(upper, upper_high, None, fanout).select(F.col("payload.name").alias("g"), "path"))
    found = paths(runs, high, sources, fanout)
    return found.select(
        F.col("payload.doc_id").alias("doc_id"),
        F.lower(F.hex("h")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        F.lit(root.root if root else None).cast("string").alias("root"),
        "path",
        F.lower(F.hex("payload.changed")).alias("changed"),
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give, both as hex."""

    def up(node: Column, step: Column) -> Column:
        others, at = F.lower(F.hex(step["others"])), step["pos"] * 64
        return F.sha2(F.concat(F.substr(others, F.lit(1), at), node, F.substr(others, at + 1)), 256)

    return F.aggregate(path, leaf, up)


def proofs(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest's digests, a digest of each proof, and what it gives for the row as tampered with."""
    rows = manifest(docs, fanout)
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.lower(F.hex(x["others"]))), ""), 256)
    folded = rows.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(read(spark, sf_dir, "documents"))


def _sql(high: int = 7) -> str:
    """One level after the other, written out; `high` of them hold 16 ** high leaves."""

    def tree(name: str, leaf_rows: str) -> str:
        out = [f"{name}0 AS ({leaf_rows})"]
        for k in range(high):
            out.append(
                f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, "
                f"any_value((n + 15) // 16) AS n FROM {name}{k} GROUP BY g, i // 16)"
            )
            out.append(
                f"{name}s{k} AS (SELECT g, i, n, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r "
                f"FROM {name}{k} WINDOW run AS (PARTITION BY g, i // 16 ORDER BY i))"
            )
        return ",\n".join(out)

    steps = [(f"as{k}", "d.g", "d.i", k) for k in range(high)] + [(f"bs{k}", "''", "b0.i", k) for k in range(high)]
    join = [f"JOIN {s} ON {s}.g = {g} AND {s}.i = {i} // {16**k}" for s, g, i, k in steps]
    join.insert(high, f"JOIN a{high} ON a{high}.g = d.g JOIN b0 ON b0.name = d.g")
    folds = "SELECT *, used AS x0 FROM j"
    for k, (s, *_) in enumerate(steps):
        folds = f"SELECT *, CASE WHEN {s}_n = 1 THEN x{k} ELSE sha256({s}_l || x{k} || {s}_r) END AS x{k + 1} FROM ({folds})"
    carried = ", ".join(f"{s}.n AS {s}_n, {s}.l AS {s}_l, {s}.r AS {s}_r" for s, *_ in steps)
    proof = " || ".join(f"{s}.l || {s}.r" for s, *_ in steps)
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda *cs: "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in cs) + ")"
    return f"""
WITH RECURSIVE t(i, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM t WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
u AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {leaf(*FIELDS)} AS leaf, {leaf(*FIELDS[:-1], lower)} AS other,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda s, b: xor(tab[(xor(s, b) & 255) + 1], s >> 8))) AS c
  FROM documents, crc
), d AS (
  SELECT doc_id, g, leaf, CASE WHEN c % 5 = 0 THEN other ELSE leaf END AS used, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY g) AS n
  FROM u
), {tree("a", "SELECT g, i, leaf AS h, n FROM d")},
{tree("b", f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS name FROM a{high}")},
j AS (
  SELECT d.doc_id, d.leaf, d.used, a{high}.h AS subroot, b{high}.h AS root, {carried}, sha256({proof}) AS proof_sha256
  FROM d {" ".join(join)} CROSS JOIN b{high}
), f AS ({folds})
SELECT doc_id, leaf, subroot, root, proof_sha256, x{2 * high} AS folded_root, x{2 * high} = root AS verified FROM f
"""


SQL = _sql()
