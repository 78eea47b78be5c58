"""Queues of messages that are consumed once: pushed in segments, claimed by position, read in batches or as a stream.

A push writes its messages as one segment of files and then commits their names and row counts to the queue's log,
so a message's place is fixed and a push that fails leaves nothing behind that anyone sees. A consumer owns a log
of its own: taking n messages commits the range of places taken, and a range is committed once, also by
consumers of one name in several programs; so what is popped is not popped again after a restart. `peek` and
`length` take nothing. As a stream, places are the offsets, and Spark's checkpoint says how far it has come; a
stream that writes commits each of its batches once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from labelaudit.operators.joins import partitions
from labelaudit.sources.commits import CommitLog

SCHEMA = "place long, value string"


def push(jobs: DataFrame, path: str, order: str | None = None, once: str | None = None) -> int:
    """Append a JSON line for each row, in the order of a column if one is named; the number of the commit.

    `once` names the push: one of that name that is committed already is not made again."""
    spark, log = jobs.sparkSession, CommitLog(jobs.sparkSession, path)
    seen = -1

    def made() -> int | None:
        nonlocal seen
        for version, entry in log.since(seen):
            seen = version
            if once is not None and entry.get("once") == once:
                return version
        return None

    if (before := made()) is not None:
        return before
    folder = f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    dealt = jobs.repartitionByRange(partitions(spark), order).sortWithinPartitions(order) if order else jobs
    dealt.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in jobs.columns])).alias("value")).write.parquet(folder)
    counts = spark.read.schema("value string").parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()  # a row a file
    files = [[f"{folder}/{r.name}", r.n] for r in sorted(counts, key=lambda r: r.name)]
    while True:
        last, state = log.last()
        entry = {"files": files, "start": state.get("start", 0) + state.get("rows", 0), "rows": sum(n for _, n in files), "once": once}
        if log.put(last + 1, entry):
            return last + 1
        if (other := made()) is not None:
            return other


def pushed_total(log: CommitLog) -> int:
    """Messages ever pushed."""
    state = log.last()[1]
    return state.get("start", 0) + state.get("rows", 0)


def taken_total(spark: SparkSession, path: str, consumer: str) -> int:
    return CommitLog(spark, f"{path.rstrip('/')}/consumers/{consumer}").last()[1].get("to", 0)


def length(spark: SparkSession, path: str, consumer: str = "main") -> int:
    """Messages that a consumer has not taken yet."""
    return pushed_total(CommitLog(spark, path)) - taken_total(spark, path, consumer)


def _slices(entries: Iterator[dict], low: int, high: int) -> Iterator[tuple[str, int, int, int]]:
    """file, place of its first message, and which of its rows lie in low .. high."""
    for entry in entries:
        at = entry["start"]
        for name, n in entry["files"]:
            if at < high and at + n > low:
                yield name, at, max(0, low - at), min(n, high - at)
            at += n


def messages(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """place, value of the messages from `low` up to, and without, `high`."""
    found = list(_slices((e for _, e in CommitLog(spark, path).since(-1)), low, high))
    if not found:
        return spark.createDataFrame([], SCHEMA)
    base = spark.createDataFrame([(name.rsplit("/", 2)[-2] + "/" + name.rsplit("/", 1)[-1], at) for name, at, _, _ in found], "name string, base long")
    rows = spark.read.schema("value string").parquet(*[name for name, *_ in found])
    named = rows.select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = named.withColumn("name", F.concat_ws("/", "folder", "file")).join(F.broadcast(base), "name")  # a row a file
    return placed.select((F.col("base") + F.col("row")).alias("place"), "value").where(F.col("place").between(low, high - 1))


def peek(spark: SparkSession, path: str, n: int = 10, consumer: str = "main") -> DataFrame:
    low = taken_total(spark, path, consumer)
    return messages(spark, path, low, low + n)


def pop(spark: SparkSession, path: str, n: int = 1, consumer: str = "main") -> DataFrame:
    """The next `n` messages, fewer if there are not as many; they are this caller's alone."""
    log, claims = CommitLog(spark, path), CommitLog(spark, f"{path.rstrip('/')}/consumers/{consumer}")
    while True:
        version, state = claims.last()
        low = state.get("to", 0)
        high = min(low + n, pushed_total(log))
        if high <= low:
            return spark.createDataFrame([], SCHEMA)
        if claims.put(version + 1, {"from": low, "to": high}):
            return messages(spark, path, low, high)


class Slice(InputPartition):
    def __init__(self, name: str, base: int, first: int, last: int) -> None:
        super().__init__((name, base, first, last))
        self.name, self.base, self.first, self.last = name, base, first, last


def _entries(path: str) -> list[dict]:
    """The log's commits in order, read without a session, as data sources are."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = system.get_file_info(fs.FileSelector(f"{place}/log", allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    out = []
    for name in names:
        with system.open_input_stream(name) as stream:
            out.append(json.loads(stream.read()))
    return out


def _read_slice(s: Slice) -> Iterator[tuple[int, str]]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(s.name) if "://" in s.name or s.name.startswith("file:") else (fs.LocalFileSystem(), s.name)
    with system.open_input_file(place) as source:
        at = 0
        for batch in pq.ParquetFile(source).iter_batches(4096, columns=["value"]):
            for value in batch.column(0).to_pylist():
                if s.first <= at < s.last:
                    yield s.base + at, value
                at += 1


class QueueStream(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"place": 0}

    def latestOffset(self) -> dict:
        entries = _entries(self.path)
        return {"place": entries[-1]["start"] + entries[-1]["rows"] if entries else 0}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(*x) for x in _slices(iter(_entries(self.path)), start["place"], end["place"])]

    def read(self, partition: Slice) -> Iterator[tuple[int, str]]:
        return _read_slice(partition)


class QueueReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Slice]:
        return [Slice(*x) for x in _slices(iter(_entries(self.path)), 0, 1 << 62)] or [Slice("", 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple[int, str]]:
        return _read_slice(partition) if partition.name else iter(())


class QueueSource(DataSource):
    """`spark.read.format("labelqueue").load(path)`, and the same with readStream: place, value of each message."""

    @classmethod
    def name(cls) -> str:
        return "labelqueue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> QueueReader:
        return QueueReader(self.options["path"])

    def streamReader(self, schema) -> QueueStream:
        return QueueStream(self.options["path"])


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The queue's messages as a stream, from its beginning or from where a checkpoint has stopped."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("labelqueue").load(path)


def push_batches(path: str, name: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch of the stream of that name is pushed once, also if it runs twice."""
    return lambda batch, number: push(batch, path, order, f"{name}:{number}") and None
