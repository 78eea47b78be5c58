"""Rate limits over anchored windows, where one client may have any share of the hits.

A client's window opens at its first hit and closes after some seconds; the first hit after that opens the next. So
where a window opens depends on all hits before it. Hits are sorted by ranges of (key, time), and a client with
many hits lies in many pieces. A piece that one client fills is a function from the window that is open before it
to the one that is open behind it: for each of its first hits that may open a window, pointers to the next opener
are doubled until they leave the piece. Functions of neighbouring pieces are composed, doubling the distance with
each round, until every piece knows the window it begins in; then each is marked by itself.

Collected are one row a piece: its first and last client, and the window it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelaudit.operators.joins import durable, partitions

_STEPS = "part int, prev int, known boolean, open boolean, breaks array<long>, opened array<long>, place array<long>"


def openers(ts: np.ndarray, window: int) -> np.ndarray:
    """For each hit, the last opener in the piece if a window opens at it: next-opener pointers, doubled until they end."""
    n = len(ts)
    after = np.searchsorted(ts, ts + window)
    at = np.where(after < n, after, np.arange(n))
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def through(opened: np.ndarray, place: np.ndarray, breaks: np.ndarray, to_opened: np.ndarray, to_place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (when opened, at which hit of the client) behind a piece, for those before it. One that no hit of the piece
    is late enough to close stays open."""
    at = np.searchsorted(breaks, opened + window)
    inside = at < len(breaks)
    safe = np.minimum(at, max(0, len(breaks) - 1))
    if not len(breaks):
        return opened, place
    return np.where(inside, to_opened[safe], opened), np.where(inside, to_place[safe], place)


class Marks:
    """Folds a client's hits in order: the window that is open, and how many hits it has."""

    def __init__(self, key, opened: int | None, place: int, at: int, window: int) -> None:
        self.key, self.opened, self.place, self.at, self.window = key, opened, place, at, window

    def used(self, ts: np.ndarray) -> np.ndarray:
        """For each hit its number within its window."""
        n, opener = len(ts), np.zeros(len(ts), np.int64)
        j = 0 if self.opened is None else int(np.searchsorted(ts, self.opened + self.window))
        opener[:j] = self.place
        while j < n:
            self.opened, self.place = int(ts[j]), self.at + j
            end = int(np.searchsorted(ts, self.opened + self.window))
            opener[j:end] = self.place
            j = end
        out = self.at + np.arange(n) - opener + 1
        self.at += n
        return out


def runs(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, int, int]]:
    """key, times in microseconds, and the ends of each run of one key."""
    keys = batch.column("key").to_pylist()
    ts = batch.column("ts").cast(pa.timestamp("us", batch.column("ts").type.tz)).cast(pa.int64()).to_numpy()
    lo = 0
    for hi in range(1, len(keys) + 1):
        if hi == len(keys) or keys[hi] != keys[lo]:
            yield keys[lo], ts[lo:hi], lo, hi
            lo = hi


def _ends(placed: DataFrame) -> list[dict]:
    """A row a piece, in order: its first and last key, whether the first began before it, how many of its hits lie
    before it, and whether one key fills the piece."""
    counts = placed.groupBy("part", "key").agg(F.count("*").alias("n"))
    ends = counts.groupBy("part").agg(F.min(F.struct("key", "n")).alias("low"), F.max(F.struct("key", "n")).alias("high"), F.count("*").alias("keys"))
    out, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r.part):
        continues = before is not None and before["key"] == r.low.key
        offset = before["upto"] if continues else 0
        row = {"part": r.part, "continues": continues, "offset": offset, "alone": r["keys"] == 1, "prev": before["part"] if before else -1}
        out.append(row | {"key": r.high.key, "upto": (offset if r["keys"] == 1 else 0) + r.high.n})
        before = out[-1]
    return out


def _functions(placed: DataFrame, ends: dict[int, dict], window: int) -> DataFrame:
    """A row a piece: the window behind it where that is known, else how it follows from the window before it. `open`:
    a window may pass the whole piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mark, whole = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column("part")[0].as_py()
            if ends[part]["alone"] and ends[part]["continues"]:
                whole += [ts for _, ts, _, _ in runs(batch)]
                continue
            for key, ts, _, _ in runs(batch):
                if mark is None or key != mark.key:
                    mark = Marks(key, None, 0, 0, window)
                mark.used(ts)
        if part is None:
            return
        if whole:
            ts = np.concatenate(whole)
            last = openers(ts, window)
            # a window that is open before the piece closes within a window's length of its first hit
            m = min(len(ts) - 1, int(np.searchsorted(ts, ts[0] + window)))
            row = {"known": False, "open": bool(ts[-1] < ts[0] + window), "breaks": ts[: m + 1].tolist(), "opened": ts[last[: m + 1]].tolist()}
            row["place"] = (last[: m + 1] + ends[part]["offset"]).tolist()
        else:
            row = {"known": True, "open": False, "breaks": [], "opened": [mark.opened], "place": [mark.place]}
        yield _step_rows([row | {"part": part, "prev": ends[part]["prev"]}])

    return placed.mapInArrow(run, _STEPS)


def _step_rows(rows: list[dict]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    types = {"part": pa.int32(), "prev": pa.int32(), "known": pa.bool_(), "open": pa.bool_(), "breaks": longs, "opened": longs, "place": longs}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], names=list(types))


def composed(first: dict, then: dict, window: int) -> dict:
    """What `first` and, behind it, `then` do to the window before both."""
    b, o, p = (np.array(then[c], np.int64) for c in ("breaks", "opened", "place"))
    opened, place = through(np.array(first["opened"], np.int64), np.array(first["place"], np.int64), b, o, p, window)
    out = {"part": then["part"], "prev": first["prev"], "known": first["known"], "open": first["open"] and then["open"]}
    if not first["open"]:
        return out | {"breaks": first["breaks"], "opened": opened.tolist(), "place": place.tolist()}
    # windows that pass the first piece meet the second as they were, if still open a window's length after the start
    more = int(np.searchsorted(b, first["breaks"][0] + window, side="right")) + 1
    out["open"] = out["open"] and b[-1] < first["breaks"][0] + window
    return out | {"breaks": first["breaks"] + b[:more].tolist(), "opened": opened.tolist() + o[:more].tolist(), "place": place.tolist() + p[:more].tolist()}


def _resolved(steps: DataFrame, window: int) -> DataFrame:
    """The steps with all windows known, by composing each with the one before it, twice as far in each round."""
    steps = durable(steps)
    columns = steps.columns
    while steps.where(~F.col("known")).limit(1).count():

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield _step_rows([composed(r["first"], r["then"], window)])

        todo = steps.where(~F.col("known")).select(F.col("prev").alias("at"), F.struct(*columns).alias("then"))
        pairs = todo.join(steps.select(F.col("part").alias("at"), F.struct(*columns).alias("first")), "at").select("first", "then")
        steps = durable(steps.where("known").unionByName(pairs.mapInArrow(run, _STEPS)))
    return steps


def anchored_limit(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """key, seq, ts -> allowed: the first `limit` hits of each window of a key.

    Ties in time go by seq. A null key is a client of its own; rows that repeat are hits of their own, in any order;
    without hits there are no rows; other columns are ignored.
    """
    spark, window = hits.sparkSession, seconds * 1_000_000
    order = ["key", "ts", "seq", "nth"]
    ranged = hits.select("key", "seq", "ts").withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order)
    placed = durable(ranged.sortWithinPartitions(*order).select("key", "seq", "ts", F.spark_partition_id().alias("part")))
    ends = {r["part"]: r for r in _ends(placed)}
    before: dict[int, tuple[int, int]] = {}
    if any(r["continues"] for r in ends.values()):
        behind = _resolved(_functions(placed, ends, window), window).select("part", F.get("opened", F.lit(0)).alias("opened"), F.get("place", F.lit(0)).alias("place"))
        behind = {r.part: (r.opened, r.place) for r in behind.collect()}  # a row a piece
        before = {p: behind[r["prev"]] for p, r in ends.items() if r["continues"]}
    offsets = {p: r["offset"] for p, r in ends.items()}
    kinds = dict(placed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = None
        for batch in batches:
            allowed = np.zeros(batch.num_rows, bool)
            for key, ts, lo, hi in runs(batch):
                if mark is None:
                    part = batch.column("part")[0].as_py()
                    mark = Marks(key, *before.get(part, (None, 0)), offsets[part], window)
                elif key != mark.key:
                    mark = Marks(key, None, 0, 0, window)
                allowed[lo:hi] = mark.used(ts) <= limit
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "seq", "ts")), pa.array(allowed)], names=["key", "seq", "ts", "allowed"])

    return placed.mapInArrow(run, f"key {kinds['key']}, seq {kinds['seq']}, ts {kinds['ts']}, allowed boolean")
