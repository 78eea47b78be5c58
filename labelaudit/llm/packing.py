"""Bounded-space online packing of token ids into fixed windows.

Each partition reads its documents once and keeps at most `open_windows` windows open. A document's
full windows leave at once; its rest goes where it fits best, into a new window while there is room
for one, and otherwise the fullest open window leaves to make room. What is open at the end of a
partition is packed anew, largest piece first, cutting a piece only to fill a window to its last id;
the one window that stays partly empty travels on with its ids, and windows of up to `merge` such
partitions are filled up the same way in one further task each.

A task holds `open_windows` windows and one batch of documents. Rows that are placed travel as digests
unless `with_ids` asks for the ids.

Defined cases: null text is the empty text, one piece of just the end id; a null doc_id stays null;
rows that repeat a doc_id are packed one by one; a very long text gives many pieces; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from labelaudit.llm import tokens
from labelaudit.llm.common import partitions, read

WINDOW = 2048
OPEN_WINDOWS = 64
MERGE = 64
END_ID = 1

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE_ARROW = [(x.split()[0], pa.int64()) for x in PIECE.split(", ")]
_ALL = pa.schema([*_PIECE_ARROW, ("ids", pa.binary()), ("route", pa.int64())])

Piece = tuple  # (doc_id, start, ids, doc_tokens)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def fill(pieces: list[Piece], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Largest first into full windows, cutting only the piece that crosses a window's end.

    Gives the full windows and what is left, less than one window.
    """
    full: list[list[Piece]] = []
    now: list[Piece] = []
    room = window
    for doc_id, start, ids, total in sorted(pieces, key=lambda p: (-len(p[2]), p[0] is None, p[0], p[1])):
        while len(ids) >= room:
            now.append((doc_id, start, ids[:room], total))
            full.append(now)
            start, ids = start + room, ids[room:]
            now, room = [], window
        if len(ids):
            now.append((doc_id, start, ids, total))
            room -= len(ids)
    return full, now


class Packer:
    """The open windows of one partition. `place` and `close` give the windows that leave."""

    def __init__(self, window: int, open_windows: int) -> None:
        self.window, self.most = window, open_windows
        self.open: dict[int, list[Piece]] = {}
        self.rooms: list[tuple[int, int]] = []  # (room, window number), ascending
        self.next = 0

    def place(self, doc_id, ids: np.ndarray) -> Iterator[list[Piece]]:
        total, start = len(ids), 0
        while total - start >= self.window:
            yield [(doc_id, start, ids[start : start + self.window], total)]
            start += self.window
        if start == total:
            return
        piece = (doc_id, start, ids[start:], total)
        size = total - start
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, k = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most:
                yield self.open.pop(self.rooms.pop(0)[1])
            room, k = self.window, self.next
            self.open[k] = []
            self.next += 1
        self.open[k].append(piece)
        if room == size:
            yield self.open.pop(k)
        else:
            insort(self.rooms, (room - size, k))

    def close(self) -> tuple[list[list[Piece]], list[Piece]]:
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open, self.rooms = {}, []
        return fill(pieces, self.window)


class _Rows:
    """Collects output rows column by column."""

    def __init__(self, with_ids: bool) -> None:
        self.with_ids = with_ids
        self.rows: list[tuple] = []

    def window(self, pieces: list[Piece], sequence: int, route: int, carry: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            data = ids.astype("<u4").tobytes()
            kept = data if carry or self.with_ids else None
            self.rows.append((doc_id, start, len(ids), zlib.crc32(data), total, None if carry else sequence, offset, kept, route))
            offset += len(ids)

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _ALL.types, strict=True)], schema=_ALL)
            self.rows = []


def pack(
    docs: DataFrame,
    path: str | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
    merge: int = MERGE,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: PIECE, and ids (little-endian uint32 bytes) if asked."""
    path = path or tokens.vocabulary_path()

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, rows, n = Packer(window, open_windows), _Rows(with_ids), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(texts, path), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                for pieces in packer.place(doc_id, ids):
                    rows.window(pieces, (part << 32) | n, -1 - ((part << 20) + n))
                    n += 1
                yield from rows.take(5000)
        full, rest = packer.close()
        for pieces in full:
            rows.window(pieces, (part << 32) | n, -1 - ((part << 20) + n))
            n += 1
        rows.window(rest, 0, part // merge, carry=True)
        yield from rows.take()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[int, list[Piece]] = {}
        for batch in batches:
            placed = batch.filter(pc.less(batch.column("route"), 0))
            if placed.num_rows:
                yield placed
            for r in batch.filter(pc.greater_equal(batch.column("route"), 0)).to_pylist():
                left.setdefault(r["route"], []).append((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
        for group, pieces in sorted(left.items()):
            rows, (full, rest) = _Rows(with_ids), fill(pieces, window)
            for n, w in enumerate([*full, rest] if rest else full):
                rows.window(w, (1 << 62) | (group << 32) | n, -1)
            yield from rows.take()

    schema = PIECE + ", ids binary, route long"
    packed = docs.select("doc_id", "text").mapInArrow(partition, schema)
    done = packed.repartition(partitions(docs.sparkSession), "route").mapInArrow(finish, schema)
    return done.drop("route") if with_ids else done.drop("route", "ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
