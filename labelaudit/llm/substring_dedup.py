"""Removing passages that repeat across documents, by a depth-limited radix sort of suffixes.

Every position at which a `length`-byte string starts is a suffix, ordered through its first `length`
bytes and no further. A suffix is never alone: neighbours travel together as runs.

Dealing digit: of the grams inside a suffix's first `length` bytes, the one with the least hash. It is a
function of those bytes alone, so equal suffixes always meet; neighbouring suffixes share it, so a run of
some 20 travels as one entry, with the bytes its suffixes need. Entries of one bucket of this digit travel
together, compressed, and a task works off its partition bucket by bucket.

Most-significant-digit passes: equal runs are combined first (bytes are compared); then, within each
dealing digit that several documents have, suffixes are ordered by eight bytes at a time. After each pass
groups that lie in one document are dropped; a group that is left at depth `length` is a repeated string,
and all but its smallest document lose it.

Hot digits: of a passage that a third of all documents hold, a task sends one entry. A digit that still has
over HOT different runs is opened: its suffixes are dealt once more, by all of their `length` bytes, combined
in each task first, so a string that is everywhere is one entry a task. Nothing is held beyond a bucket,
and a bucket that grows over HOLD entries is opened at its most frequent digits.

Defined cases: null text is empty; texts shorter than the threshold keep all their bytes; rows that
repeat a doc_id are told apart by their text and never remove from each other; null doc_id counts as
the largest; texts are whole, however long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.llm.common import new_folder, partitions, read

LENGTH = 50
GRAM = 12
#: Entries a task combines before it sends them.
FLUSH = 300_000
#: Bytes of text whose entries share a bucket, on average.
BUCKET = 4_000_000
#: Suffixes of a long text that are cut into runs at a time.
BLOCK = 1 << 20
#: Different runs of one digit that are ordered in one place.
HOT = 32_768
#: Entries of a bucket held at a time.
HOLD = 400_000
#: Suffixes ordered at a time, in whole digits.
SORTED = 500_000
#: Bytes of a radix digit.
DIGIT = 8
LAST = np.iinfo(np.int64).max
Entries = dict[str, np.ndarray]


@cache
def _alphabet() -> np.ndarray:
    return np.random.default_rng(1234).integers(0, 2**64, 256, np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64, for at least n positions."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        base = 0x9E3779B97F4A7C15
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    forth, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_alphabet()[data] * forth[: len(data)], out=sums[1:])
    n = len(sums) - gram
    return mixed((sums[gram:] - sums[:n]) * back[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - span :]) if span < width else out


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def row_width(length: int, gram: int) -> int:
    """Bytes kept for a run, in whole radix digits."""
    return -(-(2 * length - gram) // DIGIT) * DIGIT


def blocks(data: np.ndarray, length: int, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text that hold `block` suffixes each, whole as far as they are ordered, and where they start."""
    for lo in range(0, len(data) - length + 1, block):
        yield lo, data[lo : lo + block + length - 1]


def cut_runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Dealing digit, bytes, start and number of suffixes of each run of `data`."""
    least = sliding_min(gram_hashes(data, gram), length - gram + 1)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(start, append=len(least))
    most = length - gram + 1
    if n.max() > most:  # a gram that repeats inside the text
        pieces = -(-n // most)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, n = np.repeat(start, pieces) + at * most, np.minimum(np.repeat(n, pieces) - at * most, most)
    width = row_width(length, gram)
    rows = sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)[start]
    rows[np.arange(width) >= (n + length - 1)[:, None]] = 0
    return least[start], rows, start, n


def entries(key: np.ndarray, rows: np.ndarray, doc: np.ndarray, tag: np.ndarray, n: np.ndarray, count: np.ndarray, place: np.ndarray) -> Entries:
    """`count` places of each entry stand one after the other in `place`. What travels of the digit is 32 bits,
    which with the bucket tell digits apart well enough; no result rests on them."""
    return {
        "key": key,
        "rows": rows,
        "doc": doc.astype(np.int64),
        "tag": tag.astype(np.int64),
        "n": n.astype(np.uint16),
        "count": count.astype(np.uint32),
        "place": place.astype(np.uint32),
    }


_TYPES = {"key": np.uint32, "rows": np.uint8, "doc": np.int64, "tag": np.int64, "n": np.uint16, "count": np.uint32, "place": np.uint32}


def joined(parts: list[Entries]) -> Entries:
    return {c: np.concatenate([p[c] for p in parts]) for c in _TYPES} if len(parts) > 1 else parts[0]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for count[i] numbers each."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def taken(e: Entries, where: np.ndarray) -> Entries:
    """The entries at the indices `where`, with their places."""
    count = e["count"].astype(np.int64)
    if (count == 1).all():
        return {c: v[where] for c, v in e.items()}
    places = e["place"][spread((np.cumsum(count) - count)[where], count[where])]
    return {c: v[where] for c, v in e.items() if c != "place"} | {"place": places}


def dumped(e: Entries) -> bytes:
    head = np.array([len(e["key"]), len(e["place"]), e["rows"].shape[1]], "<i8").tobytes()
    body = b"".join(e[c].astype(t, copy=False).tobytes() for c, t in _TYPES.items())
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(head + body, asbytes=True)


def loaded(data: bytes) -> Entries:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little") + 24, asbytes=True)
    n, places, width = np.frombuffer(raw, "<i8", 3).tolist()
    at, out = 24, {}
    for c, t in _TYPES.items():
        size = {"rows": n * width, "place": places}.get(c, n)
        out[c] = np.frombuffer(raw, t, size, at)
        at += size * np.dtype(t).itemsize
    out["rows"] = out["rows"].reshape(n, width)
    return out


def edges(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns begins a new group."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def row_digest(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = n.astype(np.uint64)
    for word in np.ascontiguousarray(rows).view(np.uint64).T:
        x = mixed(x ^ word)
    return x


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def spans_of(e: Entries, where: np.ndarray) -> Spans:
    """doc, tag, position and number of suffixes of the entries at `where`, place by place."""
    part = taken(e, where)
    return tuple(np.repeat(part[c], part["count"]) for c in ("doc", "tag")) + (part["place"].astype(np.int64), np.repeat(part["n"], part["count"]).astype(np.int64))


def combined(e: Entries, lead: np.ndarray | None = None) -> tuple[Entries, Spans]:
    """Equal runs in one: those of their smallest document, sorted by `lead` (the digit), and the spans of all
    other documents. Digests only bring equal runs together; they are equal if their digits and bytes are."""
    lead = e["key"] if lead is None else lead
    digest = row_digest(e["rows"], e["n"]) ^ mixed(e["key"].astype(np.uint64))
    e = taken(e, np.argsort((lead.astype(np.uint64) << np.uint64(32)) | (digest >> np.uint64(32)), kind="stable"))
    words = np.ascontiguousarray(e["rows"]).view(np.uint64)
    run = edges(e["key"], e["n"])
    for word in words.T:
        run[1:] |= word[1:] != word[:-1]
    group = np.cumsum(run) - 1
    least = np.minimum.reduceat(e["doc"], np.flatnonzero(run))[group] if len(run) else e["doc"]
    goes = e["doc"] != least
    gone = spans_of(e, np.flatnonzero(goes))
    if goes.any():
        stays = np.flatnonzero(~goes)
        e, group = taken(e, stays), group[stays]
    own = np.flatnonzero(edges(group, e["tag"]))  # one entry for each row of the smallest document
    if len(own) == len(group):
        return e, gone
    count = np.add.reduceat(e["count"], own, dtype=np.uint32)
    return {c: v[own] for c, v in e.items() if c not in ("count", "place")} | {"count": count, "place": e["place"]}, gone


def suffixes(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Entry and offset in its run of each suffix."""
    n = e["n"].astype(np.int64)
    return np.repeat(np.arange(len(n)), n), spread(np.zeros(len(n), np.int64), n)


def places_of(e: Entries, entry: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many places each suffix has, and where they are."""
    count = e["count"].astype(np.int64)
    first = np.cumsum(count) - count
    return count[entry], e["place"][spread(first[entry], count[entry])].astype(np.int64) + np.repeat(offset, count[entry])


def ordered(e: Entries, length: int) -> Spans:
    """Radix passes over the suffixes of the entries, which are sorted by digit: the spans of suffixes that a
    smaller document has, too."""
    entry, offset = suffixes(e)
    width = e["rows"].shape[1]
    flat = np.concatenate([e["rows"].ravel(), np.zeros(length + DIGIT, np.uint8)])
    view = sliding_window_view(flat, DIGIT)
    group = (np.cumsum(edges(e["key"][entry])) - 1).astype(np.int64)
    doc = e["doc"][entry]
    for depth in range(0, length, DIGIT):
        beyond = max(0, depth + DIGIT - length)
        digit = view[entry * width + offset + depth].view(">u8").ravel().astype(np.uint64) >> np.uint64(8 * beyond)
        order = np.lexsort((digit, group))
        group = edges(group[order], digit[order])
        first = np.flatnonzero(group)
        group = np.cumsum(group) - 1
        entry, offset, doc = entry[order], offset[order], doc[order]
        if not len(first):
            break
        least = np.minimum.reduceat(doc, first)
        several = (least < np.maximum.reduceat(doc, first))[group]
        least = least[group][several]
        entry, offset, doc, group = entry[several], offset[several], doc[several], group[several]
    else:
        later = doc > least
        entry, offset = entry[later], offset[later]
    count, place = places_of(e, entry, offset)
    return np.repeat(e["doc"][entry], count), np.repeat(e["tag"][entry], count), place, np.ones(len(place), np.int64)


def settled(e: Entries, length: int, hot: int, may_open: bool = True) -> Iterator[tuple[int, Spans | Entries]]:
    """COVERED spans among the entries of a bucket, and OPEN entries of digits with over `hot` runs."""
    e, gone = combined(e)
    yield COVERED, gone
    first = np.flatnonzero(edges(e["key"]))
    if not len(first):
        return
    size = np.diff(first, append=len(e["key"]))
    several = np.minimum.reduceat(e["doc"], first) < np.maximum.reduceat(e["doc"], first)
    open_ = several & (size > hot) & may_open
    for k in np.flatnonzero(open_):
        yield OPEN, taken(e, np.arange(first[k], first[k] + size[k]))
    some = np.flatnonzero(several & ~open_)
    total = np.cumsum(np.add.reduceat(e["n"], first, dtype=np.int64)[some])
    for lo in np.flatnonzero(edges(total // SORTED)) if len(some) else []:
        part = some[lo:][total[lo:] // SORTED == total[lo] // SORTED]
        yield COVERED, ordered(taken(e, spread(first[part], size[part])), length)


def by_document(spans: Spans) -> Iterator[pa.RecordBatch]:
    """doc, tag, starts and numbers of suffixes, touching runs merged."""
    doc, tag, pos, n = spans
    if not len(pos):
        return
    order = np.lexsort((pos, tag, doc))
    doc, tag, pos, n = doc[order], tag[order], pos[order], n[order]
    owner = edges(doc, tag)
    lift = (np.cumsum(owner) - 1) << 33
    at = pos + lift
    reach = np.maximum.accumulate(at + n)
    new = owner.copy()
    new[1:] |= at[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(at)) - 1
    size = reach[last] - at[starts]
    docs = np.flatnonzero(owner[starts])
    ends = np.append(docs[1:], len(starts))
    for lo in range(0, len(docs), 4096):
        part, stop = docs[lo : lo + 4096], int(ends[min(lo + 4096, len(docs)) - 1])
        offsets = pa.array(np.append(part, stop) - part[0], pa.int32())
        lists = (pa.ListArray.from_arrays(offsets, pa.array(x[part[0] : stop], pa.int64())) for x in (pos[starts], size))
        rows, k = starts[part], len(part)
        columns = [pa.array(np.full(k, COVERED), pa.int32()), pa.array(doc[rows]), pa.array(tag[rows]), *lists, pa.nulls(k, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_FOUND_ARROW)


ENTRY, COVERED, OPEN = 0, 1, 2
_FOUND = "kind int, doc long, tag long, starts array<long>, sizes array<long>, data binary"
_FOUND_ARROW = pa.schema(
    [("kind", pa.int32()), ("doc", pa.int64()), ("tag", pa.int64()), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())]
)
_DEALT = "route long, bucket long, kind int, data binary"
_DEALT_ARROW = pa.schema([("route", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
#: Entries in one row of dealt data.
PACKED = 16_384


def even_routes(spark: SparkSession, n: int) -> np.ndarray:
    """A number for each of n partitions that hash partitioning sends there, so that buckets, taken in turn, fill
    the partitions evenly. They need not: a bucket is whole wherever it lands."""
    found = spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    routes = np.arange(n)
    for r in found.collect():  # n rows
        routes[r.p] = r.id
    return routes


def deal(parts: list[Entries], buckets: int, routes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Combine a task's entries and send them by bucket, in rows of at most PACKED; spans go along."""
    e = joined(parts)
    e, gone = combined(e, bucket_numbers(e["key"], buckets))
    bucket = bucket_numbers(e["key"], buckets)
    places = np.append(0, np.cumsum(e["count"], dtype=np.int64))
    cuts = np.flatnonzero(edges(bucket) | (np.arange(len(bucket)) % PACKED == 0))
    rows: list[tuple] = []
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
        part = {c: v[lo:hi] for c, v in e.items() if c != "place"} | {"place": e["place"][places[lo] : places[hi]]}
        rows.append((int(routes[bucket[lo] % len(routes)]), int(bucket[lo]), ENTRY, dumped(part)))
        if len(rows) >= 64:
            yield _batch(rows)
            rows = []
    for lo in range(0, len(gone[0]), 4 * PACKED):
        part = tuple(c[lo : lo + 4 * PACKED] for c in gone)
        at = int(mixed(part[0][:1].astype(np.uint64))[0] % np.uint64(buckets))
        rows.append((int(routes[at % len(routes)]), at, COVERED, dumped_spans(part)))
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DEALT_ARROW.types, strict=True)], schema=_DEALT_ARROW)


def dumped_spans(spans: Spans) -> bytes:
    raw = np.stack(spans).astype("<i8").tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def loaded_spans(data: bytes) -> Spans:
    return tuple(np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), "<i8").reshape(4, -1))


def bucket_numbers(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def opened(e: Entries) -> pa.RecordBatch:
    """A row with the entries and, as its size, the number of their suffixes."""
    columns = [[OPEN], [None], [None], None, [[int(e["n"].sum(dtype=np.int64))]], [dumped(e)]]
    return pa.RecordBatch.from_arrays([pa.array(c or [None], t) for c, t in zip(columns, _FOUND_ARROW.types, strict=True)], schema=_FOUND_ARROW)


def meet(length: int, hot: int, hold: int, may_open: bool):
    """The receiving side: one bucket after the other. Where digits are whole strings none is opened: equal
    entries are one, and buckets are as many as the strings need."""

    def results(found: Iterator[tuple[int, Spans | Entries]]) -> Iterator[pa.RecordBatch]:
        spans: list[Spans] = []
        for kind, what in found:
            if kind == COVERED:
                spans.append(what)
                continue
            for at in range(0, len(what["key"]), PACKED):
                yield opened(taken(what, np.arange(at, min(at + PACKED, len(what["key"])))))
        if spans:
            yield from by_document(tuple(np.concatenate(c) for c in zip(*spans, strict=True)))

    def eased(e: Entries, hot_keys: set[int]) -> tuple[Entries, list[tuple[int, Spans | Entries]]]:
        """The entries combined, without those of the most frequent digits if they are still too many."""
        e, gone = combined(e)
        out: list[tuple[int, Spans | Entries]] = [(COVERED, gone)]
        if may_open and len(e["key"]) > hold // 2:
            keys, n = np.unique(e["key"], return_counts=True)
            most = np.argsort(-n, kind="stable")
            hot_keys.update(keys[most[: 1 + int(np.searchsorted(np.cumsum(n[most]), len(e["key"]) - hold // 4))]].tolist())
            e, part = parted(e, hot_keys)
            out.append((OPEN, part))
        return e, out

    def parted(e: Entries, hot_keys: set[int]) -> tuple[Entries, Entries]:
        is_hot = np.isin(e["key"], np.fromiter(hot_keys, np.uint32, len(hot_keys)))
        return taken(e, np.flatnonzero(~is_hot)), taken(e, np.flatnonzero(is_hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n, most, hot_keys = None, [], 0, hold, set()
        for batch in batches:
            for bucket, kind, data in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                if bucket != at:
                    if held:
                        yield from results(settled(joined(held), length, hot, may_open))
                    at, held, n, most, hot_keys = bucket, [], 0, hold, set()
                if kind == COVERED:
                    yield from by_document(loaded_spans(data.as_py()))
                    continue
                e = loaded(data.as_py())
                if hot_keys:
                    e, part = parted(e, hot_keys)
                    yield from results(iter([(OPEN, part)]))
                held.append(e)
                n += len(e["key"])
                if n > most:
                    e, out = eased(joined(held), hot_keys)
                    yield from results(iter(out))
                    held, n = [e], len(e["key"])
                    most = max(hold, 2 * n)
        if held:
            yield from results(settled(joined(held), length, hot, may_open))

    return run


def written(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back. The shuffle files of the work so far are not needed again
    and go at once, so the disk holds one pass at a time; the session's own setting comes back."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.getAll.get(key)
    folder = new_folder(spark, what)
    try:
        spark.conf.set(key, "true")
        df.write.parquet(folder)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.parquet(folder)


def per_document(found: DataFrame) -> DataFrame:
    return found.groupBy("doc", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("sizes")).alias("sizes"))


def repeated(texts: DataFrame, n_bytes: int, length: int = LENGTH, gram: int = GRAM, flush: int = FLUSH, hot: int = HOT, hold: int = HOLD, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """doc, tag, starts, sizes: the positions at which a string starts that a smaller document has, too."""
    spark = texts.sparkSession
    buckets = max(n_bytes // bucket, partitions(spark))
    routes = even_routes(spark, partitions(spark))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc, tag, text in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), strict=True):
                for lo, data in blocks(bytes_of(text.as_py()), length, block):
                    key, rows, start, size = cut_runs(data, length, gram)
                    k = len(start)
                    held.append(entries(key, rows, np.full(k, doc), np.full(k, tag), size, np.ones(k), start + lo))
                    n += k
                    if n >= flush:
                        yield from deal(held, buckets, routes)
                        held, n = [], 0
        if held:
            yield from deal(held, buckets, routes)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each suffix of the opened entries as an entry of its own, under a digit of all its bytes."""
        for batch in batches:
            for data in batch.column("data"):
                e = loaded(data.as_py())
                for lo in range(0, len(e["key"]), 8192):
                    part = taken(e, np.arange(lo, min(lo + 8192, len(e["key"]))))
                    entry, offset = suffixes(part)
                    width = part["rows"].shape[1]
                    rows = np.zeros((len(entry), width), np.uint8)
                    rows[:, :length] = sliding_window_view(part["rows"].ravel(), length)[entry * width + offset]
                    one = np.ones(len(entry), np.uint8)
                    key = row_digest(rows, one)
                    count, place = places_of(part, entry, offset)
                    yield from deal([entries(key, rows, part["doc"][entry], part["tag"][entry], one, count, place)], wide, routes)

    def met(dealt: DataFrame, may_open: bool) -> DataFrame:
        return dealt.repartition(partitions(spark), "route").sortWithinPartitions("bucket").mapInArrow(meet(length, hot, hold, may_open), _FOUND)

    first = written(met(texts.select("doc", "tag", "text").mapInArrow(runs, _DEALT), True), "dealing-digit")
    found, open_ = first.where(F.col("kind") == COVERED), first.where(F.col("kind") == OPEN)
    wide = max((open_.agg(F.sum(F.element_at("sizes", 1))).first()[0] or 0) // max(1, hold // 4), partitions(spark))
    return per_document(found.unionByName(met(open_.select("data").mapInArrow(singles, _DEALT), False)))


def tagged(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc, tag, text and doc_id of each row, and the bytes of all texts. The tag tells rows of one doc_id
    apart by their text; it is 0 where no doc_id repeats."""
    per_id = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    most = per_id.agg(F.max("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    tag = F.xxhash64(F.coalesce("text", F.lit(""))) if (most.n or 0) > 1 else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc"), tag.alias("tag"), "text", "doc_id"), most.bytes or 0


def covered(n_bytes: int, starts: list[int], sizes: list[int], length: int) -> np.ndarray:
    """Whether each byte lies in one of the strings that start at the given positions."""
    change = np.zeros(n_bytes + 1, np.int64)
    start = np.array(starts, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + np.array(sizes, np.int64) + length - 1, -1)
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_kept: bool = False, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the kept bytes and the removed spans."""
    texts, n_bytes = tagged(docs)
    hits = repeated(texts, n_bytes, length, **how)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<struct<start:long,end:long>>" * with_kept

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, starts, sizes in zip(*(batch.column(c) for c in ("doc_id", "text", "starts", "sizes")), strict=True):
                data = bytes_of(text.as_py())
                row = {"doc_id": doc_id.as_py(), "n_bytes": len(data), "n_removed": 0, "n_spans": 0}
                kept, bounds = data, []
                if starts.is_valid:
                    gone = covered(len(data), starts.as_py(), sizes.as_py(), length)
                    kept = data[~gone]
                    bounds = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
                    row |= {"n_removed": len(data) - len(kept), "n_spans": len(bounds)}
                row["kept_sha256"] = hashlib.sha256(kept.tobytes()).hexdigest()
                if with_kept:
                    row |= {"kept": kept.tobytes(), "removed": [{"start": a, "end": b} for a, b in bounds]}
                out.append(row)
                if len(out) >= (256 if with_kept else 4096):
                    yield pa.RecordBatch.from_pylist(out, schema=_arrow(with_kept))
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(with_kept))

    return texts.join(hits, ["doc", "tag"], "left").select("doc_id", "text", "starts", "sizes").mapInArrow(cut, schema)


def _arrow(with_kept: bool) -> pa.Schema:
    plain = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.schema(plain + [("kept", pa.binary()), ("removed", span)] * with_kept)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
