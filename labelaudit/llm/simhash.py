"""SimHash near-dedup with BK-trees.

A text's fingerprint has a bit for each bit of its word shingles' XXH64 digests that over half of them
set. Distinct fingerprints are dealt into shards such that any two within the radius meet in at least
one: the bits are cut into blocks, and two fingerprints that differ in `radius` bits agree on
`blocks - radius` of them, so each choice of that many blocks is a key. The number of blocks grows with
the number of fingerprints, which keeps shards small: 5 keys a fingerprint at first, 15 from 2 million and
35 from a thousand million on. A shard of more than CHUNK fingerprints is cut into chunks, and each pair of
chunks meets under a key of its own. Tasks read their shards sorted and hold HELD rows of them and one shard.

Each shard is a BK-tree, its children keyed by the integer Hamming distance to their parent; a search
follows only edges within the radius. All trees of a task are built and searched level by level in
numpy. A search gives links enough to connect what is connected, one for each fingerprint of a shard and
few to any, never all pairs; subtrees already joined to the searching fingerprint are left out.

Links of all shards are joined into components by hooking to the smallest label and jumping, in
DataFrame steps with checkpoints. Joins on labels and fingerprints, of which one may be a third of all,
split such keys over many tasks.

The pipeline's stage links by the Jaccard similarity of the sets of shingles, and the trees only name
candidates. Shards are dealt by bands of minima: sets similar to s agree on a band of k with chance s**k,
whatever their size. Each candidate is held against the exact sets before it links. First every set is
checked with a few of its candidates, which joins large groups at little cost. Then come all pairs whose
components differ: where a task finds some, their sets' sizes and parity bitmaps are fetched, by which most
pairs that are not similar enough are refuted on the spot, without loss. What is left is checked, in rounds where
it is much; a round leaves out the pairs whose components have met, so no candidate goes unchecked that could
join two.

Defined cases: null text is empty; texts without words have fingerprint zero and link like any other;
fewer words than a shingle make one shingle of all; rows that repeat share a fingerprint and a
component; null doc_id is never the smallest unless its component has no other; an empty table gives
no rows; other columns are ignored by `components` and kept by `drop_near_copies`, for which texts
without words have equal sets and are similar to no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.llm.common import bounded, durable, fresh, partitions, read, remove_folder, skew_join, written

SHINGLE = 4
RADIUS = 4
CHUNK = 4096
#: Pairs of a search held at a time; some ten arrays of numbers are as long.
FRONTIER = 1 << 17
#: Rows of whole shards searched at a time.
HELD = 1 << 16
#: Links of an item to others of its shard, beside the one to its parent.
FANOUT = 16
#: Rows of a label that are no burden for a task of the component loop.
LOOPED = 200_000
#: Partitions that are enough for so many rows.
FEW = 8
#: Fingerprints a shard may hold on average before more blocks are used.
SHARD = 512
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_digests(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `shingle` words, A-Z lower-cased, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, bits: int = 64) -> str:
    """Lowercase hex; 64 bits from the digests themselves, further ones from digests mixed anew."""
    return digest_bits(shingle_digests(text, shingle), bits)


def digest_bits(h: np.ndarray, bits: int) -> str:
    out = []
    for lane in range(bits // 64):
        x = h
        if lane:
            x = (h ^ np.uint64(_LANES[lane])) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        columns = x.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
        counts = (np.bincount(columns.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
        value = np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0]
        out.append(f"{int(value):016x}")
    return "".join(out)


def text_tag() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, bits: int = 64) -> DataFrame:
    """doc_id, tag, fp for each row; the tag tells rows of one doc_id apart by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, bits) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("tag"), pa.array(fps, pa.string())], names=["doc_id", "tag", "fp"])

    return docs.select("doc_id", text_tag().alias("tag"), "text").mapInArrow(run, "doc_id long, tag long, fp string")


def parsed(fps: list[str]) -> np.ndarray:
    """(n, words of 64 bits)"""
    raw = np.frombuffer(bytes.fromhex("".join(fps)), ">u8").astype(np.uint64)
    return raw.reshape(len(fps), -1) if fps else raw.reshape(0, 1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """A BK-tree for each shard among the items given; `shard` is sorted."""

    def __init__(self, items: np.ndarray, shard: np.ndarray) -> None:
        self.items, n = items, len(items)
        self.span = items.shape[1] * 64 + 1
        first = np.searchsorted(shard, shard)
        self.root = first
        self.parent = np.full(n, -1)
        self.edge = np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = [np.unique(first)]
        self.order = np.arange(n) - first  # place within the shard
        waiting = np.flatnonzero(np.arange(n) != first)
        at = first[waiting]
        while len(waiting):
            d = distance(items[waiting], items[at])
            _, head, back = np.unique(at * self.span + d, return_index=True, return_inverse=True)
            nodes = waiting[head]
            self.parent[nodes], self.edge[nodes] = at[head], d[head]
            self.levels.append(nodes)
            rest = np.ones(len(waiting), bool)
            rest[head] = False
            at, waiting = nodes[back][rest], waiting[rest]
        child = np.flatnonzero(self.parent >= 0)
        key = self.parent[child] * self.span + self.edge[child]
        sort = np.argsort(key, kind="stable")
        self.keys, self.children = key[sort], child[sort]

    def links(self, radius: int, partner: np.ndarray | None = None) -> np.ndarray:
        """A label for each item: items within the radius of each other in a shard share it. `partner` is
        given some item within the radius for each that has one."""
        label = np.arange(len(self.items))
        done, top = 0, int(self.order.max(initial=-1)) + 1
        step = 64
        while done < top:
            asking = np.flatnonzero((self.order >= done) & (self.order < done + step))
            low, high = self._uniform(label)
            for a, b in self._search(asking, radius, label, low, high):
                label = merged(label, a, b)
                if partner is not None:
                    partner[a], partner[b] = b, a
            done, step = done + step, step * 2
        return label

    def apart(self, radius: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every pair within the radius in a shard whose labels differ."""
        low, high = self._uniform(label)
        for lo in range(0, len(label), 4096):
            for a, b in self._search(np.arange(lo, min(lo + 4096, len(label))), radius, label, low, high):
                keep = (a < b) & (label[a] != label[b])
                yield a[keep], b[keep]

    def _uniform(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = label.copy(), label.copy()
        for nodes in reversed(self.levels[1:]):
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        return low, high

    def _search(self, asking, radius, label, low, high) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within the radius of the items asking, at most FRONTIER pairs of item and node at a time. On the stack
        are nodes to test, or ranges of children that are yet to become such."""
        stack = [(asking, self.root[asking], None)]
        while stack:
            q, at, n = stack.pop()
            if n is not None:  # children at .. at + n of a node that is tested already
                fit = max(1, int(np.searchsorted(np.cumsum(n), FRONTIER, side="right")))
                if fit < len(n):
                    stack.append((q[fit:], at[fit:], n[fit:]))
                    q, at, n = q[:fit], at[:fit], n[:fit]
                total = int(n.sum())
                child = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                q, at = np.repeat(q, n), self.children[child]
            elif len(q) > FRONTIER:
                stack.append((q[FRONTIER:], at[FRONTIER:], None))
                q, at = q[:FRONTIER], at[:FRONTIER]
            todo = ~((low[at] == high[at]) & (low[at] == label[q]))
            q, at = q[todo], at[todo]
            if not len(q):
                continue
            d = distance(self.items[q], self.items[at])
            hit = (d <= radius) & (q != at)
            if hit.any():
                yield q[hit], at[hit]
            lo = np.searchsorted(self.keys, at * self.span + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, at * self.span + np.minimum(d + radius, self.span - 1), side="right") - lo
            more = n > 0
            if more.any():
                stack.append((q[more], lo[more], n[more]))


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: the smallest item of a component."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        label = label.copy()
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def block_masks(blocks: int, radius: int, bits: int = 64) -> list[int]:
    """Every choice of blocks - radius blocks, as a mask of bits."""
    cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def exact_masks(n: int, radius: int, bits: int = 64, shard: int = SHARD) -> list[int]:
    """The fewest blocks for which n evenly spread fingerprints make shards of at most `shard`."""
    blocks = radius + 1
    while blocks < 2 * radius + 2 and n > shard * 2 ** (bits * (blocks - radius) // blocks) and comb(blocks + 1, radius) <= 512:
        blocks += 1
    return block_masks(blocks, radius, bits)


def cut_hot(keyed: DataFrame, name: str, chunk: int) -> DataFrame:
    """`keyed` with the keys of more than `chunk` rows replaced by one for each pair of their chunks."""
    columns = [c for c in keyed.columns if c != "key"]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    hot = durable(sizes.where(F.col("n") > chunk).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).drop("n"))
    if not hot.limit(1).count():
        return keyed
    mine = F.pmod(F.xxhash64(name), F.col("chunks")).cast("int")
    split = keyed.join(bounded(hot), "key", "left").withColumn("mine", F.when(F.col("chunks").isNotNull(), mine).otherwise(0))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.xxhash64("key", F.least(x, F.col("mine")), F.greatest(x, F.col("mine"))))
    split = split.withColumn("pair", F.explode(F.when(F.col("chunks").isNotNull(), pairs).otherwise(F.array("key"))))
    return split.select(F.col("pair").alias("key"), *columns)


def by_shard(batches: Iterator[pa.RecordBatch], rows: int = HELD) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole shards of two rows or more, some `rows` rows at a time, and the number of each row's shard. The rows
    come sorted by key, so no more is held than those and one shard."""

    def shards(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        table = pa.Table.from_batches(held)
        shard = key_numbers(table.column("key").to_numpy())
        several = np.flatnonzero((np.bincount(shard) > 1)[shard])
        if len(several):
            table = table.take(pa.array(several))
            yield table, key_numbers(table.column("key").to_numpy())

    held, n = [], 0
    for batch in batches:
        if n >= rows and batch.num_rows:
            last = held[-1].column("key")[-1].as_py()
            same = int(np.searchsorted(batch.column("key").to_numpy() != last, True))
            held.append(batch.slice(0, same))
            n, batch = n + same, batch.slice(same)
            if batch.num_rows:
                yield from shards(held)
                held, n = [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield from shards(held)


def tree_links(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join the items of each label in a tree of FANOUT children a node, so no item has many links."""
    order = np.argsort(label, kind="stable")
    first = np.searchsorted(label[order], label[order])
    place = np.arange(len(order)) - first
    child = np.flatnonzero(place > 0)
    return order[child], order[first[child] + (place[child] - 1) // FANOUT]


def link(fps: DataFrame, masks: list[int], radius: int, chunk: int = CHUNK) -> DataFrame:
    """fp, other: links that connect, within each shard, all that is within the radius."""
    n_parts = partitions(fps.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_pylist()
            items = parsed(fps)
            words = items.shape[1]
            out = []
            for number, mask in enumerate(masks):
                salt = np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                x = np.zeros(len(items), np.uint64)
                for w in range(words):  # the first word holds the lowest bits
                    part = np.uint64(mask >> (64 * w) & 0xFFFFFFFFFFFFFFFF)
                    x = (x ^ (items[:, w] & part) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
                    x ^= x >> np.uint64(29)
                    x = x * np.uint64(0x94D049BB133111EB)
                    x ^= x >> np.uint64(32)
                out.append(x.view(np.int64))
            for at in range(len(masks)):
                yield pa.RecordBatch.from_arrays([pa.array(out[at]), batch.column("fp")], names=["key", "fp"])

    keyed = fps.select("fp").mapInArrow(keys, "key long, fp string")
    keyed = cut_hot(keyed, "fp", chunk)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, shard in by_shard(batches):
            name = table.column("fp").combine_chunks()
            a, b = tree_links(Forest(parsed(name.to_pylist()), shard).links(radius))
            for lo in range(0, len(a), 20_000):
                yield pa.RecordBatch.from_arrays([name.take(pa.array(x[lo : lo + 20_000])) for x in (a, b)], names=["fp", "other"])

    return keyed.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(search, "fp string, other string").distinct()


def key_numbers(key: np.ndarray) -> np.ndarray:
    edge = np.ones(len(key), bool)
    edge[1:] = key[1:] != key[:-1]
    return np.cumsum(edge)


def connect(links: DataFrame) -> DataFrame:
    """fp, root for every fingerprint that has a link; the root is the smallest fingerprint reachable."""
    spark, links = links.sparkSession, durable(links)
    both = links.select(F.col("fp").alias("a"), F.col("other").alias("b")).unionByName(links.select(F.col("other").alias("a"), F.col("fp").alias("b")))
    # where all rows together are no burden for a task, no key of theirs can be, and a few files hold them
    few = both.count() <= LOOPED
    join = (lambda rows, table, key, by: rows.join(table, key)) if few else (lambda rows, table, key, by: skew_join(rows, table, key, [by], n=None, least=LOOPED))
    kept = lambda df: written(df.coalesce(FEW) if few else df, "links")
    both, mine = kept(both)
    label, last = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("root")))
    while True:
        heard = join(both, label.select(F.col("fp").alias("b"), "root"), "b", "a").groupBy("a").agg(F.min("root").alias("heard"))
        hooked, hooks = kept(label.join(heard, label["fp"] == heard["a"]).select("fp", F.least("root", "heard").alias("new"), F.col("root").alias("old")))
        up = hooked.select(F.col("fp").alias("new"), F.col("new").alias("upper"))
        jumped, now = kept(join(hooked, up, "new", "fp").select("fp", F.least("new", "upper").alias("root"), (F.least("new", "upper") < F.col("old")).alias("moved")))
        for folder in (hooks, last):
            remove_folder(spark, folder)
        label, last = jumped.select("fp", "root"), now
        if not jumped.where("moved").limit(1).count():
            remove_folder(spark, mine)
            return label


def classes(docs: DataFrame, shingle: int = SHINGLE, bits: int = 64, radius: int = RADIUS) -> DataFrame:
    """doc_id, tag, fp, first: each row and the row (`none`, doc_id, tag) that stands for its component."""
    rows = durable(fingerprints(docs, shingle, bits))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    distinct = durable(rows.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("n")))
    n = distinct.count()
    return named(rows, distinct, connect(link(distinct, exact_masks(n, radius, bits), radius)))


def named(rows: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """`rows` with the row that stands for the component of each fp; `distinct` has first and n of each."""
    known = durable(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = known.groupBy("root").agg(F.min("first").alias("smallest"), F.count("*").alias("members"))
    stands = skew_join(known, smallest, "root", ["fp"], "members").select("fp", F.col("smallest").alias("first"), "n")
    return skew_join(rows, stands, "fp", ["doc_id", "tag"])


def components(docs: DataFrame, shingle: int = SHINGLE, bits: int = 64, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return classes(docs, shingle, bits, radius).select("doc_id", F.col("fp").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


#: The pipeline's stage: sets of five-word shingles whose Jaccard similarity is at least 4/5. At just that, a
#: chance of (1 - 0.8**4)**16 = 0.0002 to share no band. The bits that differ are at most 3/16 in the mean
#: (five shingles and four of them), beyond 72 of 256 with a chance of 0.0001 there and far less for longer texts.
NEAR = {"shingle": 5, "bits": 256, "radius": 72, "band": 4, "tables": 16}
SIMILAR = (4, 5)
#: Candidates of a set that are checked first, and candidates a set on average from which rounds are needed.
FIRST = 4
ROUND = 1
#: Bits of a set's bitmap: a power of two of at least four a shingle, within these bounds.
BITMAP = (256, 8192)
#: Bytes of bitmaps of one side compared at a time.
COMPARED = 1 << 22


def bands(h: np.ndarray, band: int, tables: int, seed: int = 3) -> list[int]:
    """A key for each table: digest of the minima of a set under `band` seeded orders."""
    if not len(h):
        return []
    odd, flip = np.random.default_rng(seed).integers(0, 2**64, (2, band * tables), np.uint64)
    least = np.full(band * tables, np.iinfo(np.uint64).max)
    for lo in range(0, len(h), 2048):
        x = (h[lo : lo + 2048, None] ^ flip) * (odd | np.uint64(1))
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(m.tobytes(), t) - 2**63 for t, m in enumerate(least.reshape(tables, band))]


def set_name(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def parity(h: np.ndarray) -> bytes:
    """A bit for each remainder of the digests, set if an odd number has it. Two such bitmaps differ in no more bits
    than the sets in members; the halves of one, combined by exclusive or, are the bitmap of half the size."""
    m = BITMAP[0]
    while m < min(4 * len(h), BITMAP[1]):
        m *= 2
    counts = np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class Refuted:
    """Tells pairs of sets that cannot be similar enough, by their sizes and bitmaps."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[bytes]) -> None:
        self.sizes = sizes.astype(np.int64)
        self.width = np.array([len(b) for b in bitmaps])
        self.place: dict[int, np.ndarray] = {}
        self.maps: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            for own in (w, w // 2):  # sets of a similar size have half the width at least
                self.place.setdefault(own, np.full(len(bitmaps), -1))
        for w, place in self.place.items():
            rows = []
            for i in np.flatnonzero((self.width == w) | (self.width == 2 * w)).tolist():
                data = np.frombuffer(bitmaps[i], np.uint64)
                place[i] = len(rows)
                rows.append(data if len(bitmaps[i]) == w else data[: w // 8] ^ data[w // 8 :])
            self.maps[w] = np.array(rows, np.uint64).reshape(len(rows), -1)

    def keep(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs may be similar enough. Sets of a similarity of at least p / q differ in at most
        (q - p) / (q + p) of the sum of their sizes."""
        part, whole = SIMILAR
        x, y = self.sizes[a], self.sizes[b]
        ok = np.minimum(x, y) * whole >= np.maximum(x, y) * part
        width = np.minimum(self.width[a], self.width[b])
        for w in np.unique(width[ok]).tolist():
            mine = np.flatnonzero(ok & (width == w))
            step = max(1, COMPARED // w)
            for lo in range(0, len(mine), step):
                some = mine[lo : lo + step]
                place, maps = self.place[w], self.maps[w]
                apart = np.bitwise_count(maps[place[a[some]]] ^ maps[place[b[some]]]).sum(axis=1, dtype=np.int64)
                ok[some] = apart * (whole + part) <= (x[some] + y[some]) * (whole - part)
        return ok


def sketches(docs: DataFrame, shingle: int, bits: int, band: int, tables: int) -> DataFrame:
    """doc_id, tag, fp, print, keys, size, bitmap for each row: name, fingerprint and bands of its set of shingles,
    and what pairs are refuted by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_digests(t, shingle)) for t in batch.column("text").to_pylist()]
            columns = [
                pa.array([set_name(h) for h in sets], pa.binary()),
                pa.array([bytes.fromhex(digest_bits(h, bits)) for h in sets], pa.binary()),
                pa.array([bands(h, band, tables) for h in sets], pa.list_(pa.int64())),
                pa.array([len(h) for h in sets], pa.int32()),
                pa.array([parity(h) for h in sets], pa.binary()),
            ]
            names = ["doc_id", "tag", "fp", "print", "keys", "size", "bitmap"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("tag"), *columns], names=names)

    schema = "doc_id long, tag long, fp binary, print binary, keys array<long>, size int, bitmap binary"
    return docs.select("doc_id", text_tag().alias("tag"), "text").mapInArrow(run, schema)


def prints_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint64).reshape(table.num_rows, -1)


def partners(nodes: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """fp, other: some partner within the radius for each fp that has one in a shard."""
    keyed = cut_hot(nodes.select(F.explode("keys").alias("key"), "fp", "print"), "fp", chunk)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, shard in by_shard(batches):
            name, partner = table.column("fp").combine_chunks(), np.full(len(shard), -1)
            Forest(prints_of(table), shard).links(radius, partner)
            has = np.flatnonzero(partner >= 0)
            yield from _pairs(name, has, partner[has])

    return _by_key(keyed).mapInArrow(search, "fp binary, other binary")


def roots_of(table: pa.Table) -> np.ndarray:
    return table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()


def marked(nodes: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """key, fp: rows of shards with a partner of another root within the radius. As roots only ever merge, rows
    that are left out here stay out. The rows that are dealt for this are narrow."""
    keyed = cut_hot(nodes.select(F.explode("keys").alias("key"), "fp", "print", "root"), "fp", chunk)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, shard in by_shard(batches):
            has = np.zeros(len(shard), bool)
            for a, b in Forest(prints_of(table), shard).apart(radius, roots_of(table)):
                has[a] = has[b] = True
            yield from table.select(["key", "fp"]).take(pa.array(np.flatnonzero(has))).combine_chunks().to_batches()

    return durable(_by_key(keyed).mapInArrow(mark, "key long, fp binary"))


def candidates(rows: DataFrame, nodes: DataFrame, radius: int, one: bool = False) -> DataFrame:
    """fp, other: of the `marked` rows, every pair of different roots within the radius in a shard that sizes and
    bitmaps don't refute; with `one`, some such partner for each fp that has one in a shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, shard in by_shard(batches, HELD // 8):
            name, partner = table.column("fp").combine_chunks(), np.full(len(shard), -1)
            refuted = Refuted(table.column("size").to_numpy(), table.column("bitmap").to_pylist())
            for a, b in Forest(prints_of(table), shard).apart(radius, roots_of(table)):
                if one:
                    open_ = partner[a] < 0
                    a, b = a[open_], b[open_]
                keep = refuted.keep(a, b)
                if one:
                    partner[a[keep]] = b[keep]
                else:
                    yield from _pairs(name, a[keep], b[keep])
            has = np.flatnonzero(partner >= 0)
            yield from _pairs(name, has, partner[has])

    wide = rows.join(nodes.select("fp", "print", "root", "size", "bitmap"), "fp").select("key", "fp", "print", "root", "size", "bitmap")
    found = _by_key(wide).mapInArrow(search, "fp binary, other binary")
    return found if one else _distinct_pairs(found)


def few_each(found: DataFrame) -> DataFrame:
    """Pairs of each fp and at most FIRST of its partners; of a fp that is the partner of many, all of them stay."""
    some = found.where(F.col("fp") != F.col("other")).groupBy("fp").agg(F.slice(F.collect_set("other"), 1, FIRST).alias("others"))
    return durable(_distinct_pairs(some.select("fp", F.explode("others").alias("other"))))


def _by_key(keyed: DataFrame) -> DataFrame:
    return keyed.repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("key")


def _pairs(name: pa.Array, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(a), 20_000):
        yield pa.RecordBatch.from_arrays([name.take(pa.array(x[lo : lo + 20_000])) for x in (a, b)], names=["fp", "other"])


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("fp") != F.col("other")).select(F.least("fp", "other").alias("fp"), F.greatest("fp", "other").alias("other")).distinct()


def checked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """The pairs whose sets of shingles are similar enough."""
    asked = pairs.select("fp").union(pairs.select("other")).distinct()
    rows = nodes.join(asked, "fp").select(F.col("first.doc_id").alias("doc"), F.col("first.tag").alias("tag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                h = np.unique(shingle_digests(text, shingle))
                yield pa.RecordBatch.from_arrays([pa.array([set_name(h)], pa.binary()), pa.array([h.view(np.int64)], pa.list_(pa.int64()))], names=["fp", "h"])

    texts = docs.select("doc_id", text_tag().alias("own"), "text")
    rows = bounded(durable(rows))
    wanted = texts.join(rows, texts["doc_id"].eqNullSafe(rows["doc"]) & (texts["own"] == rows["tag"]), "left_semi")
    sets = durable(wanted.select("text").mapInArrow(run, "fp binary, h array<long>").dropDuplicates(["fp"]))
    others = sets.select(F.col("fp").alias("other"), F.col("h").alias("h2"))
    both = skew_join(skew_join(pairs, sets, "fp", ["other"], n=None), others, "other", ["fp"], n=None)
    common = F.size(F.array_intersect("h", "h2"))
    union = F.size("h") + F.size("h2") - common
    return durable(both.where(common * SIMILAR[1] >= union * SIMILAR[0]).select("fp", "other"))


def rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` with the root of their component."""
    return durable(nodes.join(connect(links), "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def apart(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose nodes have different roots."""
    roots = nodes.select("fp", "root")
    one = skew_join(pairs, roots, "fp", ["other"], n=None)
    two = skew_join(one.withColumnRenamed("root", "left"), roots.select(F.col("fp").alias("other"), "root"), "other", ["fp"], n=None)
    return durable(two.where(F.col("left") != F.col("root")).select("fp", "other"))


def similar_classes(docs: DataFrame, shingle: int, bits: int, radius: int, band: int, tables: int, chunk: int = CHUNK) -> DataFrame:
    """doc_id, tag, fp, first, as in `classes`, linked by the similarity of sets."""
    sketched = durable(sketches(docs, shingle, bits, band, tables))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    of_set = [F.first(c).alias(c) for c in ("print", "keys", "size", "bitmap")]
    nodes = durable(sketched.groupBy("fp").agg(F.min(row).alias("first"), *of_set, F.count("*").alias("n")))
    links = checked(few_each(partners(nodes, radius, chunk)), docs, nodes, shingle)
    # partners are any within the radius; of those that nothing refutes most are links, so a few of them join large
    # groups, and only then are all pairs named that are still apart
    near = rooted(nodes, links)
    rows = marked(near, radius, chunk)
    links = durable(links.unionByName(checked(few_each(candidates(rows, near, radius, one=True)), docs, nodes, shingle)))
    left = durable(candidates(rows, rooted(nodes, links), radius))
    n, at_once = left.count(), ROUND * nodes.count()
    while n > at_once:  # a share of the pairs, dealt by hash; the others wait for what these join
        share = F.pmod(F.xxhash64("fp", "other"), F.lit(-(-n // at_once))) == 0
        links = durable(links.unionByName(checked(left.where(share), docs, nodes, shingle)))
        left = apart(left.where(~share), rooted(nodes.select("fp"), links))
        n, at_once = left.count(), 4 * at_once
    links = links.unionByName(checked(left, docs, nodes, shingle))
    return named(sketched.select("doc_id", "tag", "fp"), nodes.select("fp", "first", "n"), connect(links))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """One row of each component of `docs`, that with the smallest doc_id, with all its columns."""
    found = similar_classes(docs, **(NEAR | how))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag"))
    own, doc, tag = fresh(docs, "__own", "__doc", "__tag")
    gone = found.where(~stays).select(F.col("doc_id").alias(doc), F.col("tag").alias(tag)).distinct()
    tagged = docs.withColumn(own, text_tag())
    return tagged.join(gone, tagged["doc_id"].eqNullSafe(gone[doc]) & (tagged[own] == gone[tag]), "left_anti").drop(own)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"))
