"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters, WIDTH bytes
wide, run over every position of a chunk; each filter keeps its largest response in the chunk, and the
chunks' responses are averaged and combined into one probability. A filter on bytes is a sum of table
look-ups, so scoring is one gather per byte of filter width.

The net is fitted on the driver from at most SAMPLE labelled documents (those with the smallest hashes of
their ids), the bound being a parameter, and from all chunks of each. Scores see the text alone. The fit
is seeded, so reruns agree.

Defined cases: null text is the empty text, scored as one chunk of padding; null or contradicting
labels are not learned from; without any label every score is 0.5 and `drop_rejected` rejects nothing;
rows that repeat are scored one by one; very long texts are worked off in blocks of whole chunks; an empty table gives no rows; other
columns are ignored by `score` and kept by `drop_rejected`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelaudit.llm.common import fresh, read

WIDTH = 6
FILTERS = 24
CHUNK = 512
STEP = 384
SAMPLE = 3000
#: Chunks whose responses the fit holds at once.
FIT_CHUNKS = 256
THRESHOLD = 0.7
PAD = 256
#: Bytes worked off at once; a multiple of STEP.
BLOCK = 384 * 128


@dataclass
class Net:
    tables: np.ndarray  # (WIDTH, 257, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (FILTERS,)
    bias: float
    learned: bool = True

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at each start position of `data` (symbols, already padded by WIDTH - 1)."""
        n = len(data) - len(self.tables) + 1
        total = self.tables[0][data[:n]]
        for w in range(1, len(self.tables)):
            total += self.tables[w][data[w : w + n]]
        return total


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover n bytes, each overlapping the one before it."""
    return np.arange(0, max(1, n - (CHUNK - STEP)), STEP)


def scores(net: Net, texts: list[str | None]) -> np.ndarray:
    """A probability for each whole text."""
    total = np.zeros((len(texts), net.out.size))
    count = np.zeros(len(texts))
    pad = np.full(WIDTH, PAD, np.int16)
    parts: list[np.ndarray] = []
    bounds: list[int] = []
    owners: list[int] = []
    at = 0

    def work() -> None:
        nonlocal parts, bounds, owners, at
        if owners:
            best = np.maximum.reduceat(net.responses(np.concatenate([*parts, pad])), bounds, axis=0)[::2]
            np.add.at(total, owners, np.maximum(best + net.shift, 0))
            np.add.at(count, owners, 1)
        parts, bounds, owners, at = [], [], [], 0

    for k, text in enumerate(texts):
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        for first in range(0, max(1, len(data) - (CHUNK - STEP)), BLOCK):
            piece = data[first : first + BLOCK + CHUNK - STEP].astype(np.int16)
            starts = chunk_starts(len(piece)) if first + BLOCK < len(data) - (CHUNK - STEP) else chunk_starts(len(data) - first)
            length, piece = len(piece), np.concatenate([piece, pad])
            for s in starts.tolist():
                bounds += [at + s, at + min(s + CHUNK, length + 1)]
                owners.append(k)
            parts.append(piece)
            at += len(piece)
            if at >= BLOCK:
                work()
    work()
    logit = (total / np.maximum(count, 1)[:, None]) @ net.out + net.bias
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def chunk_rows(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The symbols of the chunks at `starts`, with what their last filter positions reach into."""
    padded = np.full(len(data) + CHUNK + 2 * WIDTH, PAD, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - 1)[starts]


def strongest(net: Net, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response in each chunk, and where it is."""
    flat = net.responses(x.ravel())
    flat = np.concatenate([flat, np.zeros((WIDTH - 1, FILTERS), np.float32)]).reshape(len(x), -1, FILTERS)[:, :CHUNK]
    where = flat.argmax(axis=1)
    return np.take_along_axis(flat, where[:, None], axis=1)[:, 0], where


def fit(texts: list[bytes], label: np.ndarray, epochs: int = 4, batch: int = 64, seed: int = 5) -> Net:
    """Adam on the log loss over all chunks of every text, FIT_CHUNKS at a time."""
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32), np.full(FILTERS, -0.5, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), 0.0
    )
    net.tables[:, PAD] = 0
    if not len(label):
        net.out[:] = 0
        return net
    rate = np.clip(label.mean(), 0.02, 0.98)
    bias = np.array([np.log(rate / (1 - rate))], np.float32)
    params = [net.tables, net.shift, net.out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(label))
        for lo in range(0, len(label), batch):
            docs = shuffled[lo : lo + batch].tolist()
            starts = [chunk_starts(len(texts[d])) for d in docs]
            blocks = [(i, s[k : k + FIT_CHUNKS]) for i, s in enumerate(starts) for k in range(0, len(s), FIT_CHUNKS)]
            best, seen = [], []  # per block of chunks: responses, and the symbols each filter answered to
            for i, s in blocks:
                x = chunk_rows(texts[docs[i]], s)
                high, where = strongest(net, x)
                best.append(high + net.shift)
                seen.append([x[np.arange(len(x))[:, None], where + w] for w in range(WIDTH)])
            high, seg = np.concatenate(best), np.repeat([i for i, _ in blocks], [len(s) for _, s in blocks])
            n = np.array([len(s) for s in starts], np.float32)
            mean = np.zeros((len(docs), FILTERS), np.float32)
            np.add.at(mean, seg, np.maximum(high, 0))
            mean /= n[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ net.out + bias[0], -40, 40)))
            err = ((p - label[docs]) / len(docs)).astype(np.float32)
            back = (err[seg] / n[seg])[:, None] * net.out * (high > 0)
            tables = np.zeros_like(net.tables)
            filters = np.broadcast_to(np.arange(FILTERS), back.shape)
            for w in range(WIDTH):
                np.add.at(tables[w], (np.concatenate([s[w] for s in seen]), filters), back)
            tables[:, PAD] = 0
            grads = [tables, back.sum(axis=0), mean.T @ err + 1e-4 * net.out, np.array([err.sum()], np.float32)]
            step += 1
            for prm, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                prm -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.bias = float(bias[0])
    return net


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """At most `rows` labelled documents outside the held-out part: doc_id, quality and the whole text. Of rows that
    repeat a doc_id, the one whose text has the smallest hash."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
        .where(F.col("quality") == F.col("high"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
    )
    text = F.coalesce("text", F.lit(""))
    # at most `rows` narrow rows are broadcast
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Net:
    sample = sorted((r.doc_id, r.quality, r.text) for r in sample_labelled(docs, labels, rows).collect())
    net = fit([t.encode("utf-8", "replace") for _, _, t in sample], np.array([q for _, q, _ in sample], np.float32))
    net.learned = bool(sample)
    return net


def score(docs: DataFrame, net: Net, keep: list[str], name: str = "score") -> DataFrame:
    """The columns in `keep` and the score."""
    inner = [f"c{i}" for i in range(len(keep))]  # whatever the columns are called

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                values = scores(net, part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(values, pa.float64())], names=[*inner, "score"])

    schema = T.StructType([*(T.StructField(i, docs.schema[c].dataType) for i, c in zip(inner, keep, strict=True)), T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], "text").toDF(*inner, "text").mapInArrow(run, schema).toDF(*keep, name)


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with all their columns; all rows if no labelled
    document was there to learn from."""
    (name,) = fresh(docs, "__score")
    net = train(docs, labels)
    if not net.learned:
        return docs
    return score(docs, net, docs.columns, name).where(F.col(name) >= threshold).drop(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return score(docs, train(docs, labels), ["doc_id"]).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
