"""Importance resampling towards a target: documents drawn by hashed n-gram features and Gumbel noise.

Words are runs of letters and digits, A-Z lower-cased; features are all runs of 1 to N words, hashed into
BUCKETS. One pass sums the buckets over the corpus and over the target texts; a bucket's gain is the
logarithm of its shares, and a second pass sums the gains of a document's features to its weight.
The weights plus seeded noise are ranked, and the highest scores are drawn.

Short texts are worked off where they are read. Texts of more than LONG bytes are split at word
boundaries into chunks of CHUNK words; a chunk carries the N - 1 words that follow it and owns the
features that start at its own words, so each feature is counted once. Chunks are dealt over all tasks, and
counts and weights are summed by document. The histogram has BUCKETS rows, which is what reaches the
driver and goes to the tasks.

Ranks come from a sort by ranges and the row counts of its partitions.

Defined cases: null and empty texts, and texts without words, have no features, weight 0 and are never
drawn; a text of fewer words than N has fewer kinds of features; null doc_id takes the noise of the
empty name and loses ties; rows that repeat are documents of their own; an empty target gives each
bucket the same t of 0; an empty table gives no rows; a word longer than a chunk stays whole; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.llm.common import durable, partitions, read

N = 3
BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN_PCT = 5
SEED = 42
#: Bytes beyond which a text is split, and words of a chunk.
LONG = 32_768
CHUNK = 4_096

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c >= 128 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and anything beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def features(words: list[bytes], own: int, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the features that start at the first `own` words. The checksum of a longer run goes on from that
    of the run one word shorter."""
    crc = list(map(zlib.crc32, words[:own]))
    out = [np.array(crc, np.uint32)]
    spaced = [b" " + w for w in words[1 : own + n - 1]]
    for k in range(n - 1):
        crc = list(map(zlib.crc32, spaced[k : k + own], crc))
        out.append(np.array(crc, np.uint32))
    return np.concatenate(out) % np.uint32(buckets)


def split_words(words: list[bytes], chunk: int = CHUNK, n: int = N) -> Iterator[tuple[list[bytes], int]]:
    """Chunks with the n - 1 words that follow, and how many words are their own."""
    for lo in range(0, len(words), chunk):
        yield words[lo : lo + chunk + n - 1], min(chunk, len(words) - lo)


def is_long(long: int) -> Column:
    return F.coalesce(F.octet_length("text") > long, F.lit(False))


def chunks(docs: DataFrame, long: int = LONG, chunk: int = CHUNK, n: int = N) -> DataFrame:
    """doc_id, digest, place, own, words: the chunks of the long texts, dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, digest, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "text")), strict=True):
                found = list(split_words(words_of(text), chunk, n)) or [([], 0)]  # a document of punctuation alone
                for place, (some, own) in enumerate(found):
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": doc_id, "digest": digest, "place": place, "own": own, "words": b" ".join(some)}], schema=_CHUNK
                    )

    cut = docs.where(is_long(long)).select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("digest"), "text")
    cut = cut.mapInArrow(run, "doc_id long, digest string, place int, own int, words binary")
    return cut.repartition(partitions(docs.sparkSession), "doc_id", "digest", "place")


_CHUNK = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("place", pa.int32()), ("own", pa.int32()), ("words", pa.binary())])


def histogram(docs: DataFrame, n: int = N, buckets: int = BUCKETS, long: int = LONG, chunk: int = CHUNK) -> np.ndarray:
    """Features by bucket over all texts of `docs` (doc_id, text)."""

    def counted(found: Iterator[tuple[list[bytes], int]]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for words, own in found:
            total += np.bincount(features(words, own, n, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted((w, len(w)) for b in batches for t in b.column("text").to_pylist() for w in [words_of(t)])

    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted((w.split(), own) for b in batches for w, own in zip(b.column("words").to_pylist(), b.column("own").to_pylist(), strict=True))

    schema = "bucket int, n long"
    short = docs.where(~is_long(long)).select("text").mapInArrow(of_texts, schema)
    both = short.union(chunks(docs, long, chunk, n).select("words", "own").mapInArrow(of_chunks, schema))
    out = np.zeros(buckets, np.int64)
    for r in both.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of a bucket's smoothed share in the target over that in the corpus."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    s_sum, t_sum = float(s_all + buckets), float(t_all + buckets)
    ratios = ((float(t) + 1) * s_sum / ((float(s) + 1) * t_sum) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = N, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document."""
    buckets = len(gain)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                out = []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    found = features(words, len(words), n, buckets)
                    out.append((len(words), len(found), int(gain[found].sum())))
                sums = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *sums], names=["doc_id", "n_words", "n_features", "weight"])

    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, own in zip(batch.column("words").to_pylist(), batch.column("own").to_pylist(), strict=True):
                found = features(words.split(), own, n, buckets)
                out.append((own, len(found), int(gain[found].sum())))
            if out:
                sums = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                columns = [batch.column(c) for c in ("doc_id", "digest", "place")]
                yield pa.RecordBatch.from_arrays([*columns, *sums], names=["doc_id", "digest", "place", "n_words", "n_features", "weight"])

    sums = "n_words long, n_features long, weight long"
    ids = F.col("doc_id").cast("long").alias("doc_id")
    short = docs.where(~is_long(long)).select(ids, "text").mapInArrow(of_texts, f"doc_id long, {sums}")
    pieces = chunks(docs, long, chunk, n).mapInArrow(of_chunks, f"doc_id long, digest string, place int, {sums}")
    # rows that repeat an id and a text are summed together, and given back as many as they were
    whole = pieces.groupBy("doc_id", "digest").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")], F.sum((F.col("place") == 0).cast("int")).alias("rows"))
    each = whole.select("doc_id", *[F.expr(f"{c} div rows").alias(c) for c in ("n_words", "n_features", "weight")], F.explode(F.expr("array_repeat(0, int(rows))")).alias("__r"))
    return short.unionByName(each.drop("__r"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256 over seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, pct: int = DRAWN_PCT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the highest scores of the documents with enough words have a rank."""
    spark = scored.sparkSession
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "nth"]
    keyed = scored.withColumns({"fit": F.col("n_words") >= least, "nth": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = durable(ranged.select("doc_id", "n_features", "weight", "score", "fit", F.spark_partition_id().alias("part")))
    # a row a partition
    counts = sorted(placed.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("fit").cast("long")).alias("fit")).collect(), key=lambda r: r.part)
    before, n = [], 0
    for r in counts:
        before.append((r.part, n))
        n += r.n
    most = pct * sum(r.fit for r in counts) // 100
    table = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's place in its sorted partition
    rank = F.col("before") + F.col("within") + 1
    ranked = placed.withColumn("within", within).join(table, "part")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= most), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, n: int = N, buckets: int = BUCKETS, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """`drawn` of the documents, by how much likelier their features are among the texts of `target`."""
    corpus = histogram(docs.select("doc_id", "text"), n, buckets, long, chunk)
    wanted = histogram(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets, long, chunk)
    weighed = weights(docs.select("doc_id", "text"), gains(corpus, wanted), n, long, chunk)
    scored = durable(weighed.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")))
    return drawn(scored)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH RECURSIVE t(i, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM t WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
w AS (
  SELECT row_number() OVER () AS row, 0 AS kind, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
  UNION ALL
  SELECT -1, 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), f AS (
  SELECT row, kind, unnest(list_concat(words,
           list_transform(range(1, len(words)::BIGINT), lambda i: words[i] || ' ' || words[i + 1]),
           list_transform(range(1, len(words)::BIGINT - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS feature
  FROM w
), g AS (SELECT row, kind, feature, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT DISTINCT feature FROM g),
b AS (
  SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: ('0x' || x)::BIGINT)),
         lambda s, x: xor(tab[(xor(s, x) & 255) + 1], s >> 8))) % 10000 AS bucket
  FROM o, crc
), c AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM g JOIN b USING (feature) GROUP BY bucket
), a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
e AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM c, a),
x AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM g JOIN b USING (feature) JOIN e USING (bucket) WHERE kind = 0 GROUP BY row),
z AS (
  SELECT row, doc_id, len(words) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN x USING (row) WHERE kind = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) FILTER (fit) OVER () AS fits FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND rank <= 5 * fits // 100 THEN rank END AS rank FROM r
"""
