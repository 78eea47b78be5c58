"""Sharding by proportional stratified interleaving; law `rows`.

Rows are ranked in a seeded shuffle inside their source, sorted by fractional rank
(rank - 1/2) / rows of the source, and the order is cut into equal runs. Any run of it holds every
source in its share of the whole, to within about one row, so each shard repeats the mixture.

Neither order is made by one task: rows are counted by (source, hash bucket), then by bucket of the
fractional rank; offsets come from running sums over those counts and only rows of one bucket are
sorted together. A source with a third of all rows is split over all its buckets.
The method knows no groups, so equal texts may part.

Defined cases: null text has size 1 and the CRC of the empty text; null source is a stratum of its
own; null doc_id is hashed as the empty string, with its text's CRC, and comes first among equal hashes; rows that repeat are placed one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelaudit.llm.common import BROADCAST_ROWS, null_safe_key, read, text_or_empty

#: Buckets of either order at least, and rows of a bucket on average where that makes more.
BUCKETS = 4096
BUCKET_ROWS = 100_000
HASH_BITS = 52
SEED = 17


def shuffled_key(seed: int, *parts: Column) -> Column:
    """The first 52 bits of an MD5 over the seed and the parts, as a long."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; counts per shard differ by one at most."""
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        null_safe_key("source").alias("src"),
        shuffled_key(seed, F.col("doc_id"), F.crc32(text.cast("binary"))).alias("h"),
    )
    buckets = buckets or max(BUCKETS, docs.count() // BUCKET_ROWS)
    # a bucket is a range of hashes, so the order does not depend on how many there are
    rows = rows.withColumn("b", F.floor(F.col("h") / (2.0**HASH_BITS / buckets)).cast("long"))

    counts = rows.groupBy("src", "b").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("src")
    before = by_source.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "src", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(by_source).alias("n_src")
    )
    within = Window.partitionBy("src", "b").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.join(offsets, ["src", "b"]).withColumn("rank", F.row_number().over(within) + F.col("skip"))
    placed = ranked.withColumn("f", (F.col("rank") - 0.5) / F.col("n_src")).withColumn(
        "fb", F.least(F.floor(F.col("f") * buckets), F.lit(buckets - 1)).cast("long")
    )
    return _cut(placed, shards, buckets)


def _cut(placed: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Number the rows by fractional rank, bucket by bucket, and cut the numbers into equal runs."""
    counts = placed.groupBy("fb").agg(F.count("*").alias("n"))
    before = Window.orderBy("fb").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    offsets = counts.select(
        "fb", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip_f"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    order = Window.partitionBy("fb").orderBy("f", "src", "h", "doc_id", "text_crc32", "size")
    offsets = F.broadcast(offsets) if buckets <= BROADCAST_ROWS else offsets  # a row a bucket
    at = placed.join(offsets, "fb").withColumn("at", F.row_number().over(order) + F.col("skip_f") - 1)
    shard = F.expr(f"(at * {shards}) div total")
    start = F.expr(f"(((at * {shards}) div total) * total + {shards - 1}) div {shards}")
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("at") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE t(i, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM t WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (
  SELECT doc_id, coalesce('=' || source, '~') AS src, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents
), c AS (
  SELECT doc_id, src, size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, b: xor(tab[(xor(s, b) & 255) + 1], s >> 8))) AS text_crc32
  FROM d, crc
), h AS (
  SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32::VARCHAR), 1, 13))::BIGINT AS h FROM c
), k AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id NULLS FIRST, text_crc32, size) AS rank, count(*) OVER (PARTITION BY src) AS n FROM h
), a AS (
  SELECT *, row_number() OVER (ORDER BY (rank - 0.5::DOUBLE) / n, src, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM k
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, ((pos * 8) // total)::INTEGER AS shard,
       (pos - (((pos * 8) // total) * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM a
"""
