"""Exact dedup by skew-safe combining.

Equal texts (after lower-casing A-Z only) are combined in three steps, each of which groups by
digest *and* full text: locally inside a partition (Spark's partial aggregation), then per salted
digest group, then over the winners of the salts. A group that holds a third of all rows is thus at
most one row per partition and salt before anything of it meets in one task. Rows then take the result
of their group; the rows of a group that is hot are split over many tasks.

Defined cases: null text counts as empty, and all empty texts are one group; a null doc_id loses to
every other id and stays only where its whole group has none; rows that repeat a doc_id with an equal
text count in group_size, and `drop_copies` leaves one of them; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.llm.common import durable, fresh, read, skew_join

SALTS = 16


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only; the built-in lower() does just that on pure ASCII text."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct folded text: digest, second digest, n_bytes, keep_id, group_size."""
    folded = docs.select(F.col("doc_id"), fold_case(F.col("text")).alias("folded"))
    salted = folded.select("doc_id", "folded", F.sha2("folded", 256).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    per_salt = salted.groupBy("digest", "salt", "folded").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = per_salt.groupBy("digest", "folded").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return durable(groups.select("digest", F.xxhash64("folded").alias("second"), F.octet_length("folded").alias("n_bytes"), "keep_id", "group_size"))


def named(won: DataFrame) -> DataFrame:
    """The groups with their name; fails where two different texts share one, which then could not be told apart."""
    clash = won.groupBy("digest", "second", "n_bytes").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if clash:
        raise ValueError("two different texts agree in SHA-256, xxHash64 and length")
    return won.withColumn("name", name_of("digest", "second", "n_bytes"))


def name_of(*parts: str) -> Column:
    return F.concat_ws("-", *[F.col(p).cast("string") for p in parts])


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Groups are formed by whole texts. A row finds its group by SHA-256, an independent 64-bit digest and the
    length; that no two groups share these is checked, so it is the group of its very text.
    """
    folded = docs.select(F.col("doc_id"), fold_case(F.col("text")).alias("folded"))
    rows = folded.select("doc_id", F.sha2("folded", 256).alias("text_sha256"), F.xxhash64("folded").alias("second"), F.octet_length("folded").alias("n_bytes"))
    rows = rows.withColumn("name", name_of("text_sha256", "second", "n_bytes")).drop("second", "n_bytes")
    groups = named(winners(docs, salts)).select("name", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("group_size").alias("n"))
    found = skew_join(rows, groups, "name", ["doc_id"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Where rows repeat a doc_id and text, the one whose
    columns have the smallest hash stays."""
    name, win, keep = fresh(docs, "__name", "__win", "__keep")
    best = named(winners(docs, salts)).select(F.col("name").alias(win), F.col("keep_id").alias(keep))
    folded = fold_case(F.col("text"))
    keyed = docs.withColumn(name, F.concat_ws("-", F.sha2(folded, 256), F.xxhash64(folded).cast("string"), F.octet_length(folded).cast("string")))
    # keyed by the id, too: rows of a hot group that go meet nothing, wherever they land
    kept = keyed.join(best, (keyed[name] == best[win]) & keyed["doc_id"].eqNullSafe(best[keep]), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    if not repeated:
        return kept.select(*columns)
    one = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")
    return kept.groupBy("doc_id", name).agg(one).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(folded) AS text_sha256
FROM d WINDOW w AS (PARTITION BY folded)
"""
