"""Joins and sorts that hold up where one key has a large share of all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many (narrow) rows.
BROADCAST_ROWS = 100_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only on a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="labelaudit-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """`df` as a reliable checkpoint: computed once, and not again when executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` as files in the shared folder: what many rows repeat takes little room there, unlike in a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def at_most(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def keyed_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", heavy: int = 100_000, wide: bool = False) -> DataFrame:
    """`rows` with the rows of `table` that have their key.

    A table of at most BROADCAST_ROWS rows goes to the rows, but not one of `wide` rows, whose number says little of what
    the driver would hold. Otherwise keys of more than `heavy` rows, of which there
    can be few, are cut into numbered pieces; their rows of `table` go to each piece.
    """
    if wide:
        table = table.hint("merge")
    elif at_most(table):
        return rows.join(F.broadcast(table), key, how)
    hot = rows.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n")).where(F.col("__n") > heavy)
    hot = durable(hot.select("__hot", F.ceil(F.col("__n") / heavy).cast("int").alias("__pieces")))
    if not hot.limit(1).count():
        return rows.join(table, key, how)
    hot = F.broadcast(hot)  # no more keys than rows / heavy
    piece = F.pmod(F.monotonically_increasing_id(), F.coalesce("__pieces", F.lit(1)).cast("long")).cast("int")
    dealt = rows.join(hot, rows[key] == hot["__hot"], "left").withColumn("__piece", piece).drop("__hot", "__pieces")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))
    copied = table.join(hot, table[key] == hot["__hot"], "left").withColumn("__piece", each).drop("__hot", "__pieces")
    return dealt.join(copied, [key, "__piece"], how).drop("__piece")
