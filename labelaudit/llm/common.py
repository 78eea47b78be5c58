"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many (narrow) rows.
BROADCAST_ROWS = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="labelaudit-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """`df` as files in the shared folder, and their folder. A checkpoint keeps the estimated size of the plan behind it,
    which for a join is the product of its sides': in a loop of joins its digits multiply with each round until the
    driver's memory is full of them. Files have the size that they have."""
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose row count is checked; a plain join beyond the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def skew_join(rows: DataFrame, table: DataFrame, key: str, spread: list[str], n: str | None = "n", how: str = "inner", least: int = 4_000) -> DataFrame:
    """`rows` with their row of `table`, which has one row a key and in `n` how many of `rows` have that key;
    without `n` they are counted.

    A key of more than a (4 x partitions)-th of the rows, and more than `least`, which is little for one task, is
    cut into pieces of about that many: its row of `table` is repeated, and its rows are spread by `spread` and
    the partition they come from. At most 4 x partitions keys can be so frequent, and only their names are
    broadcast. `n` is dropped.
    """
    counts = table.select(key, F.col(n).alias("__n")) if n else rows.groupBy(key).agg(F.count("*").alias("__n"))
    table = table.drop(n) if n else table
    total, largest = counts.agg(F.sum("__n"), F.max("__n")).first()
    most = max(least, (total or 0) // (4 * partitions(rows.sparkSession)))
    if (largest or 0) <= most:
        return rows.join(table, key, how)
    hot = F.broadcast(counts.where(F.col("__n") > most).select(F.col(key).alias("__hot"), F.ceil(F.col("__n") / most).cast("int").alias("__pieces")))
    piece = F.coalesce(F.pmod(F.xxhash64(F.spark_partition_id(), *spread), F.col("__pieces")).cast("int"), F.lit(0))
    dealt = rows.join(hot, rows[key] == hot["__hot"], "left").withColumn("__piece", piece).drop("__hot", "__pieces")
    pieces = F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))
    repeated = table.join(hot, table[key] == hot["__hot"], "left").withColumn("__piece", pieces).drop("__hot", "__pieces")
    return dealt.join(repeated, [key, "__piece"], how).drop("__piece")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def null_safe_key(name: str) -> Column:
    """A non-null join key that keeps null apart from every string, the empty one included."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("~"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where `df` has such a column already."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out
