"""The analytics that make sense on streams, with state that does not grow with time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_trend(audits: DataFrame, delay: str = "1 day") -> DataFrame:
    """Audits and mean score per day of an audit stream; a day closes once the watermark has passed it."""
    days = audits.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day"))
    return days.agg(F.count("*").alias("audits"), F.avg("compliance_score").alias("average_score")).select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "audits", "average_score")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))


def first_urls(jobs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each address once; it is remembered as long as the watermark lasts."""
    return jobs.withWatermark("created_at", delay).withColumn("url", F.rtrim("url", F.lit("/"))).dropDuplicatesWithinWatermark(["url"])


def rate_limited(hits: DataFrame, limit: int, seconds: int, delay: str = "1 hour") -> DataFrame:
    """key, seq, allowed of a stream of key, seq, ts: a window opens at a key's first hit. State per key: when it
    opened and how many hits it has taken; it is dropped once the watermark is ten windows past the last hit.
    Hits that come more than `delay` late are left out."""

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used, last = *(state.get if state.exists else (None, 0)), 0
        for frame in frames:
            frame = frame.sort_values(["ts", "seq"])
            allowed = []
            for ts in frame["ts"].astype("datetime64[us]").astype("int64").tolist():
                if opened is None or ts - opened >= seconds * 1_000_000:
                    opened, used = ts, 0
                used, last = used + 1, max(last, ts)
                allowed.append(used <= limit)
            yield pd.DataFrame({"key": frame["key"], "seq": frame["seq"], "allowed": allowed})
        state.update((opened, used))
        state.setTimeoutTimestamp(last // 1000 + 10_000 * seconds)

    timed = hits.withWatermark("ts", delay).groupBy("key")
    return timed.applyInPandasWithState(fold, "key long, seq long, allowed boolean", "opened long, used int", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_into(path: str, key: str, order: str, buckets: int = 64):
    """A foreachBatch sink that keeps the last row of each key under `path`.

    Rows are kept by buckets of the key's hash, and a batch writes a new version of the buckets it touches, no
    others; versions go on from those an earlier run has left, and a batch that runs twice changes nothing.
    `files.versioned` reads the state."""
    from labelaudit.sources import files

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        last = last.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in last.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        held = files.version_folders(spark, path)
        before = [folder for bucket, (_, folder) in held.items() if bucket in touched]
        if before:
            old = spark.read.parquet(*before).select(*batch.columns).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            last = files.upsert(old, last, key, order)
        version = 1 + max((v for v, _ in held.values()), default=-1)
        last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={version}")
        files.drop_versions(spark, path, held, touched, version - 1)

    return write
