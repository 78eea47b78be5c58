"""Crawl queues: upsert, de-duplicated priority order, statistics, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str, first: bool = False) -> DataFrame:
    """Upsert as a fold: the last row of each key, or the first, combined inside each task before it moves."""
    pick = F.min_by if first else F.max_by
    return rows.groupBy(F.col(key).alias("__key")).agg(pick(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def normal_url(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def first_seen(jobs: DataFrame, url: str = "url", order: str = "job_id") -> DataFrame:
    """Each address once, by its first row; later ones were seen before."""
    return latest(jobs.withColumn(url, normal_url(F.col(url))), url, order, first=True)


def unseen(jobs: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    return jobs.join(seen.select(url).distinct(), url, "left_anti")


def priority_order(jobs: DataFrame, n: int, order: str = "job_id") -> DataFrame:
    """The head of the queue: highest priority first, earlier arrivals before later ones."""
    return first_seen(jobs, order=order).orderBy(F.desc("priority"), order).limit(n)


def bounded_queue(jobs: DataFrame, size: int, evict_highest: bool = False, order: str = "job_id") -> DataFrame:
    """What a queue of `size` keeps of jobs that all arrive before any leaves: the highest priorities, or
    with `evict_highest` the lowest, as the queue that this follows did."""
    by = F.asc("priority") if evict_highest else F.desc("priority")
    return first_seen(jobs, order=order).orderBy(by, order).limit(size)


def arriving_queue(jobs: DataFrame, size: int, evict_highest: bool = True, order: str = "job_id") -> DataFrame:
    """What a queue of `size` holds after jobs have come one by one, each address once: a job that finds it full drives out
    one of the highest priority, the latest of these, or with `evict_highest` false one of the lowest.

    The newcomer itself stays until the next one comes. So each arrival leaves, of all before it, the `size` - 1
    that are last to be driven out, and the end state is these and the last arrival, without a walk through the jobs.
    """
    come = first_seen(jobs, order=order)
    last = come.agg(F.max(order).alias("__last"))
    seen = come.join(F.broadcast(last))  # one row
    stays = [F.asc("priority") if evict_highest else F.desc("priority"), F.asc(order)]
    before = seen.where(F.col(order) < F.col("__last")).orderBy(*stays).limit(size - 1)
    return before.unionByName(seen.where(F.col(order) == F.col("__last"))).drop("__last")


def stats(jobs: DataFrame) -> DataFrame:
    names = ("pending", "processing", "completed", "failed")
    return jobs.agg(*[F.count_if(F.col("status") == n).alias(n) for n in names], F.count_if(F.col("status").isin(*names)).alias("total"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are not unique, and how often each occurs."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def keyword_quota(found: DataFrame, keywords: int, most: int) -> DataFrame:
    """keyword, url, seq: at most max(2, most // keywords) of each keyword, each address once, `most` in all."""
    quota = max(2, most // keywords)
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy("seq"))
    kept = found.withColumn("rn", rank).where(F.col("rn") <= quota).drop("rn")
    return latest(kept, "url", "seq", first=True).orderBy("seq").limit(most)
