"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Sizes are summed by source and hash bucket. The running sums show in which bucket a source's budget
ends; only that bucket is summed again at a finer grain, twice, until the 32-bit hash itself is the
threshold. Rows below the threshold are taken once more than the others; nothing is sorted by row. Targets are
worked out in one task over one row a source, which holds for up to some millions of sources.

Defined cases: null text has size 0; null source is a source of its own and comes last; null doc_id
hashes as the empty string; rows are hashed by id and text, so those that repeat an id with other texts
are taken one by one, and only rows that repeat both are taken alike; a document without words is taken
as often as its whole source; a source of size 0 has target 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelaudit.llm.common import bounded, durable, fresh, null_safe_key, read, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE_PCT = 150
SEED = 29
#: Hash bits kept by each level of histograms, of 32.
LEVELS = (12, 22, 32)


def word_count(text: Column) -> Column:
    """Number of runs of anything but the six ASCII white-space characters."""
    space = r"[\x20\x09-\x0D]"
    pieces = F.size(F.split(text, space + "+"))
    edges = text.rlike(rf"\A{space}").cast("int") + (text.rlike(rf"{space}\z")).cast("int")
    return F.when(text == "", F.lit(0)).when(~text.rlike(rf"[^\x20\x09-\x0D]"), F.lit(0)).otherwise(pieces - edges).cast("long")


def hashed(doc_id: Column, text: Column, seed: int) -> Column:
    """The first 32 bits of an MD5 over seed, id and text, as a long."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, share_pct: int = 150, weights: tuple = WEIGHTS, cap: int = 2) -> DataFrame:
    """src, source_size -> target. The windows are over one row per source, not over documents.

    Sources are filled in the order of cap per weight: one is at its cap if an even level of what is
    left would pass it, and the first that is not fixes the level of all after it.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rn", F.row_number().over(Window.orderBy("src"))).withColumn("w", w.cast("long"))
    lcm = math.lcm(*weights)
    order = Window.orderBy((F.col("source_size") * (F.lit(lcm) / F.col("w"))).cast("long"), "rn")
    everything = Window.partitionBy()
    filled = ranked.withColumns(
        {
            "left_100": F.lit(share_pct) * F.sum("source_size").over(everything)
            - F.lit(100 * cap) * F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "w_left": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "at": F.row_number().over(order),
        }
    ).withColumn("capped", F.col("left_100") * F.col("w") >= F.lit(100 * cap) * F.col("source_size") * F.col("w_left"))
    first = F.min(F.when(~F.col("capped"), F.struct("at", "left_100", "w_left"))).over(everything)
    return filled.withColumn("level", first).select(
        "src",
        "source_size",
        F.when(F.col("level").isNull() | (F.col("at") < F.col("level.at")), (F.col("source_size") * cap).cast("double"))
        .otherwise((F.col("level.left_100") * F.col("w")).cast("double") / (F.col("level.w_left") * 100))
        .alias("target"),
    )


def thresholds(units: DataFrame, goals: DataFrame) -> DataFrame:
    """src -> copies (taken by every row) and h_end, h_last: rows with h < h_end, or h = h_last, are taken once more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goals.select("src", "source_size", "target", copies.alias("copies")).withColumns(
        {"rest": F.col("target") - F.col("copies") * F.col("source_size"), "base": F.lit(0).cast("long"), "cell": F.lit(0).cast("long")}
    )
    bits = 0
    for level in LEVELS:
        inside = bounded(state.select("src", "cell"))
        cells = (
            units.join(inside, "src")
            .where(F.shiftright("h", 32 - bits) == F.col("cell"))
            .groupBy("src", F.shiftright("h", 32 - level).alias("next"))
            .agg(F.sum("size").alias("n"))
        )
        run = Window.partitionBy("src").orderBy("next")
        summed = cells.join(state, "src").withColumn("end", F.sum("n").over(run) + F.col("base"))
        cut = summed.where(F.col("end") > F.col("rest")).groupBy("src").agg(F.min(F.struct("next", "end", "n")).alias("cut"))
        state = durable(
            state.join(cut, "src").select(
                "src", "source_size", "target", "copies", "rest", (F.col("cut.end") - F.col("cut.n")).alias("base"), F.col("cut.next").alias("cell"), F.col("cut.end").alias("end")
            )
        ).select("src", "source_size", "target", "copies", "rest", "base", "cell", "end")
        last, bits = state, level
        state = state.drop("end") if level != LEVELS[-1] else state
    nearer = F.col("end") - F.col("rest") < F.col("rest") - F.col("base")
    return last.select("src", F.col("cell").alias("h_end"), F.when(nearer, F.col("cell")).otherwise(F.lit(-1)).alias("h_last"))


def planned(docs: DataFrame, seed: int, share_pct: int, weights: tuple) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and hashes, and for each source its target, copies and thresholds."""
    units = durable(
        docs.select("doc_id", null_safe_key("source").alias("src"), word_count(text_or_empty()).alias("size"), hashed(F.col("doc_id"), F.col("text"), seed).alias("h"))
    )
    goals = durable(targets(units.groupBy("src").agg(F.sum("size").alias("source_size")), share_pct, weights))
    return units, goals.join(thresholds(units, goals), "src", "left")


def copies_of(plan: str | None, h: Column) -> Column:
    """How often the mix takes a row: what all rows of its source are taken, and once more below the threshold, if
    the source's target leaves a rest."""
    of = lambda c: F.col(f"{plan}.{c}" if plan else c)
    whole = F.when(of("source_size") > 0, F.floor(of("target") / of("source_size"))).otherwise(F.lit(0))
    below = (of("target") > whole * of("source_size")) & ((h < of("h_end")) | (h == of("h_last")))
    return whole + F.coalesce(below, F.lit(False)).cast("long")


def mix(docs: DataFrame, seed: int = SEED, share_pct: int = SHARE_PCT, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken: words the mix takes of each document, repeats counted."""
    units, plan = planned(docs, seed, share_pct, weights)
    n = copies_of(None, F.col("h"))
    return units.join(bounded(plan), "src").select("doc_id", "size", "source_size", "target", (F.col("size") * n).cast("long").alias("taken"), n.cast("int").alias("copies"))


def take(docs: DataFrame, seed: int = SEED, share_pct: int = SHARE_PCT, weights: tuple = WEIGHTS) -> DataFrame:
    """The rows of `docs` the mix takes, with all their columns, as often as it takes them."""
    _, plan = planned(docs, seed, share_pct, weights)
    src, of, n = fresh(docs, "__src", "__plan", "__n")
    ends = plan.select(F.col("src").alias(src), F.struct("source_size", "target", "h_end", "h_last").alias(of))
    joined = docs.withColumn(src, null_safe_key("source")).join(bounded(ends), src)
    copies = copies_of(of, hashed(F.col("doc_id"), F.col("text"), seed))
    repeated = joined.withColumn(n, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


SQL = r"""
WITH u AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('29:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM u GROUP BY source
), w AS (
  SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS w FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size * (6 // w), rn) AS pos FROM w
), f AS (
  SELECT *, (150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_100,
         (sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left
  FROM o
), c AS (SELECT *, left_100 * w >= 200 * source_size * w_left AS capped FROM f),
l AS (SELECT pos AS pos_l, left_100 AS left_l, w_left AS w_l FROM c WHERE NOT capped ORDER BY pos LIMIT 1),
g AS (
  SELECT source, source_size,
         CASE WHEN pos_l IS NULL OR pos < pos_l THEN (2 * source_size)::DOUBLE
              ELSE (left_l * w)::DOUBLE / (w_l * 100)::DOUBLE END AS target
  FROM c LEFT JOIN l ON true
), k AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM g
), r AS (
  SELECT u.doc_id, u.size, k.source_size, k.target, k.base, k.target - k.base * k.source_size AS rest,
         sum(u.size) OVER (PARTITION BY u.source ORDER BY u.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(u.size) OVER (PARTITION BY u.source, u.h) AS cell
  FROM u JOIN k ON u.source IS NOT DISTINCT FROM k.source
), t AS (
  SELECT *, base + CASE WHEN source_size = 0 OR rest <= 0 THEN 0 WHEN upto <= rest THEN 1
                        WHEN upto - cell <= rest AND upto - rest < rest - (upto - cell) THEN 1 ELSE 0 END AS copies
  FROM r
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::INTEGER AS copies FROM t
"""
