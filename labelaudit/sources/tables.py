"""Tables, and the label listings derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every time-dependent result is taken as of this moment: one day after the last order.
AS_OF = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task takes where each costs much work.
TASK_ROWS = 30_000


def spread(df: DataFrame) -> DataFrame:
    """Deal a table over tasks of some TASK_ROWS rows, over all cores at least, before per-row work: neither the number
    of a table's files nor that of their row groups says how much a task gets. Counting reads the files' footers only."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product listing with a label text for each order; part, supplier and nation are dimensions."""
    o, p, s, n, r = (table(spark, sf_dir, t) for t in ("orders", "part", "supplier", "nation", "region"))
    o, k = spread(o), F.col("o_orderkey")
    # Only the remainders can meet an order, so the sides are small whatever the tables' size; shuffled by so few keys,
    # all listings would lie in as few tasks.
    p, s = p.where(F.abs("p_partkey") < 200), s.where(F.abs("s_suppkey") < 10)
    made = s.join(n, n["n_nationkey"] == s["s_nationkey"]).join(r, r["r_regionkey"] == n["n_regionkey"])
    joined = o.join(F.broadcast(p), p["p_partkey"] == k % 200).join(F.broadcast(made), s["s_suppkey"] == k % 10)
    digits = lambda x, w: F.lpad(x.cast("string"), w, "0")
    month = F.date_format("o_orderdate", "MMMM yyyy")
    line = lambda when, *parts: F.when(when, F.concat(*parts)) if when is not None else F.concat(*parts)
    text = F.concat_ws(
        "\n",
        line(None, F.lit("Product Type: "), "p_name"),
        line(k % 5 != 0, F.lit("MRP Rs. "), F.col("p_retailprice").cast("decimal(12,2)").cast("string")),
        line(k % 7 != 0, F.lit("Net Wt: "), (F.col("p_size") * 10).cast("string"), F.lit(" g")),
        line(k % 3 != 0, F.lit("FSSAI Lic No. "), digits(k % 41 + 1, 2), (k % 5 + 1).cast("string"), digits(k, 11)),
        line(k % 6 != 0, F.lit("MFG "), month),
        line(k % 11 != 0, F.lit("Best Before: "), month),
        line(None, F.lit("Batch No: B"), digits(k, 6)),
        line(None, F.lit("Manufacturer: "), "s_name"),
        line(k % 9 != 0, F.lit("Made in "), "r_name"),
    )
    return joined.select(
        k.alias("k"),
        F.concat(F.lit("audit_"), digits(k, 8)).alias("audit_id"),
        F.col("s_name").alias("seller_id"),
        F.col("p_name").alias("product_name"),
        F.element_at(F.array(*[F.lit(c) for c in ("food", "electronics", "cosmetics", "general")]), (k % 4 + 1).cast("int")).alias("category"),
        F.col("o_orderdate").alias("created_at"),
        text.alias("label_text"),
    )


LISTINGS_SQL = """
listings AS (
  SELECT o_orderkey AS k, 'audit_' || lpad(o_orderkey::VARCHAR, 8, '0') AS audit_id, s_name AS seller_id, p_name AS product_name,
         ['food', 'electronics', 'cosmetics', 'general'][o_orderkey % 4 + 1] AS category, o_orderdate AS created_at,
         concat_ws(chr(10),
           'Product Type: ' || p_name,
           CASE WHEN o_orderkey % 5 <> 0 THEN 'MRP Rs. ' || p_retailprice::DECIMAL(12,2)::VARCHAR END,
           CASE WHEN o_orderkey % 7 <> 0 THEN 'Net Wt: ' || (p_size * 10)::VARCHAR || ' g' END,
           CASE WHEN o_orderkey % 3 <> 0 THEN 'FSSAI Lic No. ' || lpad((1 + o_orderkey % 41)::VARCHAR, 2, '0') || (1 + o_orderkey % 5)::VARCHAR || lpad(o_orderkey::VARCHAR, 11, '0') END,
           CASE WHEN o_orderkey % 6 <> 0 THEN 'MFG ' || strftime(o_orderdate, '%B %Y') END,
           CASE WHEN o_orderkey % 11 <> 0 THEN 'Best Before: ' || strftime(o_orderdate, '%B %Y') END,
           'Batch No: B' || lpad(o_orderkey::VARCHAR, 6, '0'),
           'Manufacturer: ' || s_name,
           CASE WHEN o_orderkey % 9 <> 0 THEN 'Made in ' || r_name END) AS label_text
  FROM orders JOIN part ON p_partkey = o_orderkey % 200 JOIN supplier ON s_suppkey = o_orderkey % 10
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
)"""
