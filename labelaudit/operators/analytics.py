"""Dashboards, distributions, trends, top lists and searches over audits.

Everything is one or two hash aggregations with partial sums; the row counts of days, risks and
categories bound what is sorted. Ties are broken by the key. `as_of` stands for now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelaudit.operators.joins import durable


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _since(as_of: str, days: int) -> Column:
    return F.col("created_at") >= _now(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def mean(x: str = "compliance_score", digits: int = 1) -> Column:
    """Average, zero of nothing, rounded half up on six exact decimals, so the order of adding is no matter."""
    return F.round(F.coalesce(F.avg(x), F.lit(0.0)).cast("decimal(18,6)"), digits).cast("double")


def dashboard(audits: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    critical = F.size(F.filter("violations", lambda v: v["severity"] == "critical"))
    today = F.col("created_at") >= F.to_date(_now(as_of)).cast("timestamp_ntz")
    return audits.where(_since(as_of, days)).agg(
        F.count("*").alias("total_audits"),
        F.count_if(F.col("risk_level") == "compliant").alias("compliant"),
        F.count_if(F.col("risk_level") != "compliant").alias("non_compliant"),
        mean().alias("average_score"),
        F.coalesce(F.sum(critical), F.lit(0)).alias("critical_violations"),
        F.count_if(today).alias("audits_today"),
    )


def score_trend(audits: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """The last up to seven calendar days, empty ones included, newest first."""
    n = min(days, 7)
    spark = audits.sparkSession
    last = F.to_date(_now(as_of))
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, n - 1), last)).alias("day"))
    start = F.date_sub(last, n - 1).cast("timestamp_ntz")
    daily = audits.where(F.col("created_at") >= start).groupBy(F.to_date("created_at").alias("day")).agg(mean().alias("avg_score"), F.count("*").alias("n"))
    return calendar.join(daily, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("date"), F.coalesce("avg_score", F.lit(0.0)).alias("average_score"), F.coalesce("n", F.lit(0)).alias("count"))


def distribution(audits: DataFrame, by: str) -> DataFrame:
    return audits.groupBy(F.coalesce(by, F.lit("unknown")).alias(by)).agg(F.count("*").alias("count"))


def exploded(audits: DataFrame) -> DataFrame:
    """One row per violation."""
    return audits.select("audit_id", "category", "seller_id", "risk_level", "created_at", F.explode("violations").alias("v")).select("audit_id", "category", "seller_id", "risk_level", "created_at", "v.*")


def top_violations(audits: DataFrame, k: int = 10, key: Column | None = None) -> DataFrame:
    key = F.col("rule_name") if key is None else key
    return exploded(audits).groupBy(key.alias("violation")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "violation").limit(k)


def summary(audits: DataFrame) -> DataFrame:
    return audits.agg(
        F.count("*").alias("total_audits"),
        mean().alias("average_score"),
        F.min("compliance_score").alias("min_score"),
        F.max("compliance_score").alias("max_score"),
        F.count_if(F.col("risk_level") == "compliant").alias("compliant_count"),
        F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk_count"),
        F.coalesce(F.sum(F.size("violations")), F.lit(0)).alias("total_violations"),
    )


def violation_report(audits: DataFrame, examples: int = 3) -> DataFrame:
    """Per rule: how often, and the first examples by audit. Only numbered examples are gathered. The violations,
    three short columns, are worked out once."""
    v = durable(exploded(audits).select("rule_name", "audit_id", "message"))
    counts = v.groupBy("rule_name").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("rule_name").orderBy("audit_id", "message"))
    kept = v.withColumn("rn", rank).where(F.col("rn") <= examples)
    shown = kept.groupBy("rule_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "audit_id"))), lambda x: x["audit_id"]), ",").alias("examples"))
    return counts.join(shown, "rule_name")


def trends(audits: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per day that has audits; all three measures."""
    return (
        audits.where(_since(as_of, days))
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date"))
        .agg(mean().alias("average_score"), F.sum(F.size("violations")).alias("violations"), F.count("*").alias("audits"))
    )


def timeline(audits: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return (
        audits.where(_since(as_of, days))
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date"))
        .agg(F.count("*").alias("total"), F.count_if(F.col("risk_level") == "compliant").alias("compliant"), mean().alias("average_score"))
    )


def grouped_counts(frame: DataFrame, dims: list[str]) -> DataFrame:
    """The total and a count per value of each dimension, in one pass."""
    g = frame.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(F.count("*").alias("count"), F.grouping_id().alias("gid"))
    full = (1 << len(dims)) - 1
    kind, value = F.when(F.col("gid") == full, "total"), F.when(F.col("gid") == full, "all")
    for i, d in enumerate(dims):
        bit = full ^ (1 << (len(dims) - 1 - i))
        kind, value = kind.when(F.col("gid") == bit, d), value.when(F.col("gid") == bit, F.coalesce(F.col(d).cast("string"), F.lit("unknown")))
    return g.select(kind.alias("dimension"), value.alias("value"), "count")


def service_stats(audits: DataFrame) -> DataFrame:
    g = audits.groupingSets([[F.col("risk_level")], [F.col("category")], []], "risk_level", "category").agg(F.count("*").alias("count"), mean().alias("average_score"), F.grouping_id().alias("gid"))
    return g.select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "risk_level").otherwise("category").alias("dimension"),
        F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, F.coalesce("risk_level", F.lit("unknown"))).otherwise(F.coalesce("category", F.lit("unknown"))).alias("value"),
        "count",
        "average_score",
    )


# Words that put a product into a category, in the order they are tried.
INFERRED = (
    ("Food - Edible Oil", ("oil", "ghee", "cooking")),
    ("Electronics", ("mobile", "phone", "laptop", "charger", "electronic")),
    ("Cosmetics", ("cream", "lotion", "shampoo", "soap", "cosmetic")),
    ("Beverages", ("juice", "drink", "water", "beverage")),
    ("Imported Goods", ("imported", "foreign")),
    ("Food - Packaged", ("food", "snack", "biscuit", "noodle")),
)


def infer_category(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    out = None
    for name, words in INFERRED:
        hit = low.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def category_stats(audits: DataFrame, risk: str = "legacy_risk", score: str = "compliance_score", by: Column | None = None) -> DataFrame:
    """Per inferred category; whatever is neither compliant nor moderate counts as high."""
    by = infer_category(F.col("product_name")) if by is None else by
    compliant = F.count_if(F.col(risk) == "Compliant")
    moderate = F.count_if(F.col(risk) == "Moderate Risk")
    return audits.groupBy(by.alias("category")).agg(
        F.count("*").alias("total"),
        compliant.alias("compliant"),
        moderate.alias("moderate"),
        (F.count("*") - compliant - moderate).alias("high_risk"),
        mean(score).alias("average_score"),
        F.round(compliant / F.count("*") * 100, 1).alias("compliance_rate"),
    )


# The risk buckets of the legacy analytics.
RISKS = ("Compliant", "Moderate Risk", "High Risk")


def fixed_risk_distribution(audits: DataFrame, risk: str = "legacy_risk") -> DataFrame:
    """Three buckets, also when empty; unknown labels are left out, missing ones are high."""
    names = audits.sparkSession.createDataFrame([(r,) for r in RISKS], "risk string")
    counts = audits.groupBy(F.coalesce(F.col(risk), F.lit("High Risk")).alias("risk")).agg(F.count("*").alias("n"))
    return names.join(counts, "risk", "left").select("risk", F.coalesce("n", F.lit(0)).alias("count"))


def legacy_stats(audits: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent of message, else code, else a fixed name."""
    key = F.coalesce(F.when(F.col("message") != "", F.col("message")), F.when(F.col("rule_id") != "", F.col("rule_id")), F.lit("Unknown Violation"))
    return top_violations(audits, k, key)


def violation_key(v: Column | None = None) -> Column:
    """rule: message of a violation, given as a struct or as columns."""
    of = lambda c: v[c] if v is not None else F.col(c)
    return F.concat(F.coalesce(of("rule_id"), F.lit("unknown")), F.lit(": "), F.coalesce(of("message"), of("rule_name"), F.lit("Unknown")))


def violation_trends(audits: DataFrame, k: int = 10) -> DataFrame:
    return top_violations(audits, k, violation_key())


def analytics_summary(audits: DataFrame, k: int = 10, risk: str = "legacy_risk") -> DataFrame:
    """block, item, count: the three risk buckets, the categories and the k most frequent violations, from one
    aggregation over all of them."""
    pair = lambda block, item: F.struct(F.lit(block).alias("block"), item.alias("item"))
    fixed = F.array(pair("risk", F.coalesce(risk, F.lit("High Risk"))), pair("category", F.coalesce("category", F.lit("unknown"))))
    counted = audits.select(F.inline(F.concat(fixed, F.transform("violations", lambda v: pair("violation", violation_key(v)))))).groupBy("block", "item").agg(F.count("*").alias("count"))
    empty = audits.sparkSession.createDataFrame([("risk", r, 0) for r in RISKS], "block string, item string, count long")
    whole = counted.unionByName(empty).groupBy("block", "item").agg(F.sum("count").alias("count")).where((F.col("block") != "risk") | F.col("item").isin(*RISKS))
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("count"), "item"))  # a row for each item of a block
    return whole.withColumn("rn", rank).where((F.col("block") != "violation") | (F.col("rn") <= k)).drop("rn")


def shares(counts: DataFrame) -> DataFrame:
    """Share of the total, rounded half up, and of the largest, over rows of few groups."""
    everything = Window.partitionBy()
    total, most = F.sum("count").over(everything), F.max("count").over(everything)
    return counts.withColumns({"share_pct": F.floor(F.col("count") / total * 100 + 0.5).cast("long"), "bar_pct": F.floor(F.col("count") / most * 100 + 0.5).cast("long")})


# --- selection ---------------------------------------------------------------------------------------------


def filter_reports(audits: DataFrame, audit_ids=None, start=None, end=None, category=None, risk=None) -> DataFrame:
    """Every option that is set holds; both ends of the period are included."""
    for name, test in (
        (audit_ids, lambda v: F.col("audit_id").isin(*v)),
        (start, lambda v: F.col("created_at") >= F.lit(v).cast("timestamp_ntz")),
        (end, lambda v: F.col("created_at") <= F.lit(v).cast("timestamp_ntz")),
        (category, lambda v: F.col("category") == v),
        (risk, lambda v: F.col("risk_level") == v),
    ):
        audits = audits.where(test(name)) if name else audits
    return audits


def search(audits: DataFrame, risk=None, low=None, high=None, seller=None, start=None, end=None, words=None, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of matching audits, newest first, each with the total; audits without a date pass any period."""
    created = F.col("created_at")
    for value, test in (
        (risk, lambda v: F.col("risk_level") == v),
        (low, lambda v: F.col("compliance_score") >= v),
        (high, lambda v: F.col("compliance_score") <= v),
        (seller, lambda v: F.col("seller_id") == v),
        (start, lambda v: created.isNull() | (created >= F.lit(v).cast("timestamp_ntz"))),
        (end, lambda v: created.isNull() | (created <= F.lit(v).cast("timestamp_ntz"))),
        (words, lambda v: F.contains(F.lower("product_name"), F.lit(v.lower()))),
    ):
        audits = audits.where(test(value)) if value is not None else audits
    matched = durable(audits)  # worked out once, for the total and the page
    return page(matched, skip, min(limit, 500)).withColumn("total", F.lit(matched.count()).cast("long"))


def page(audits: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    return audits.orderBy(F.desc("created_at"), "audit_id").offset(skip).limit(limit)


def contains_any(audits: DataFrame, words: str) -> DataFrame:
    low = words.lower()
    return audits.where(F.coalesce(F.contains(F.lower("product_name"), F.lit(low)), F.lit(False)) | F.coalesce(F.contains(F.lower("seller_id"), F.lit(low)), F.lit(False)))
