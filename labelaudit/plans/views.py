"""The views most queries start from, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.functions import duck, text
from labelaudit.operators import audits as A
from labelaudit.operators import rules as R
from labelaudit.operators import scoring as S
from labelaudit.sources.tables import AS_OF, LISTINGS_SQL, listings, table


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_fields(listings(spark, sf_dir))


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit(fields(spark, sf_dir), AS_OF).withColumn("legacy_risk", S.legacy_risk(F.col("compliance_score")))


def violating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audits that can have violations: of listings to which some rule applies, known before any extraction."""
    some = listings(spark, sf_dir).where(R.any_applies(R.DEFAULT_RULES, F.col("category")))
    return A.audit(A.with_fields(some), AS_OF)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl jobs made of events."""
    status = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "error", "failed").otherwise("completed")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"),
        F.concat(F.lit("http://shop"), (F.col("user_id") % 50).cast("string")).alias("url"),
        (F.col("event_id") % 10 + 1).cast("int").alias("priority"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
    )


JOBS = """
jobs AS (
  SELECT event_id AS job_id, 'http://shop' || (user_id % 50)::VARCHAR AS url, (1 + event_id % 10)::INTEGER AS priority,
         CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
         ts AS created_at
  FROM events
)"""

LISTINGS = "WITH " + LISTINGS_SQL
FIELDS = LISTINGS + "," + duck.entities_cte(text=text.sql_normalise("label_text"))
_PASSED = "((fssai IS NOT NULL)::INT + coalesce(regexp_matches(fssai, '^[0-9]{14}$'), false)::INT + (expiry_date IS NOT NULL)::INT + (net_weight IS NOT NULL)::INT)"
_THERE = " + ".join(f"({f} IS NOT NULL)::INT" for f in A.FIELDS)
AUDITS = (
    FIELDS
    + f""",
scored AS (
  SELECT *, CASE WHEN category = 'food' THEN 4 ELSE 0 END AS total_rules, CASE WHEN category = 'food' THEN {_PASSED} ELSE 0 END AS passed,
         CASE WHEN category = 'food' THEN {_PASSED} / 4.0 * 100 ELSE ({_THERE}) / 7.0 * 100 END::DOUBLE AS score
  FROM entities
),
v AS (
  SELECT audit_id, category, seller_id, created_at, r.rule_no, r.rule_id, r.rule_name, r.severity, r.message
  FROM scored, (VALUES (1, 'rule_000001', 'FSSAI Number Required', 'critical', 'FSSAI license number is missing'),
                       (2, 'rule_000002', 'FSSAI Format Validation', 'high', 'FSSAI number format is invalid'),
                       (4, 'rule_000004', 'Expiry Date Required', 'critical', 'Expiry date is missing'),
                       (5, 'rule_000005', 'Net Weight Required', 'high', 'Net weight/quantity is missing')) r(rule_no, rule_id, rule_name, severity, message)
  WHERE category = 'food' AND CASE r.rule_no WHEN 1 THEN fssai IS NULL WHEN 2 THEN NOT coalesce(regexp_matches(fssai, '^[0-9]{{14}}$'), false)
                                             WHEN 4 THEN expiry_date IS NULL ELSE net_weight IS NULL END
),
vc AS (SELECT audit_id, count(*) AS n_violations, count(*) FILTER (severity = 'critical') AS n_critical FROM v GROUP BY audit_id),
audits AS (
  SELECT s.audit_id, s.seller_id, s.product_name, s.category, s.total_rules, s.passed, s.total_rules - s.passed AS failed, round(s.score, 1) AS compliance_score, s.created_at,
         coalesce(n_violations, 0) AS n_violations, coalesce(n_critical, 0) AS n_critical,
         CASE WHEN coalesce(n_critical, 0) > 0 THEN 'critical' WHEN score >= 90 THEN 'compliant' WHEN score >= 70 THEN 'low' WHEN score >= 50 THEN 'medium'
              WHEN score >= 30 THEN 'high' ELSE 'critical' END AS risk_level,
         CASE WHEN round(s.score, 1) >= 85 THEN 'Compliant' WHEN round(s.score, 1) >= 60 THEN 'Moderate Risk' ELSE 'High Risk' END AS legacy_risk
  FROM scored s LEFT JOIN vc USING (audit_id)
)
"""
)
NOW = f"TIMESTAMP '{AS_OF}'"
