"""Listings, the text audit and everything computed from audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.operators import analytics as N
from labelaudit.operators import audits as A
from labelaudit.operators import rules as R
from labelaudit.operators import scoring as S
from labelaudit.plans.registry import query
from labelaudit.plans.views import AUDITS, FIELDS, LISTINGS, NOW, audits, fields, violating
from labelaudit.sources.tables import AS_OF, listings

CALENDAR = f"SELECT unnest(generate_series(({NOW})::DATE - INTERVAL 6 DAY, ({NOW})::DATE, INTERVAL 1 DAY))::DATE AS day"


@query("listings", LISTINGS + " SELECT audit_id, seller_id, product_name, category, created_at, label_text FROM listings")
def _(spark, d):
    return listings(spark, d).drop("k")


@query("prj_rule_data", FIELDS + " SELECT audit_id, fssai, mrp, expiry_date, manufacturing_date, net_weight, batch, country FROM entities")
def _(spark, d):
    return fields(spark, d).select("audit_id", *A.FIELDS)


@query("text_audit_risk", AUDITS + " SELECT risk_level, count(*) AS listings, round(avg(compliance_score), 4) AS average_score FROM audits WHERE category = 'food' GROUP BY risk_level")
def text_audit_risk(spark, d):
    """Flagship: food listings through extraction, rules and score to the distribution of risk."""
    return audits(spark, d).where(F.col("category") == "food").groupBy("risk_level").agg(F.count("*").alias("listings"), F.round(F.avg("compliance_score"), 4).alias("average_score"))


@query("ce_score", AUDITS + " SELECT audit_id, total_rules, passed, failed, 0 AS warnings, compliance_score FROM audits")
def _(spark, d):
    return audits(spark, d).select("audit_id", "total_rules", "passed", "failed", "warnings", "compliance_score")


@query("ce_risk", AUDITS + " SELECT audit_id, risk_level FROM audits")
def _(spark, d):
    return audits(spark, d).select("audit_id", "risk_level")


@query("ce_violations", AUDITS + " SELECT audit_id, rule_id, rule_name, severity, message FROM v")
def _(spark, d):
    return N.exploded(violating(spark, d)).select("audit_id", "rule_id", "rule_name", "severity", "message")


_ADVICE_SQL = ", ".join(f"CASE WHEN {f} IS NULL THEN '{t.replace(chr(39), chr(39) * 2)}' END" for f, t in S.ADVICE)


@query(
    "ce_reco",
    AUDITS
    + f""", fx AS (SELECT audit_id, string_agg('FIX: ' || message, '|' ORDER BY rule_no) AS fixes
                  FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY rule_no) AS rn FROM v) WHERE rn <= 3 GROUP BY audit_id)
     SELECT s.audit_id, concat_ws('|', {_ADVICE_SQL}, fixes) AS recommendations FROM scored s LEFT JOIN fx USING (audit_id)""",
)
def _(spark, d):
    return audits(spark, d).select("audit_id", F.array_join("recommendations", "|").alias("recommendations"))


@query("risk_t2", AUDITS + " SELECT audit_id, legacy_risk FROM audits")
def _(spark, d):
    return audits(spark, d).select("audit_id", "legacy_risk")


@query(
    "agg_dashboard",
    AUDITS
    + f""" SELECT count(*) AS total_audits, count(*) FILTER (risk_level = 'compliant') AS compliant, count(*) FILTER (risk_level <> 'compliant') AS non_compliant,
     round(coalesce(avg(compliance_score), 0)::DECIMAL(18,6), 1)::DOUBLE AS average_score, coalesce(sum(n_critical), 0)::BIGINT AS critical_violations,
     count(*) FILTER (created_at >= ({NOW})::DATE) AS audits_today FROM audits WHERE created_at >= {NOW} - INTERVAL 30 DAY""",
)
def _(spark, d):
    return N.dashboard(audits(spark, d), AS_OF, 30)


@query(
    "agg_score_trend",
    AUDITS
    + f""", c AS ({CALENDAR}) SELECT strftime(day, '%Y-%m-%d') AS date, coalesce(round(avg(compliance_score)::DECIMAL(18,6), 1)::DOUBLE, 0) AS average_score, count(audit_id) AS count
     FROM c LEFT JOIN audits ON created_at::DATE = day GROUP BY day""",
)
def _(spark, d):
    return N.score_trend(audits(spark, d), AS_OF, 7)


for _by in ("category", "risk_level"):
    query(f"agg_{'category' if _by == 'category' else 'risk'}_dist", AUDITS + f" SELECT coalesce({_by}, 'unknown') AS {_by}, count(*) AS count FROM audits GROUP BY 1")(
        lambda spark, d, by=_by: N.distribution(audits(spark, d), by)
    )

_TOP = " SELECT {key} AS violation, count(*) AS count FROM v GROUP BY 1 ORDER BY count DESC, violation LIMIT {k}"


@query("agg_top_violations", AUDITS + _TOP.format(key="rule_name", k=10))
def _(spark, d):
    return N.top_violations(violating(spark, d), 10)


@query("agg_legacy_stats", AUDITS + _TOP.format(key="message", k=5))
def _(spark, d):
    return N.legacy_stats(violating(spark, d), 5)


@query("agg_violation_trends", AUDITS + _TOP.format(key="rule_id || ': ' || message", k=10))
def _(spark, d):
    return N.violation_trends(violating(spark, d), 10)


@query(
    "agg_summary",
    AUDITS
    + """ SELECT count(*) AS total_audits, round(coalesce(avg(compliance_score), 0)::DECIMAL(18,6), 1)::DOUBLE AS average_score, min(compliance_score) AS min_score, max(compliance_score) AS max_score,
     count(*) FILTER (risk_level = 'compliant') AS compliant_count, count(*) FILTER (risk_level IN ('high', 'critical')) AS high_risk_count,
     coalesce(sum(n_violations), 0)::BIGINT AS total_violations FROM audits""",
)
def _(spark, d):
    return N.summary(audits(spark, d))


@query(
    "agg_violation_report",
    AUDITS
    + """ SELECT rule_name, count(*) AS count, string_agg(audit_id, ',' ORDER BY rn) FILTER (rn <= 3) AS examples
     FROM (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY audit_id, message) AS rn FROM v) GROUP BY rule_name""",
)
def _(spark, d):
    return N.violation_report(violating(spark, d))


@query(
    "agg_trends",
    AUDITS
    + f""" SELECT strftime(created_at, '%Y-%m-%d') AS date, round(avg(compliance_score)::DECIMAL(18,6), 1)::DOUBLE AS average_score, sum(n_violations)::BIGINT AS violations, count(*) AS audits
     FROM audits WHERE created_at >= {NOW} - INTERVAL 365 DAY GROUP BY 1""",
)
def _(spark, d):
    return N.trends(audits(spark, d), AS_OF, 365)


@query(
    "agg_timeline",
    AUDITS
    + f""" SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS total, count(*) FILTER (risk_level = 'compliant') AS compliant, round(avg(compliance_score)::DECIMAL(18,6), 1)::DOUBLE AS average_score
     FROM audits WHERE created_at >= {NOW} - INTERVAL 90 DAY GROUP BY 1""",
)
def _(spark, d):
    return N.timeline(audits(spark, d), AS_OF, 90)


@query(
    "agg_stats_service",
    AUDITS
    + """ SELECT 'total' AS dimension, 'all' AS value, count(*) AS count, round(coalesce(avg(compliance_score), 0)::DECIMAL(18,6), 1)::DOUBLE AS average_score FROM audits
     UNION ALL SELECT 'risk_level', risk_level, count(*), round(avg(compliance_score)::DECIMAL(18,6), 1)::DOUBLE FROM audits GROUP BY risk_level
     UNION ALL SELECT 'category', category, count(*), round(avg(compliance_score)::DECIMAL(18,6), 1)::DOUBLE FROM audits GROUP BY category""",
)
def _(spark, d):
    return N.service_stats(audits(spark, d))


_INFER_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(product_name, '')), '{'|'.join(w)}') THEN '{n}'" for n, w in N.INFERRED) + " ELSE 'Other' END"


@query("ca_infer", AUDITS + f" SELECT audit_id, {_INFER_SQL} AS inferred FROM audits")
def _(spark, d):
    """Each audit's category by its product's name; an audit is one listing, and nothing that is extracted is asked for."""
    return listings(spark, d).select("audit_id", N.infer_category(F.col("product_name")).alias("inferred"))


_STATS = """ SELECT {by} AS category, count(*) AS total, count(*) FILTER (legacy_risk = 'Compliant') AS compliant, count(*) FILTER (legacy_risk = 'Moderate Risk') AS moderate,
     count(*) FILTER (legacy_risk NOT IN ('Compliant', 'Moderate Risk')) AS high_risk, round(avg(compliance_score)::DECIMAL(18,6), 1)::DOUBLE AS average_score,
     round(count(*) FILTER (legacy_risk = 'Compliant') / count(*)::DOUBLE * 100, 1) AS compliance_rate FROM audits GROUP BY 1"""


@query("agg_category_stats", AUDITS + _STATS.format(by="category"))
def _(spark, d):
    return N.category_stats(audits(spark, d), by=F.col("category"))


@query("agg_category_stats_inferred", AUDITS + _STATS.format(by=_INFER_SQL))
def _(spark, d):
    return N.category_stats(audits(spark, d))


@query(
    "agg_risk_dist_fixed",
    AUDITS
    + """ SELECT r.risk, count(audit_id) AS count FROM (VALUES ('Compliant'), ('Moderate Risk'), ('High Risk')) r(risk)
     LEFT JOIN audits ON coalesce(legacy_risk, 'High Risk') = r.risk GROUP BY r.risk""",
)
def _(spark, d):
    return N.fixed_risk_distribution(audits(spark, d))


@query(
    "agg_analytics_summary",
    AUDITS
    + """ SELECT 'risk' AS block, r.risk AS item, count(audit_id) AS count FROM (VALUES ('Compliant'), ('Moderate Risk'), ('High Risk')) r(risk)
     LEFT JOIN audits ON coalesce(legacy_risk, 'High Risk') = r.risk GROUP BY r.risk
     UNION ALL SELECT 'category', category, count(*) FROM audits GROUP BY category
     UNION ALL SELECT 'violation', rule_id || ': ' || message, count(*) FROM v GROUP BY 2""",
)
def _(spark, d):
    return N.analytics_summary(audits(spark, d), 10)


@query(
    "agg_ui_bulk",
    AUDITS + """ SELECT count(*) FILTER (legacy_risk = 'Compliant') AS compliant, count(*) FILTER (legacy_risk = 'Moderate Risk') AS moderate,
     count(*) FILTER (legacy_risk = 'High Risk') AS high, floor(avg(compliance_score) + 0.5)::BIGINT AS average_score FROM audits""",
)
def _(spark, d):
    n = lambda v: F.count_if(F.col("legacy_risk") == v)
    return audits(spark, d).agg(n("Compliant").alias("compliant"), n("Moderate Risk").alias("moderate"), n("High Risk").alias("high"), F.floor(F.avg("compliance_score") + 0.5).cast("long").alias("average_score"))


@query(
    "agg_ui_rates",
    AUDITS + """, c AS (SELECT category, count(*) AS count FROM audits GROUP BY category)
     SELECT category, count, floor(count / sum(count) OVER () * 100 + 0.5)::BIGINT AS share_pct, floor(count / max(count) OVER () * 100 + 0.5)::BIGINT AS bar_pct FROM c""",
)
def _(spark, d):
    return N.shares(N.distribution(audits(spark, d), "category"))


@query("flt_reports", AUDITS + " SELECT audit_id, compliance_score FROM audits WHERE created_at >= TIMESTAMP '1999-01-01' AND created_at <= TIMESTAMP '2000-12-31' AND category = 'food' AND risk_level = 'critical'")
def _(spark, d):
    return N.filter_reports(audits(spark, d), start="1999-01-01 00:00:00", end="2000-12-31 00:00:00", category="food", risk="critical").select("audit_id", "compliance_score")


@query("flt_risk", AUDITS + " SELECT audit_id FROM audits WHERE legacy_risk = 'High Risk'")
def _(spark, d):
    return audits(spark, d).where(F.col("legacy_risk") == "High Risk").select("audit_id")


@query(
    "flt_search",
    AUDITS + """, m AS (SELECT audit_id, created_at, compliance_score FROM audits WHERE risk_level = 'critical' AND compliance_score >= 20 AND compliance_score <= 80
     AND (created_at IS NULL OR created_at >= TIMESTAMP '1996-01-01') AND contains(lower(product_name), 'a'))
     SELECT audit_id, compliance_score, (SELECT count(*) FROM m) AS total FROM m ORDER BY created_at DESC, audit_id LIMIT 100 OFFSET 10""",
)
def _(spark, d):
    return N.search(audits(spark, d), risk="critical", low=20, high=80, start="1996-01-01 00:00:00", words="A", skip=10, limit=100).select("audit_id", "compliance_score", "total")


@query("flt_audits", AUDITS + " SELECT audit_id, risk_level FROM audits WHERE risk_level = 'low' ORDER BY created_at DESC, audit_id LIMIT 20 OFFSET 20")
def _(spark, d):
    return N.page(audits(spark, d).where(F.col("risk_level") == "low"), 20, 20).select("audit_id", "risk_level")


@query("page_skip_limit", AUDITS + " SELECT audit_id FROM audits ORDER BY created_at DESC, audit_id LIMIT 50 OFFSET 100")
def _(spark, d):
    return N.page(audits(spark, d), 100, 50).select("audit_id")


@query("flt_ui_search", AUDITS + " SELECT audit_id FROM audits WHERE contains(lower(product_name), '7') OR contains(lower(seller_id), '7')")
def _(spark, d):
    return N.contains_any(audits(spark, d), "7").select("audit_id")


@query("agg_exec_counts", AUDITS + " SELECT category, sum(passed)::BIGINT AS passed, sum(failed)::BIGINT AS failed, 0::BIGINT AS warnings FROM audits GROUP BY category")
def _(spark, d):
    return audits(spark, d).groupBy("category").agg(*[F.sum(c).alias(c) for c in ("passed", "failed", "warnings")])


@query(
    "join_rules_cross",
    AUDITS + """ SELECT s.audit_id, r.id AS rule_id FROM scored s JOIN (VALUES ('rule_000001', ['food', 'beverages']), ('rule_000002', ['food', 'beverages']), ('rule_000003', ['all']),
     ('rule_000004', ['food', 'beverages', 'medicine']), ('rule_000005', ['food', 'beverages'])) r(id, cats) ON list_contains(r.cats, s.category)""",
)
def _(spark, d):
    """Listings against the rules that apply, as a join on the exploded categories of the few rules."""
    rules = R.rules_frame(spark).select(F.col("id").alias("rule_id"), F.explode(F.array_union("applicable_to", F.array("category"))).alias("applies_to"))
    return listings(spark, d).join(F.broadcast(rules), F.col("category") == F.col("applies_to")).select("audit_id", "rule_id")  # a row per rule and category
