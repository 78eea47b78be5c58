"""The eighteen predicates, rule selection and lifecycle, and the deduction scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.operators import rules as R
from labelaudit.operators import scoring as S
from labelaudit.plans.registry import query
from labelaudit.plans.views import NOW
from labelaudit.sources.tables import AS_OF, table

_SHOWN = "(1 + o_orderkey % 28)::VARCHAR || '/' || (1 + o_orderkey % 12)::VARCHAR || '/' || (1999 + o_orderkey % 5)::VARCHAR"
_DATE = f"strptime({_SHOWN}, '%d/%m/%Y')"
#: Columns the predicates are tried on, with nulls and texts that are no numbers among them.
TRIED = f"""WITH t AS (
  SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE (o_orderkey % 1000)::VARCHAR END AS amount,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS maybe,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE {_SHOWN} END AS shown
  FROM orders)
"""


def tried(spark, d):
    k, c = F.col("o_orderkey"), F.concat
    s = lambda x: x.cast("string")
    shown = c(s(k % 28 + 1), F.lit("/"), s(k % 12 + 1), F.lit("/"), s(k % 5 + 1999))
    return table(spark, d, "orders").select(
        k.alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
        F.when(k % 5 == 0, None).when(k % 7 == 0, "n/a").otherwise(s(k % 1000)).alias("amount"),
        F.when(k % 4 == 0, None).when(k % 6 == 0, "").otherwise(F.col("o_orderpriority")).alias("maybe"),
        F.when(k % 9 == 0, None).when(k % 10 == 0, "soon").otherwise(shown).alias("shown"),
    )


_N = "try_cast(amount AS DOUBLE)"
_D = "try_strptime(shown, '%d/%m/%Y')"
# name -> (condition, the same in SQL)
PREDICATES = {
    "rule_eq": (R.Condition("maybe", "eq", "1-URGENT"), "coalesce(maybe = '1-URGENT', false)"),
    "rule_ne": (R.Condition("maybe", "ne", "1-URGENT"), "maybe IS DISTINCT FROM '1-URGENT'"),
    "rule_gt": (R.Condition("amount", "gt", 500), f"coalesce({_N} > 500, false)"),
    "rule_lt": (R.Condition("amount", "lt", 500), f"coalesce({_N} < 500, false)"),
    "rule_gte": (R.Condition("amount", "gte", 501), f"coalesce({_N} >= 501, false)"),
    "rule_lte": (R.Condition("amount", "lte", value_field="price"), f"coalesce({_N} <= price, false)"),
    "rule_contains": (R.Condition("maybe", "contains", "urgent"), "coalesce(contains(lower(maybe), 'urgent'), false)"),
    "rule_not_contains": (R.Condition("maybe", "not_contains", "urgent"), "coalesce(NOT contains(lower(maybe), 'urgent'), true)"),
    "rule_regex": (R.Condition("maybe", "regex", r"^[1-3]-[a-z]"), "coalesce(regexp_matches(maybe, '(?i)^[1-3]-[a-z]'), false)"),
    "rule_exists": (R.Condition("maybe", "exists", True), "coalesce(maybe <> '', false)"),
    "rule_in": (R.Condition("maybe", "in", ["1-URGENT", "2-HIGH"]), "coalesce(maybe IN ('1-URGENT', '2-HIGH'), false)"),
    "rule_not_in": (R.Condition("maybe", "not_in", ["1-URGENT", "2-HIGH"]), "coalesce(maybe NOT IN ('1-URGENT', '2-HIGH'), true)"),
    "rule_between": (R.Condition("amount", "between", [100, 400]), f"coalesce({_N} BETWEEN 100 AND 400, false)"),
    "rule_length_eq": (R.Condition("amount", "length_eq", 3), "coalesce(length(amount) = 3, false)"),
    "rule_length_gt": (R.Condition("maybe", "length_gt", 6), "coalesce(length(maybe) > 6, false)"),
    "rule_length_lt": (R.Condition("maybe", "length_lt", 7), "coalesce(length(maybe) < 7, false)"),
    "rule_is_expired": (R.Condition("shown", "is_expired", True), f"CASE WHEN shown IS NULL THEN false ELSE coalesce({_D} < {NOW}, false) END"),
    "rule_days_until_expiry": (R.Condition("shown", "days_until_expiry", 90), f"coalesce(floor((epoch({_D}) - epoch({NOW})) / 86400) <= 90, false)"),
}
for _name, (_condition, _sql) in PREDICATES.items():
    query(_name, TRIED + f" SELECT id, {_sql} AS passed FROM t")(
        lambda spark, d, c=_condition: tried(spark, d).select("id", R.test(c, F.lit(AS_OF).cast("timestamp_ntz")).alias("passed"))
    )


@query(
    "rule_execute",
    TRIED
    + f""", e AS (SELECT id, coalesce({_N} > 500, false) AND coalesce(maybe <> '', false) AS a, coalesce(length(maybe) < 7, false) AS b FROM t)
    SELECT id, 'r1' AS rule_id, CASE WHEN a THEN 'passed' ELSE 'failed' END AS status, a AS passed, CASE WHEN a THEN '' ELSE 'too small' END AS messages FROM e
    UNION ALL SELECT id, 'r2', CASE WHEN b THEN 'passed' ELSE 'warning' END, b, CASE WHEN b THEN '' ELSE 'too long' END FROM e""",
)
def _(spark, d):
    rules = (
        R.Rule("r1", "amount", "amount and name are there", "custom", "any", "high", (R.Condition("amount", "gt", 500), R.Condition("maybe", "exists", True)), ("too small",)),
        R.Rule("r2", "short", "the name is short", "custom", "any", "low", (R.Condition("maybe", "length_lt", 7),), ("too long",)),
    )
    results = R.execute_all(rules, F.lit("any"), F.lit(AS_OF).cast("timestamp_ntz"))
    rows = tried(spark, d).select("id", F.explode(results).alias("r"))
    return rows.select("id", "r.rule_id", "r.status", "r.passed", F.array_join("r.messages", "|").alias("messages"))


@query(
    "rv_rule",
    """SELECT c_custkey::VARCHAR AS id, c_custkey % 3 <> 0 AND c_mktsegment <> 'BUILDING' AND c_custkey % 5 <> 0 AS valid,
       (c_custkey % 3 = 0)::INT + (c_mktsegment = 'BUILDING')::INT + (c_custkey % 5 = 0)::INT AS n_errors FROM customer""",
)
def _(spark, d):
    """Rule drafts made of customers, some with a short name, an unknown severity or an unknown operator."""
    k = F.col("c_custkey")
    condition = F.struct(F.lit("mrp").alias("field"), F.when(k % 5 == 0, "almost").otherwise("gt").alias("operator"), F.lit("5").alias("value"))
    action = F.struct(F.lit("error").alias("type"), F.lit("wrong").alias("message"), F.lit(None).cast("string").alias("fix_value"))
    drafts = table(spark, d, "customer").select(
        k.cast("string").alias("id"),
        F.when(k % 3 == 0, "ab").otherwise(F.col("c_name")).alias("name"),
        F.lit("a description long enough").alias("description"),
        F.lit("custom").alias("rule_type"),
        F.lit("pricing").alias("category"),
        F.when(F.col("c_mktsegment") == "BUILDING", "fatal").otherwise("low").alias("severity"),
        F.lit("draft").alias("status"),
        F.array(condition).alias("conditions"),
        F.array(action).alias("actions"),
        F.array(F.lit("tag")).alias("tags"),
    )
    return R.rule_errors(drafts).select("id", "valid", F.size("errors").alias("n_errors"))


_LIFE = """WITH e AS (
  SELECT (user_id % 200)::VARCHAR AS rule_id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update' WHEN 'view' THEN 'activate' WHEN 'purchase' THEN 'deactivate' ELSE 'delete' END AS event,
         CASE WHEN event_type IN ('signup', 'click') THEN 'n' || event_id::VARCHAR END AS name FROM events
), l AS (SELECT *, sum((event = 'create')::INT) OVER (PARTITION BY rule_id ORDER BY seq) AS life, row_number() OVER (PARTITION BY rule_id ORDER BY seq DESC) AS rn FROM e),
c AS (SELECT * FROM l WHERE rn = 1 AND event <> 'delete')
SELECT c.rule_id, arg_max(l.name, l.seq) FILTER (l.name IS NOT NULL) AS name,
       arg_max(CASE l.event WHEN 'activate' THEN 'active' WHEN 'deactivate' THEN 'inactive' ELSE 'draft' END, l.seq) FILTER (l.event IN ('activate', 'deactivate', 'create')) AS status,
       count(*) FILTER (l.event IN ('create', 'update')) AS version
FROM c JOIN l ON l.rule_id = c.rule_id AND l.life = c.life GROUP BY c.rule_id
"""


@query("rm_lifecycle", _LIFE)
def _(spark, d):
    """Rule histories made of events, folded to the rules that are there now."""
    kind = F.col("event_type")
    event = F.when(kind == "signup", "create").when(kind == "click", "update").when(kind == "view", "activate").when(kind == "purchase", "deactivate").otherwise("delete")
    named = F.when(kind.isin("signup", "click"), F.concat(F.lit("n"), F.col("event_id").cast("string")))
    events = table(spark, d, "events").select((F.col("user_id") % 200).cast("string").alias("rule_id"), F.col("event_id").alias("seq"), event.alias("event"), named.alias("name"), F.lit(None).cast("string").alias("severity"))
    return R.fold_events(events).drop("severity")


# --- deductions ---------------------------------------------------------------------------------------

_PRIMES = (17, 13, 2, 3, 5, 7, 11, 4, 6, 19, 8, 9, 10, 12)
_FLAGS = [name for _, name, _ in S.FLAG_CHECKS]
_BAD = {
    code: (f"(o_orderkey % {p} = 0)" if fault else f"(o_orderkey % {p} <> 0)") + (" AND o_orderkey % 14 = 0" if code == "LM-SCORE-B006" else "")
    for (code, _, fault), p in zip(S.FLAG_CHECKS, _PRIMES, strict=True)
}
FLAGS = (
    "WITH f AS (SELECT o_orderkey AS id, list_filter(["
    + ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in _BAD.items())
    + "], lambda x: x IS NOT NULL) AS codes FROM orders), g AS (SELECT *, "
    + ", ".join(f"len(list_filter(codes, lambda x: x[10] = '{c}'))" + f" AS n_{c.lower()}" for c in "ABCD")
    + " FROM f), s AS (SELECT *, CASE WHEN n_a > 0 THEN least(60, greatest(0, 100 - 25 * n_a - 20 * n_b - 10 * n_c - 5 * n_d)) ELSE greatest(0, 100 - 20 * n_b - 10 * n_c - 5 * n_d) END AS score FROM g)"
)
_LEVEL = "CASE WHEN score >= 90 THEN 'Fully Compliant' WHEN score >= 70 THEN 'Minor Risk' WHEN score >= 50 THEN 'Moderate Legal Risk' ELSE 'High Penalty Risk' END"


def flagged(spark, d):
    k = F.col("o_orderkey")
    flags = {name: k % p == 0 for name, p in zip(_FLAGS, _PRIMES, strict=True)} | {"is_imported": k % 14 == 0}
    return table(spark, d, "orders").select(k.alias("id"), S.flag_violations(flags).alias("codes")).withColumn("score", S.deduction_score(S.code_categories(F.col("codes"))))


@query("sc_validate", FLAGS + f" SELECT id, array_to_string(codes, ',') AS codes, score::INTEGER AS score, {_LEVEL} AS level FROM s")
def _(spark, d):
    return flagged(spark, d).select("id", F.array_join("codes", ",").alias("codes"), "score", S.deduction_level(F.col("score")).alias("level"))


@query("sc_summary", FLAGS + f" SELECT {_LEVEL} AS level, count(*) AS products, sum(n_a)::BIGINT AS a, sum(n_b)::BIGINT AS b, sum(n_c)::BIGINT AS c, sum(n_d)::BIGINT AS d FROM s GROUP BY 1")
def _(spark, d):
    n = lambda c: F.sum(F.size(F.filter("codes", lambda x: F.substring(x, 10, 1) == c))).alias(c.lower())
    return flagged(spark, d).groupBy(S.deduction_level(F.col("score")).alias("level")).agg(F.count("*").alias("products"), *[n(c) for c in "ABCD"])


@query(
    "sc_calc",
    """WITH c AS (SELECT o_orderkey AS id, [chr((65 + o_orderkey % 5)::INT), chr((97 + o_orderkey % 3)::INT), 'x'] AS cats FROM orders),
    p AS (SELECT *, list_transform(cats, lambda c: CASE upper(c) WHEN 'A' THEN 25 WHEN 'B' THEN 20 WHEN 'C' THEN 10 ELSE 5 END) AS pts FROM c)
    SELECT id, (CASE WHEN list_contains(pts, 25) THEN least(60, greatest(0, 100 - list_sum(pts))) ELSE greatest(0, 100 - list_sum(pts)) END)::INTEGER AS score FROM p""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    cats = F.array(F.char(k % 5 + 65), F.char(k % 3 + 97), F.lit("x"))
    return table(spark, d, "orders").select(k.alias("id"), S.deduction_score(cats).alias("score"))
