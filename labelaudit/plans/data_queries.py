"""Rules that are rows of tables, paths known at run time, and lookups with a table on each side."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.operators import clauses as C
from labelaudit.operators import rule_tables as D
from labelaudit.operators import rules as R
from labelaudit.operators import vector_join as V
from labelaudit.operators.analytics import grouped_counts
from labelaudit.operators.joins import shared_folder
from labelaudit.plans.registry import query
from labelaudit.plans.rule_queries import TRIED, tried
from labelaudit.plans.views import AUDITS, JOBS, NOW, audits, jobs
from labelaudit.sources import files, queue
from labelaudit.sources.tables import AS_OF, table
from labelaudit.sources.transactions import DuplicateKeyError, Table
from labelaudit.streaming import live

#: What the rules made of nations ask, one after the other: field, operator, value, other field.
ASKED = (
    ("maybe", "eq", "1-URGENT", None),
    ("maybe", "ne", "1-URGENT", None),
    ("amount", "gt", 500, None),
    ("amount", "lt", 500, None),
    ("amount", "gte", 501, None),
    ("amount", "lte", None, "price"),
    ("maybe", "contains", "urgent", None),
    ("maybe", "not_contains", "urgent", None),
    ("maybe", "regex", "^[1-3]-[a-z]", None),
    ("maybe", "exists", True, None),
    ("maybe", "in", ["1-URGENT", "2-HIGH"], None),
    ("maybe", "not_in", ["1-URGENT", "2-HIGH"], None),
    ("amount", "between", [100, 400], None),
    ("amount", "length_eq", 3, None),
    ("maybe", "length_gt", 6, None),
    ("maybe", "length_lt", 7, None),
    ("shown", "is_expired", True, None),
    ("shown", "days_until_expiry", 90, None),
)


def _listed(values: list) -> F.Column:
    return F.array(*[F.lit(v).cast("string") for v in values])


def nation_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule for each nation, for its region's orders: one of the eighteen operators, and one on a nested field."""
    k = F.col("n_nationkey")
    pick = lambda i: F.element_at(_listed([json.dumps(a[2]) if i == 2 else a[i] for a in ASKED]), (k % len(ASKED) + 1).cast("int"))
    condition = lambda f, o, v, other: F.struct(f.alias("field"), o.alias("operator"), v.alias("value"), other.alias("value_field"))
    region = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    return table(spark, d, "nation").select(
        F.concat(F.lit("rule_"), F.lpad(k.cast("string"), 6, "0")).alias("id"),
        F.col("n_name").alias("name"),
        region.alias("category"),
        F.when(k % 2 == 0, "high").otherwise("low").alias("severity"),
        F.when(k % 13 == 0, "inactive").otherwise("active").alias("status"),
        F.array(region, F.lit("none")).alias("applicable_to"),
        F.array(
            condition(pick(0), pick(1), pick(2), pick(3)),
            condition(F.lit("detail.parts.1.no"), F.lit("lt"), (k % 9 + 2).cast("string"), F.lit(None).cast("string")),
        ).alias("conditions"),
        F.array(F.concat(F.lit("wrong in "), F.col("n_name"))).alias("messages"),
    )


def order_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents: the columns the predicates are tried on, and nested parts and tags."""
    k = F.col("id")
    part = lambda n: F.struct((k % n).alias("no"), F.concat(F.lit("p"), (k % n).cast("string")).alias("name"))
    detail = F.struct(F.array(part(7), part(11)).alias("parts"), F.array(F.lit("a"), F.col("status")).alias("tags"))
    whole = F.struct(*[F.col(c) for c in ("status", "price", "priority", "amount", "maybe", "shown")], detail.alias("detail"))
    return tried(spark, d).select("id", F.concat(F.lit("r"), (k % 5).cast("string")).alias("category"), F.to_variant_object(whole).alias("doc"))


_DOCS = """, docs AS (
  SELECT id, 'r' || (id % 5)::VARCHAR AS category, to_json({status: status, price: price, priority: priority, amount: amount, maybe: maybe, shown: shown,
    detail: {parts: [{no: id % 7, name: 'p' || (id % 7)::VARCHAR}, {no: id % 11, name: 'p' || (id % 11)::VARCHAR}], tags: ['a', status]}}) AS doc FROM t)"""
_LIST = lambda i: "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in ((json.dumps(a[2]) if i == 2 else a[i]) for a in ASKED)) + "]"
_NUMBER = "CASE WHEN regexp_matches(a, '^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN try_cast(trim(a) AS DOUBLE) END"
RULES_SQL = (
    TRIED
    + _DOCS
    + f""", rules AS (
  SELECT 'rule_' || lpad(n_nationkey::VARCHAR, 6, '0') AS rule_id, n_name, 'r' || n_regionkey::VARCHAR AS category, n_nationkey % 2 = 0 AS hard,
         {_LIST(0)}[n_nationkey % 18 + 1] AS field, {_LIST(1)}[n_nationkey % 18 + 1] AS op, {_LIST(2)}[n_nationkey % 18 + 1]::JSON AS value, {_LIST(3)}[n_nationkey % 18 + 1] AS other,
         n_nationkey % 9 + 2 AS low
  FROM nation WHERE n_nationkey % 13 <> 0
), v AS (
  SELECT id, rule_id, n_name, hard, op, value, json_extract_string(doc, '/' || field) AS a, coalesce(json_extract_string(doc, '/' || other), json_extract_string(value, '$')) AS e,
         json_extract_string(doc, '/detail/parts/1/no')::INTEGER < low AS nested
  FROM docs JOIN rules USING (category)
), w AS (SELECT *, {_NUMBER} AS n, try_cast(e AS DOUBLE) AS m, try_strptime(a, '%d/%m/%Y') AS day FROM v),
x AS (
  SELECT id, rule_id, n_name, hard, nested, coalesce(CASE op
    WHEN 'eq' THEN a = e WHEN 'ne' THEN a IS DISTINCT FROM e WHEN 'gt' THEN n > m WHEN 'lt' THEN n < m WHEN 'gte' THEN n >= m WHEN 'lte' THEN n <= m
    WHEN 'contains' THEN contains(lower(a), lower(e)) WHEN 'not_contains' THEN a IS NULL OR NOT contains(lower(a), lower(e)) WHEN 'regex' THEN regexp_matches(a, '(?i)' || e)
    WHEN 'exists' THEN coalesce(a <> '', false) WHEN 'in' THEN list_contains(from_json(value, '["VARCHAR"]'), a) WHEN 'not_in' THEN NOT coalesce(list_contains(from_json(value, '["VARCHAR"]'), a), false)
    WHEN 'between' THEN n BETWEEN json_extract_string(value, '$[0]')::DOUBLE AND json_extract_string(value, '$[1]')::DOUBLE
    WHEN 'length_eq' THEN length(a) = m WHEN 'length_gt' THEN length(a) > m WHEN 'length_lt' THEN length(a) < m
    WHEN 'is_expired' THEN day < {NOW} WHEN 'days_until_expiry' THEN floor((epoch(day) - epoch({NOW})) / 86400) <= m END, false) AS first_ok
  FROM w
)
SELECT id, rule_id, first_ok, nested AS nested_ok, CASE WHEN first_ok AND nested THEN 'passed' WHEN hard THEN 'failed' ELSE 'warning' END AS status, first_ok AND nested AS passed,
       CASE WHEN first_ok AND nested THEN '' ELSE 'wrong in ' || n_name END AS messages FROM x"""
)


@query("src_rules_json", RULES_SQL)
def _(spark, d):
    """Rules made of nations, written as files of JSON lines and read again, judge every order of their region."""
    folder = f"{shared_folder(spark)}/rules-of-nations"
    lines = nation_rules(spark, d).withColumn(
        "conditions",
        F.transform("conditions", lambda c: F.struct(c["field"].alias("field"), c["operator"].alias("operator"), F.try_parse_json(c["value"]).alias("value"), c["value_field"].alias("value_field"))),
    )
    lines.write.mode("overwrite").json(folder)
    results = D.judge(order_documents(spark, d), D.read_rules(spark, folder), "id", F.lit(AS_OF).cast("timestamp_ntz"), doc="doc")
    ok = lambda i: F.get("conditions", F.lit(i))["passed"]
    return results.select("id", "rule_id", ok(0).alias("first_ok"), ok(1).alias("nested_ok"), "status", "passed", F.array_join("messages", "|").alias("messages"))


_PATHS = ("status", "detail.parts.0.no", "detail.parts.1.name", "detail.parts.5.name", "detail.tags.1", "detail.none.x", "price.x")


@query(
    "prj_nested",
    TRIED
    + _DOCS
    + ", p AS (SELECT id, ["
    + ", ".join(f"'{p}'" for p in _PATHS)
    + f"][id % {len(_PATHS)} + 1] AS path, doc FROM docs) SELECT id, path, json_extract_string(doc, '/' || replace(path, '.', '/')) AS value FROM p",
)
def _(spark, d):
    """What each order's document has at a path that the row itself names."""
    path = F.element_at(_listed(list(_PATHS)), (F.col("id") % len(_PATHS) + 1).cast("int"))
    rows = order_documents(spark, d).withColumn("path", path)
    return rows.select("id", "path", D.value(D.at(F.col("doc"), D.variant_path(F.col("path"))))["text"].alias("value"))


# --- a table of rules, made of parts ------------------------------------------------------------------------


def _nth(values: tuple[str, ...], n: F.Column) -> F.Column:
    return F.element_at(_listed(list(values)), (n % len(values) + 1).cast("int"))


def part_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("rule_no"),
        F.concat(F.lit("rule_"), F.lpad(k.cast("string"), 6, "0")).alias("id"),
        F.col("p_name").alias("name"),
        _nth(R.RULE_TYPES, k).alias("rule_type"),
        F.lower("p_brand").alias("category"),
        _nth(R.SEVERITIES, F.col("p_size")).alias("severity"),
        F.split(F.lower("p_type"), " ").alias("tags"),
        F.array(F.lower("p_type"), F.lit("all")).alias("applicable_to"),
        _nth(R.STATUSES, F.floor(k / 3)).alias("status"),
    )


_IN = lambda values, n: "[" + ", ".join(f"'{v}'" for v in values) + f"][{n} % {len(values)} + 1]"
RULES = f"""WITH rules AS (
  SELECT p_partkey AS rule_no, 'rule_' || lpad(p_partkey::VARCHAR, 6, '0') AS id, p_name AS name, {_IN(R.RULE_TYPES, 'p_partkey')} AS rule_type, lower(p_brand) AS category,
         {_IN(R.SEVERITIES, 'p_size')} AS severity, string_split(lower(p_type), ' ') AS tags, [lower(p_type), 'all'] AS applicable_to, {_IN(R.STATUSES, '(p_partkey // 3)')} AS status
  FROM part)
"""


@query("flt_rule_select", RULES + " SELECT id FROM rules WHERE status = 'active' AND (category = 'brand#1' OR list_contains(applicable_to, 'brand#1') OR list_contains(applicable_to, 'all'))")
def _(spark, d):
    """The active rules for a category, or for all."""
    return R.select_rules(part_rules(spark, d), category="brand#1", or_all=True).select("id")


@query(
    "join_ids",
    RULES + ", w AS (SELECT o_orderkey AS position, 'rule_' || lpad((o_custkey % 250)::VARCHAR, 6, '0') AS id FROM orders) SELECT position, rules.id, severity FROM w JOIN rules USING (id)",
)
def _(spark, d):
    """Rules by the ids that orders name: repeats kept, unknown ones left out."""
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("position"), F.concat(F.lit("rule_"), F.lpad((F.col("o_custkey") % 250).cast("string"), 6, "0")).alias("id"))
    return R.rules_by_ids(part_rules(spark, d), wanted).select("position", "id", "severity")


@query("flt_rules", RULES + " SELECT id FROM rules WHERE severity = 'critical' AND status = 'active' ORDER BY rule_no DESC LIMIT 5 OFFSET 1")
def _(spark, d):
    return R.filter_rules(part_rules(spark, d), severity="critical", status="active", skip=1, limit=5).select("id")


@query(
    "agg_rule_stats",
    RULES
    + """ SELECT 'total' AS dimension, 'all' AS value, count(*) AS count FROM rules UNION ALL SELECT 'status', status, count(*) FROM rules GROUP BY status
    UNION ALL SELECT 'severity', severity, count(*) FROM rules GROUP BY severity UNION ALL SELECT 'rule_type', rule_type, count(*) FROM rules GROUP BY rule_type
    UNION ALL SELECT 'category', category, count(*) FROM rules GROUP BY category""",
)
def _(spark, d):
    return grouped_counts(part_rules(spark, d), ["status", "severity", "rule_type", "category"])


@query("agg_rule_categories", RULES + " SELECT DISTINCT category FROM rules WHERE category <> '' ORDER BY 1")
def _(spark, d):
    return part_rules(spark, d).where(F.col("category") != "").select("category").distinct().orderBy("category")


# --- a table on each side ----------------------------------------------------------------------------------------


@query(
    "join_chunk_sim",
    """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings v)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank, id, round(distance, 6) AS distance FROM p
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 3""",
)
def _(spark, d):
    """The three nearest vectors of each vector, itself among them: every row asks and every row answers."""
    v = table(spark, d, "embeddings")
    return V.vector_join(v, v, 3).select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower({x}), '\\s+')), lambda w: w <> '')"


@query(
    "join_clause_index",
    f"""WITH w AS (SELECT conv_id, turn, {_WORDS.format(x="coalesce(text, '')")} AS words FROM conversations),
    b AS (SELECT doc_id, unnest({_WORDS.format(x="coalesce(text, '')")}) AS word FROM documents),
    m AS (SELECT conv_id, turn, doc_id, count(*) AS n FROM (SELECT conv_id, turn, unnest(words) AS word FROM w) JOIN b USING (word) GROUP BY ALL),
    z AS (SELECT conv_id, turn, doc_id, 0 AS n FROM w, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3)),
    a AS (SELECT conv_id, turn, doc_id, max(n) AS n FROM (SELECT * FROM m UNION ALL SELECT * FROM z) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, doc_id) AS rn FROM a)
    SELECT conv_id, turn, string_agg(doc_id::VARCHAR, ',' ORDER BY rn) AS clauses FROM r WHERE rn <= 3 GROUP BY 1, 2""",
)
def _(spark, d):
    """For each turn of a conversation the three documents that share most words with it."""
    found = C.with_clauses(table(spark, d, "conversations"), table(spark, d, "documents"), F.col("text"), 3, key="doc_id")
    return found.select("conv_id", "turn", F.array_join(F.transform("clauses", lambda c: c.cast("string")), ",").alias("clauses"))


# --- sources and sinks that keep count ----------------------------------------------------------------------------


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@query(
    "q_pop",
    "WITH " + JOBS + """, p AS (SELECT job_id, url, row_number() OVER (ORDER BY job_id) - 1 AS place, count(*) OVER () AS n FROM jobs)
    SELECT CASE WHEN place < 10 THEN 1 ELSE 2 END::INTEGER AS pop, place, job_id, url, CASE WHEN place < 10 THEN n - 10 ELSE 0 END AS left_over FROM p""",
)
def _(spark, d):
    """All jobs are pushed in two segments; ten are popped, then, as if after a restart, all others."""
    path, j = _folder(spark, "queue"), jobs(spark, d).select("job_id", "url")
    half = j.agg(F.expr("percentile_approx(job_id, 0.5)")).first()[0] or 0
    queue.push(j.where(F.col("job_id") <= half), path, "job_id")
    queue.push(j.where(F.col("job_id") > half), path, "job_id")
    shown = None
    for number, n in ((1, 10), (2, 1 << 40)):
        popped, left = queue.pop(spark, path, n), queue.length(spark, path)
        rows = popped.select(F.lit(number).alias("pop"), "place", F.from_json("value", "job_id long, url string").alias("j"), F.lit(left).cast("long").alias("left_over"))
        shown = rows if shown is None else shown.unionByName(rows)
    return shown.select("pop", "place", "j.job_id", "j.url", "left_over")


@query("snk_insert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderdate AS changed FROM orders WHERE o_orderkey % 7 <> 0")
def _(spark, d):
    """Orders inserted in two commits, an insert of keys that are there refused whole, some changed and some deleted."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("changed"))
    kept = Table(spark, _folder(spark, "orders"), "id", 8)
    kept.insert(rows.where("id % 2 = 0"))
    kept.insert(rows.where("id % 2 = 1"))
    try:
        kept.insert(rows.where("id % 3 = 0").withColumn("status", F.lit("never")))
    except DuplicateKeyError:
        pass
    kept.upsert(rows.where("id % 5 = 0").withColumn("status", F.lit("X")), "changed")
    kept.delete(rows.where("id % 7 = 0"))
    return kept.read()


@query(
    "src_csv_batch",
    """WITH p AS (SELECT p_partkey AS k, p_name, p_type, p_brand FROM part)
    SELECT 'listing' AS kind, 's' || k::VARCHAR AS seller_id, CASE WHEN k % 5 = 0 THEN 'a "b", ' || p_name ELSE p_name END AS product_name,
           CASE WHEN k % 6 = 0 THEN 'two' || chr(10) || 'lines' WHEN k % 9 = 0 THEN '' ELSE p_type END AS description FROM p WHERE k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0
    UNION ALL SELECT 'number of cells', 's' || k::VARCHAR, NULL, NULL FROM p WHERE k % 7 = 0 OR k % 11 = 0
    UNION ALL SELECT 'not UTF-8', 's' || k::VARCHAR, NULL, NULL FROM p WHERE k % 13 = 0 AND k % 7 <> 0 AND k % 11 <> 0""",
)
def _(spark, d):
    """Parts as uploaded CSV files, some lines with a cell too many or too few, quotes, line breaks and torn letters;
    read back as listings and as rejected lines with the reason."""
    k, c = F.col("p_partkey"), F.concat
    seller = c(F.lit("s"), k.cast("string"))
    product = F.when(k % 5 == 0, c(F.lit('"a ""b"", '), "p_name", F.lit('"'))).otherwise(F.col("p_name"))
    about = F.when(k % 6 == 0, F.lit('"two\nlines"')).when(k % 9 == 0, "").otherwise(F.col("p_type"))
    torn = F.when(k % 13 == 0, c(product, F.lit("\ufffd"))).otherwise(product)
    line = F.when(k % 7 == 0, c(seller, F.lit(",a,b,c"))).when(k % 11 == 0, c(seller, F.lit(",a"))).otherwise(c(seller, F.lit(","), torn, F.lit(","), about))
    path = _folder(spark, "uploads")
    table(spark, d, "part").select(line.alias("value")).mapInArrow(_under_header, "value string").write.text(path)
    _named_csv(spark, path)
    good = files.read_batch_csv(spark, path).select(F.lit("listing").alias("kind"), "seller_id", "product_name", "description")
    none = F.lit(None).cast("string")
    seller = F.regexp_extract("line", r"(s\d+)", 1).alias("seller_id")
    bad = files.rejected_csv(spark, path).select(F.col("reason").alias("kind"), seller, none.alias("product_name"), none.alias("description"))
    return good.unionByName(bad)


def _under_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's lines, with the header before them."""
    yield pa.RecordBatch.from_arrays([pa.array(["seller_id,product_name,description"])], names=["value"])
    yield from batches


def _named_csv(spark: SparkSession, path: str) -> None:
    """Give the text files of a folder names that end with .csv."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(s.getPath(), at.suffix(f"/{name[:-4]}.csv"))


# --- the streams' aggregates, over a table -----------------------------------------------------------------------


@query(
    "live_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM s GROUP BY user_id, n""",
)
def _(spark, d):
    found = live.sessions(table(spark, d, "events"))
    return found.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


@query("live_trend", AUDITS + " SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS audits, round(avg(compliance_score), 6) AS average_score FROM audits GROUP BY 1")
def _(spark, d):
    return live.daily_trend(audits(spark, d)).select("date", "audits", F.round("average_score", 6).alias("average_score"))
