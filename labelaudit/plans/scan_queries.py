"""Whole product scans, picture audits, marketplace pages, exports and the small gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.functions import duck as D
from labelaudit.functions import explain as X
from labelaudit.functions import extract as E
from labelaudit.functions import html as H
from labelaudit.functions import market as M
from labelaudit.functions import patterns as P
from labelaudit.operators import rules as R
from labelaudit.operators import scan as C
from labelaudit.operators.audits import once
from labelaudit.plans.other_queries import _REGION
from labelaudit.plans.registry import query
from labelaudit.plans.text_queries import DECLARED, SIMPLE_SQL, _ALL
from labelaudit.plans.views import AUDITS, JOBS, LISTINGS, audits, jobs
from labelaudit.sources import files as S
from labelaudit.sources.tables import listings, spread, table

T = F.col


def q(s: str) -> str:
    return D.q(s)


# --- product scan ---------------------------------------------------------------------------------------------

_CODES = ", ".join(f"CASE WHEN {f} IS NULL THEN '{c}' END" for c, f in (("LM-PC-001", "mrp"), ("LM-PC-002", "quantity"), ("LM-PC-003", "manufacturer"), ("LM-PC-004", "country_of_origin")))
_TERMS = "list_filter(list_distinct(regexp_split_to_array(lower({x}), '\\s+')), lambda w: w <> '')"


@query(
    "scan_product",
    LISTINGS
    + f""", s AS MATERIALIZED (SELECT k, product_name, label_text, {', '.join(f'{e} AS {n}' for n, e in SIMPLE_SQL.items())} FROM listings),
    p AS (SELECT *, concat_ws(',', {_CODES}) AS codes, 100 - 20 * (mrp IS NULL)::INT - 20 * (quantity IS NULL)::INT - 20 * (manufacturer IS NULL)::INT - 10 * (country_of_origin IS NULL)::INT AS score FROM s),
    w AS (SELECT k, {_TERMS.format(x="concat_ws(' ', product_name, label_text)")} AS words FROM s), b AS (SELECT item_id, {_TERMS.format(x='text')} AS words FROM benchmark),
    m AS (SELECT k, item_id, len(list_intersect(w.words, b.words)) AS n FROM w, b), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, item_id) AS rn FROM m),
    c AS (SELECT k, string_agg(item_id::VARCHAR, ',' ORDER BY rn) AS clauses FROM r WHERE rn <= 3 GROUP BY k)
    SELECT k AS key, mrp, quantity, manufacturer, country_of_origin, codes, clauses, CASE WHEN codes = '' THEN {q(X.NO_VIOLATIONS[0])} ELSE {q(X.NO_MODEL[0])} END AS explanation, score,
           CASE WHEN score >= 85 THEN 'Compliant' WHEN score >= 60 THEN 'Moderate Risk' ELSE 'High Risk' END AS risk FROM p JOIN c USING (k)""",
)
def _(spark, d):
    rows = listings(spark, d).select(T("k").alias("key"), "product_name", T("label_text").alias("text"))
    found = C.scan(rows, table(spark, d, "benchmark"))
    return found.select(
        "key", *SIMPLE_SQL, F.array_join(F.transform("violations", lambda v: v["code"]), ",").alias("codes"), F.array_join(F.transform("clauses", lambda c: c.cast("string")), ",").alias("clauses"),
        T("explanation.explanation").alias("explanation"), "score", "risk",
    )


@query(
    "join_chunk_overlap",
    f"""WITH w AS (SELECT p_partkey, {_TERMS.format(x="concat_ws(' ', p_name, p_type)")} AS words FROM part), b AS (SELECT item_id, {_TERMS.format(x='text')} AS words FROM benchmark),
    r AS (SELECT p_partkey, item_id, row_number() OVER (PARTITION BY p_partkey ORDER BY len(list_intersect(w.words, b.words)) DESC, item_id) AS rn FROM w, b)
    SELECT p_partkey, string_agg(item_id::VARCHAR, ',' ORDER BY rn) AS clauses FROM r WHERE rn <= 2 GROUP BY 1""",
)
def _(spark, d):
    """A table of queries, the parts, against the clauses."""
    found = C.with_clauses(table(spark, d, "part"), table(spark, d, "benchmark"), F.concat_ws(" ", "p_name", "p_type"), 2)
    return found.select("p_partkey", F.array_join(F.transform("clauses", lambda c: c.cast("string")), ",").alias("clauses"))


# --- explanations -------------------------------------------------------------------------------------------------

_ANSWER = """CASE o_orderkey % 6 WHEN 0 THEN '```json' || chr(10) || '{"explanation": "' || o_orderpriority || '", "risk_summary": " "}' || chr(10) || '```'
 WHEN 1 THEN 'Sure: {"explanation": ["a ", " ", "' || o_orderstatus || '"], "suggested_correction": "fix"} bye' WHEN 2 THEN 'no json at all' WHEN 3 THEN '' WHEN 4 THEN '{"explanation": 5}' ELSE '{broken' END"""
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(trim(answer, ' ' || chr(10)), '^```json\\s*', '', 'i'), '^```\\s*', ''), '\\s*```$', '')"


def _section_sql(n: str, fallback: str) -> str:
    v = f"(j->'$.{n}')"
    lines = f"array_to_string(list_filter(list_transform(from_json({v}, '[\"VARCHAR\"]'), lambda x: trim(x)), lambda x: x <> ''), chr(10))"
    return f"coalesce(nullif(CASE json_type({v}) WHEN 'ARRAY' THEN {lines} WHEN 'VARCHAR' THEN trim(j->>'$.{n}') ELSE j->>'$.{n}' END, ''), {q(fallback)})"


@query(
    "ll_parse_json",
    f"""WITH a AS (SELECT o_orderkey, {_ANSWER} AS answer FROM orders), c AS (SELECT *, {_PLAIN} AS plain FROM a),
    j AS (SELECT *, CASE WHEN json_valid(plain) AND plain <> '' THEN plain WHEN json_valid(regexp_extract(plain, '(?s)(\\{{.*\\}})', 1)) AND regexp_extract(plain, '(?s)(\\{{.*\\}})', 1) <> '' THEN regexp_extract(plain, '(?s)(\\{{.*\\}})', 1) END::JSON AS j FROM c)
    SELECT o_orderkey, CASE WHEN j IS NOT NULL THEN {_section_sql('explanation', X.FALLBACK[0])} WHEN answer = '' THEN 'No model explanation returned.' ELSE trim(regexp_replace(answer, '```json|```', '', 'g')) END AS explanation,
           CASE WHEN j IS NOT NULL THEN {_section_sql('suggested_correction', X.FALLBACK[1])} ELSE {q(X.FALLBACK[1])} END AS suggested_correction,
           CASE WHEN j IS NOT NULL THEN {_section_sql('risk_summary', X.FALLBACK[2])} ELSE {q(X.FALLBACK[2])} END AS risk_summary FROM j""",
)
def _(spark, d):
    """Answers made of orders: fenced JSON, JSON inside text, lists, none and broken; also ll_format."""
    k = T("o_orderkey") % 6
    answer = (
        F.when(k == 0, F.concat(F.lit('```json\n{"explanation": "'), "o_orderpriority", F.lit('", "risk_summary": " "}\n```')))
        .when(k == 1, F.concat(F.lit('Sure: {"explanation": ["a ", " ", "'), "o_orderstatus", F.lit('"], "suggested_correction": "fix"} bye')))
        .when(k == 2, "no json at all").when(k == 3, "").when(k == 4, '{"explanation": 5}').otherwise("{broken")
    )
    return once(table(spark, d, "orders").select("o_orderkey", answer.alias("answer")), r=X.answered(T("answer"))).select("o_orderkey", "r.*")


@query(
    "ll_explain",
    AUDITS + f""" SELECT audit_id, CASE WHEN n_violations = 0 THEN {q(X.NO_VIOLATIONS[1])} ELSE {q(X.NO_MODEL[1])} END AS suggested_correction,
    CASE WHEN n_violations = 0 THEN {q(X.NO_VIOLATIONS[2])} ELSE {q(X.NO_MODEL[2])} END AS risk_summary FROM audits""",
)
def _(spark, d):
    found = audits(spark, d).select("audit_id", X.explained(T("violations")).alias("e"))
    return found.select("audit_id", "e.suggested_correction", "e.risk_summary")


# --- patterns with places -----------------------------------------------------------------------------------------


def _place_sql(name: str) -> str:
    patterns = P.LABEL[name][1]
    hit = [f"regexp_matches(label_text, {q('(?is)' + p.replace('(?=', '(?:'))})" for p in patterns]
    no = "CASE " + " ".join(f"WHEN {h} THEN {n}" for n, h in enumerate(hit)) + " END"
    whole = "CASE " + " ".join(f"WHEN {h} THEN {D.whole('label_text', p, 'is')}" for h, p in zip(hit, patterns, strict=True)) + " END"
    return f"SELECT audit_id, '{name}' AS name, {no} AS pattern_no, {whole} AS full_match, label_text FROM listings"


@query(
    "pm_positions",
    LISTINGS + ", m AS (" + " UNION ALL ".join(_place_sql(n) for n in P.LABEL) + ") SELECT audit_id, name, full_match, (strpos(label_text, full_match) - 1)::INTEGER AS start, "
    "(strpos(label_text, full_match) - 1 + length(full_match))::INTEGER AS stop, pattern_no FROM m WHERE pattern_no IS NOT NULL",
)
def _(spark, d):
    """Where each declaration stands in the label, and which of its patterns found it."""
    rows = once(listings(spark, d).select("audit_id", "label_text"), **{n: E.label_match(T("label_text"), n) for n in P.LABEL})
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), T(n).alias("m")) for n in P.LABEL]))
    return rows.select("audit_id", each).where("m IS NOT NULL").select("audit_id", "name", "m.full_match", "m.start", T("m.end").alias("stop"), "m.pattern_no")


# --- pictures -----------------------------------------------------------------------------------------------------

_PICTURES = LISTINGS + """, g AS (SELECT k, category, unnest(string_split(label_text, chr(10))) AS text, generate_subscripts(string_split(label_text, chr(10)), 1) - 1 AS region FROM listings),
 p AS (SELECT k AS image_id, category, string_agg(text, ' ' ORDER BY region) AS label_text, count(*)::INTEGER AS regions_processed,
       avg(((k * 7 + region * 13) % 100) / 100.0) AS mean, count(*) FILTER (((k * 7 + region * 13) % 100) / 100.0 < 0.65)::INTEGER AS low_confidence_regions FROM g GROUP BY k, category)
"""
_LEVEL = "CASE WHEN mean >= 0.85 THEN 'HIGH_CONFIDENCE' WHEN mean >= 0.7 THEN 'MEDIUM_CONFIDENCE' WHEN mean >= 0.5 THEN 'LOW_CONFIDENCE' ELSE 'VERY_LOW_CONFIDENCE' END"


def regions(spark, d):
    """The lines of each label as regions of a picture, some read badly."""
    lines = listings(spark, d).select(T("k").alias("image_id"), "category", F.posexplode(F.split("label_text", "\n")).alias("region", "text"))
    return lines.withColumn("confidence", F.pmod(T("image_id") * 7 + T("region") * 13, F.lit(100)) / 100.0)


@query(
    "ao_pipeline",
    _PICTURES + f""" SELECT image_id, regions_processed, low_confidence_regions, round(mean, 4) AS confidence_score, {_LEVEL} AS confidence_level, mean < 0.7 AS needs_review,
    '₹' || replace({_REGION['mrp']}, ',', '') AS mrp, {_REGION['net_quantity']} AS net_quantity, {_REGION['batch_number']} AS batch_number, CASE WHEN category = 'food' THEN {_REGION['fssai_license']} END AS fssai_license FROM p""",
)
def _(spark, d):
    found = C.picture_audit(regions(spark, d))
    return found.select("image_id", "regions_processed", "low_confidence_regions", "confidence_score", "confidence_level", "needs_review", "mrp", "net_quantity", "batch_number", "fssai_license")


_NAMED = [n for n in _ALL if not n.startswith("net_quantity_")]


@query(
    "audit_ocr_confidence",
    DECLARED + ", n AS (SELECT *, len(list_filter(regexp_split_to_array(label_text, '\\s+'), lambda w: w <> '')) AS words, "
    + " + ".join(f"coalesce({n} <> '', false)::INT" for n in _NAMED)
    + """ AS there FROM declared) SELECT audit_id, floor((CASE WHEN words >= 100 THEN 100 WHEN words >= 50 THEN 80 WHEN words >= 20 THEN 60 ELSE words * 2 END) * 0.6
     + least(100, there / (CASE WHEN category IN ('food', 'electronics') THEN 14 WHEN category = 'cosmetics' THEN 12 ELSE 6 END) * 100) * 0.4 + 1e-9)::INTEGER AS confidence FROM n""",
)
def _(spark, d):
    rows = listings(spark, d).select("audit_id", "category", "label_text")
    names = {n: c for n, c in E.declarations(T("label_text"), T("category")).items() if n in _NAMED}
    return once(rows, **names).select("audit_id", C.text_confidence(T("label_text"), {n: T(n) for n in names}, T("category")).alias("confidence"))


_SERVICE = f"{D.fssai('label_text')} AS e_fssai, {D.first_date('label_text', P.SERVICE_EXPIRES)} AS e_expires, {D.first_date('label_text', P.SERVICE_MADE)} AS e_made"


def _rule_data_img_sql() -> str:
    from labelaudit.plans.text_queries import _EXPIRES, _MADE, _NINE

    months = f"CASE WHEN made IS NOT NULL AND expires IS NULL THEN try_cast({D.cap('label_text', P.OCR_SHELF_LIFE)} AS INTEGER) END"
    return (
        LISTINGS
        + f", o AS (SELECT audit_id, label_text, {_NINE['fssai']} AS o_fssai, {_NINE['mrp']} AS mrp, {_NINE['weight']}::DOUBLE AS net_weight, {_NINE['batch']} AS batch, {_NINE['country']} AS country, "
        + f"{_MADE} AS made, {_EXPIRES} AS expires, {_SERVICE} FROM listings), m AS (SELECT *, made IS NOT NULL OR expires IS NOT NULL OR {months} IS NOT NULL AS dated FROM o)"
        + " SELECT audit_id, coalesce(o_fssai, e_fssai) AS fssai, mrp, CASE WHEN dated THEN expires ELSE e_expires END AS expiry_date, CASE WHEN dated THEN made ELSE e_made END AS manufacturing_date, net_weight, batch, country FROM m"
    )


@query("prj_rule_data_img", _rule_data_img_sql())
def _(spark, d):
    """OCR's fields with the entities it lacks, as the rules read them; also join_merge_entities."""
    both = once(listings(spark, d).select("audit_id", "label_text"), ocr=E.ocr_fields(T("label_text"), C.FROM_OCR), found=E.entities(T("label_text"), only=C.FROM_ENTITIES))
    return both.select("audit_id", *[c.alias(n) for n, c in C.merged_entities(T("ocr"), T("found")).items()])


# --- marketplace pages ----------------------------------------------------------------------------------------------


def _pages(spark, d, html):
    return spread(table(spark, d, "part")).select(T("p_partkey").alias("page_id"), F.lit("https://shop.example/item").alias("url"), F.concat(*html).alias("html"))


@query(
    "ss_amazon",
    """SELECT p_partkey AS page_id, p_name AS title, 'Made of ' || p_type AS description, p_brand AS brand, p_size::VARCHAR || ' g' AS weight, lpad(p_partkey::VARCHAR, 14, '1') AS licence, '₹' || p_size::VARCHAR AS mrp,
    6 AS specifications, 'https://img.example/' || p_partkey::VARCHAR || '.jpg|https://shop.example/t/2.jpg' AS images FROM part""",
)
def _(spark, d):
    """Parts as product pages of the first marketplace: title, prices, tables, bullets, facts and pictures."""
    k = T("p_partkey").cast("string")
    html = (
        F.lit('<html><head><meta property="og:title" content="other"></head><body><span id="productTitle"> '), T("p_name"), F.lit(' </span><span class="a-price-whole">99</span><span class="a-price a-text-price">₹'), T("p_size").cast("string"),
        F.lit('</span><div id="feature-bullets"><ul><li>short</li><li>a long bullet</li></ul></div><table id="productDetails_techSpec_section_1"><tr><th>Brand</th><td>‎'), T("p_brand"), F.lit("</td></tr><tr><th>Brand</th><td>again</td></tr></table>"),
        F.lit('<div id="detailBullets_feature_div"><ul><li><span class="a-list-item">Weight : '), T("p_size").cast("string"), F.lit(' g</span></li></ul></div><div id="important-information"><h4>Storage:</h4><p>Keep it dry</p></div>'),
        F.lit('<p>FSSAI License: '), F.lpad(k, 14, "1"), F.lit('</p><div id="productDescription">Made of '), T("p_type"), F.lit('</div><img id="landingImage" src="https://img.example/'), k,
        F.lit('.jpg"><div id="altImages"><img src="https://img.example/'), k, F.lit('._SX38_SY50_.jpg"><img src="/t/2._AC_US40_.jpg"><img src="/t/sprite.png"></div></body></html>'),
    )
    p, spec = M.products(_pages(spark, d, html), M.amazon), lambda n: T("specifications")[n]
    return p.select(
        "page_id", "title", "description", spec("Brand").alias("brand"), spec("Weight").alias("weight"), spec("FSSAI License Number").alias("licence"), spec("MRP").alias("mrp"),
        F.size("specifications").alias("specifications"), F.array_join("image_urls", "|").alias("images"),
    )


@query(
    "ss_flipkart",
    """SELECT p_partkey AS page_id, p_name AS title, p_type AS description, p_brand AS brand, p_size::VARCHAR AS size, '₹' || p_size::VARCHAR AS price, 3 AS specifications,
    'https://img.flipkart.example/832/832/' || p_partkey::VARCHAR || '.jpg' AS images FROM part""",
)
def _(spark, d):
    k = T("p_partkey").cast("string")
    html = (
        F.lit('<h1 class="_6EBuvT">'), T("p_name"), F.lit('</h1><div class="Nx9bqj CxhGGd">₹'), T("p_size").cast("string"), F.lit('</div><div class="_1AN87F"><ul><li>Brand: '), T("p_brand"), F.lit("</li><li>plain</li></ul></div>"),
        F.lit('<div class="_14cfVK"><table><tr><td>Size</td><td>'), T("p_size").cast("string"), F.lit('</td></tr></table></div><div class="_1mXcCf RmoJUa">'), T("p_type"), F.lit('<img src="https://img.flipkart.example/100/100/'), k,
        F.lit('.jpg"></div><img class="_396cs4" src="https://img.flipkart.example/12/34/'), k, F.lit('.jpg"><img class="_396cs4" src="https://x.example/loading.gif"><script>var x</script>'),
    )
    p, spec = M.products(_pages(spark, d, html), M.flipkart), lambda n: T("specifications")[n]
    return p.select("page_id", "title", "description", spec("Brand").alias("brand"), spec("Size").alias("size"), spec("Selling Price").alias("price"), F.size("specifications").alias("specifications"), F.array_join("image_urls", "|").alias("images"))


@query("src_search_urls", "SELECT p_partkey AS page_id, unnest([0, 1])::INTEGER AS position, unnest(['https://www.amazon.in/dp/' || p_partkey::VARCHAR, 'https://www.amazon.in/gp/product/x']) AS url FROM part")
def _(spark, d):
    """Result pages with a product twice, one behind a query string, another address and a third product beyond the limit."""
    k = T("p_partkey").cast("string")
    html = (F.lit('<a href="/dp/'), k, F.lit('?ref=1">x</a><a class="y" href=\'https://www.amazon.in/dp/'), k, F.lit("'>x</a><a href=\"/help\">h</a><a href=\"/gp/product/x\">z</a><a href=\"/dp/late\">l</a>"))
    return H.product_links(_pages(spark, d, html), "amazon", 2)


# --- exports and sinks -----------------------------------------------------------------------------------------------


@query("snk_csv_legacy", AUDITS + " SELECT audit_id AS product_id, seller_id, product_name, compliance_score AS score, legacy_risk AS risk_level, created_at FROM audits")
def _(spark, d):
    a = audits(spark, d).select(T("audit_id").alias("product_id"), "seller_id", "product_name", T("compliance_score").alias("score"), T("legacy_risk").alias("risk_level"), "created_at")
    return S.legacy_rows(a)


@query(
    "snk_json",
    AUDITS + """ SELECT rule_name, count(*) AS count, string_agg(audit_id, ',' ORDER BY rn) FILTER (rn <= 3) AS examples
     FROM (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY audit_id, message) AS rn FROM v) GROUP BY rule_name""",
)
def _(spark, d):
    """The rows of the JSON report of violations."""
    return S.json_report(audits(spark, d), "violation")


@query("snk_queue", "WITH " + JOBS + " SELECT to_json({url: url, job_id: job_id, priority: priority})::VARCHAR AS value FROM jobs")
def _(spark, d):
    return S.queue_lines(jobs(spark, d).select("url", "job_id", "priority"))


# --- rules ---------------------------------------------------------------------------------------------------------

_VALUES = ('5', '"5"', '"x"', '[1, 2]', '["a"]', "true", "null", "7.5", '"7.5"')
_OPS = tuple(R.OPERATORS)
_NUMBER = "(regexp_matches(v, '^(-?[0-9]+([.][0-9]+)?|true|false)$') OR (starts_with(v, '\"') AND try_cast(trim(v, '\"') AS DOUBLE) IS NOT NULL))"
_WHOLE = "(regexp_matches(v, '^(-?[0-9]+([.][0-9]+)?|true|false)$') OR regexp_matches(v, '^\"[+-]?[0-9]+\"$'))"


@query(
    "rv_value_type",
    f"""WITH c AS (SELECT o_orderkey AS id, [{', '.join(q(o) for o in _OPS)}][1 + o_orderkey % {len(_OPS)}] AS op, [{', '.join(q(v) for v in _VALUES)}][1 + (o_orderkey // {len(_OPS)}) % {len(_VALUES)}] AS v FROM orders)
    SELECT id, CASE WHEN op IN ('gt', 'lt', 'gte', 'lte') THEN {_NUMBER} WHEN op IN ('contains', 'not_contains', 'regex') THEN starts_with(v, '"') WHEN op = 'exists' THEN v IN ('true', 'false')
    WHEN op IN ('in', 'not_in') THEN starts_with(v, '[') WHEN op = 'between' THEN starts_with(v, '[') AND coalesce(json_array_length(CASE WHEN starts_with(v, '[') THEN v END), 0) = 2
    WHEN op IN ('length_eq', 'length_gt', 'length_lt') THEN {_WHOLE} ELSE true END AS ok FROM c""",
)
def _(spark, d):
    k = T("o_orderkey")
    op = F.element_at(F.array(*[F.lit(o) for o in _OPS]), (k % len(_OPS) + 1).cast("int"))
    value = F.element_at(F.array(*[F.lit(v) for v in _VALUES]), (F.floor(k / len(_OPS)) % len(_VALUES) + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("id"), R.value_type_ok(op, value).alias("ok"))


@query(
    "rv_action",
    """SELECT c_custkey::VARCHAR AS id, concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN 'Invalid regex pattern: (' END, CASE WHEN c_custkey % 3 = 0 THEN 'Invalid action type' END,
    CASE WHEN c_custkey % 4 = 0 THEN 'Action message is required' END, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'auto_fix needs a fix_value' END) AS errors FROM customer""",
)
def _(spark, d):
    """Rule drafts with faulty actions and patterns that do not compile."""
    k = T("c_custkey")
    condition = F.struct(F.lit("mrp").alias("field"), F.lit("regex").alias("operator"), F.when(k % 2 == 0, "(").otherwise("^x").alias("value"))
    kind = F.when(k % 3 == 0, "shout").when(k % 5 == 0, "auto_fix").otherwise("error")
    action = F.struct(kind.alias("type"), F.when(k % 4 != 0, "wrong").alias("message"), F.lit(None).cast("string").alias("fix_value"))
    fixed = {"name": "a good name", "description": "a description long enough", "rule_type": "custom", "category": "pricing", "severity": "low", "status": "draft"}
    drafts = table(spark, d, "customer").select(k.cast("string").alias("id"), *[F.lit(v).alias(n) for n, v in fixed.items()], F.array(condition).alias("conditions"), F.array(action).alias("actions"), F.array(F.lit("tag")).alias("tags"))
    return R.rule_errors(drafts).select("id", F.array_join("errors", "; ").alias("errors"))


# --- gates and small steps -----------------------------------------------------------------------------------------


@query("prj_title_fallback", "SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 't' || page_id::VARCHAR END, ''), url) AS title FROM pages")
def _(spark, d):
    title = F.when(T("page_id") % 3 == 0, "").when(T("page_id") % 3 == 1, F.concat(F.lit("t"), T("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", C.title_or(title, T("url")).alias("title"))


@query("id_counters", "SELECT o_orderkey, 'audit_' || lpad(o_orderkey::VARCHAR, 8, '0') AS audit_id, 'rule_' || lpad((o_orderkey % 1000)::VARCHAR, 6, '0') AS rule_id FROM orders")
def _(spark, d):
    k = T("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", C.counter_id("audit_", 8, k).alias("audit_id"), C.counter_id("rule_", 6, k % 1000).alias("rule_id"))


@query("agg_batch_ocr", "SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_quantity > 10) AS successful, count(*) FILTER (l_quantity <= 10) AS failed FROM lineitem GROUP BY 1")
def _(spark, d):
    """Pictures of a batch, and how many were read and not."""
    ok = T("l_quantity") > 10
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))


@query("io_text_gate", "SELECT l_orderkey, string_agg(l_returnflag || l_partkey::VARCHAR, chr(10) ORDER BY l_partkey, l_suppkey, l_linenumber) AS text FROM lineitem WHERE length(l_returnflag || l_partkey::VARCHAR) > 5 GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("place"), F.concat(F.lit(" "), "l_returnflag", T("l_partkey").cast("string")).alias("text"))
    return C.joined_texts(rows.withColumn("text", F.trim("text")), "l_orderkey", "place")


@query("io_image_gate", "SELECT l_orderkey, l_linenumber, l_quantity * 40 >= 500 AND (l_linenumber % 2 = 0 OR l_quantity * 40 >= 1000) AS usable FROM lineitem")
def _(spark, d):
    kind = F.when(T("l_linenumber") % 2 == 0, "image/png").otherwise("text/html")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.usable_picture(kind, T("l_quantity") * 40).alias("usable"))


@query("src_image_bytes", "SELECT p_partkey, length(p_name)::INTEGER AS size FROM part")
def _(spark, d):
    """Names as base64 pictures with and without a data address before them, back to their bytes."""
    coded = F.concat(F.when(T("p_partkey") % 2 == 0, "data:image/png;base64,").otherwise(""), F.base64(T("p_name").cast("binary")))
    return table(spark, d, "part").select("p_partkey", F.octet_length(S.picture_of(coded)).alias("size"))


_ASKED = (("Hindi", "english"), ("klingon",), ("Tamil", "odia", "english"))


@query("oe_lang_string", "SELECT p_partkey, ['hin+eng', 'eng', 'tam+eng'][1 + p_partkey % 3] AS codes FROM part")
def _(spark, d):
    asked = F.element_at(F.array(*[F.array(*[F.lit(x) for x in a]) for a in _ASKED]), (T("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", C.language_codes(asked, C.LANGUAGES, ["eng", "hin", "tam"]).alias("codes"))


@query("ui_found_fields", DECLARED + f" SELECT audit_id, concat_ws(',', {', '.join(f'CASE WHEN {n} <> chr(32)[2:] THEN {q(n)} END' for n in _NAMED)}) AS found FROM declared")
def _(spark, d):
    names = {n: c for n, c in E.declarations(T("label_text"), T("category")).items() if n in _NAMED}
    rows = once(listings(spark, d).select("audit_id", "category", "label_text"), **names)
    return rows.select("audit_id", F.array_join(C.found_fields({n: T(n) for n in names})[0], ",").alias("found"))


@query("lim_urls", "SELECT l_orderkey, CASE WHEN count(*) * 10 > 50 THEN 'Maximum 50 URLs allowed, got ' || (count(*) * 10)::VARCHAR END AS error FROM lineitem GROUP BY 1")
def _(spark, d):
    """Too many addresses in one request are an error; none is left out."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count("*") * 10).alias("n"))
    return n.select("l_orderkey", C.refuse_over(50, "URLs", T("n")).alias("error"))


@query("lim_images", "SELECT l_suppkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) AS images FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 20 GROUP BY 1")
def _(spark, d):
    """The first twenty pictures of each listing in order of arrival."""
    pictures = table(spark, d, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("arrived"), T("l_partkey").cast("string").alias("picture"))
    return C.first_pictures(pictures, "l_suppkey", "arrived", "picture").select("l_suppkey", F.array_join("pictures", ",").alias("images"))
