"""Queues, retrieval, pages, picture regions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.functions import duck as D
from labelaudit.functions import extract as E
from labelaudit.functions import html as H
from labelaudit.functions import patterns as P
from labelaudit.operators import queues as Q
from labelaudit.operators import rate_limits
from labelaudit.operators import regions as G
from labelaudit.operators import retrieval as V
from labelaudit.plans.registry import query
from labelaudit.plans.views import AUDITS, JOBS, LISTINGS, audits, jobs
from labelaudit.sources import files as S
from labelaudit.sources.tables import listings, table

_W = "WITH " + JOBS


@query("q_enqueue", _W + " SELECT url, job_id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY url ORDER BY job_id DESC) = 1")
def _(spark, d):
    return Q.latest(jobs(spark, d), "url", "job_id").select("url", "job_id", "status")


@query("agg_queue_stats", _W + " SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "processing", "completed", "failed")) + ", count(*) AS total FROM jobs")
def _(spark, d):
    return Q.stats(jobs(spark, d))


@query("q_priority", _W + " SELECT url, job_id, priority FROM jobs QUALIFY row_number() OVER (PARTITION BY url ORDER BY job_id) = 1 ORDER BY priority DESC, job_id LIMIT 10")
def _(spark, d):
    return Q.priority_order(jobs(spark, d), 10).select("url", "job_id", "priority")


@query("q_bounded", _W + " SELECT url, job_id, priority FROM jobs QUALIFY row_number() OVER (PARTITION BY url ORDER BY job_id) = 1 ORDER BY priority DESC, job_id LIMIT 20")
def _(spark, d):
    return Q.bounded_queue(jobs(spark, d), 20).select("url", "job_id", "priority")


@query(
    "q_overflow",
    """WITH RECURSIVE """
    + JOBS
    + """, c AS (SELECT rtrim(url, '/') AS url, min(job_id) AS job_id, arg_min(priority, job_id) AS priority FROM jobs GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY job_id) AS i FROM c),
    q(i, held) AS (
      SELECT 0::BIGINT, []::STRUCT(p INTEGER, j BIGINT, u VARCHAR)[]
      UNION ALL
      SELECT n.i, list_append(CASE WHEN len(held) >= 20 THEN list_sort(held)[:19] ELSE held END, {p: n.priority, j: n.job_id, u: n.url}) FROM q JOIN n ON n.i = q.i + 1
    ) SELECT x.u AS url, x.j AS job_id, x.p AS priority FROM (SELECT unnest(held) AS x FROM q WHERE i = (SELECT max(i) FROM q))""",
)
def _(spark, d):
    """A queue of twenty that drives one out at each arrival once it is full."""
    return Q.arriving_queue(jobs(spark, d), 20).select("url", "job_id", "priority")


@query("q_peek", _W + " SELECT job_id FROM jobs ORDER BY job_id LIMIT 10")
def _(spark, d):
    return jobs(spark, d).select("job_id").orderBy("job_id").limit(10)


@query("q_bulk", _W + " SELECT (job_id // 100)::BIGINT AS task, count(*) AS urls, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM jobs GROUP BY 1")
def _(spark, d):
    """Bulk tasks of a hundred addresses and how far each has come; also agg_bulk_progress."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return jobs(spark, d).groupBy(F.expr("job_id div 100").alias("task")).agg(F.count("*").alias("urls"), n("completed"), n("failed"))


@query("join_seen_anti", _W + " SELECT DISTINCT url FROM jobs WHERE priority = 10 AND url NOT IN (SELECT url FROM jobs WHERE priority = 1 AND status = 'failed')")
def _(spark, d):
    j = jobs(spark, d)
    return Q.unseen(j.where("priority = 10"), j.where("priority = 1 AND status = 'failed'")).select("url").distinct()


@query(
    "q_rate_limit",
    """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w(key, n, opened, used) AS (
      SELECT key, n, ts, 1 FROM e WHERE n = 1
      UNION ALL
      SELECT e.key, e.n, CASE WHEN e.ts >= w.opened + INTERVAL 3600 SECOND THEN e.ts ELSE w.opened END, CASE WHEN e.ts >= w.opened + INTERVAL 3600 SECOND THEN 1 ELSE w.used + 1 END
      FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1
    ) SELECT e.key, e.seq, e.ts, w.used <= 3 AS allowed FROM e JOIN w USING (key, n)""",
)
def _(spark, d):
    hits = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts")
    return rate_limits.anchored_limit(hits, 3, 3600)


@query("snk_unique_idx", "SELECT l_orderkey * 10 + l_linenumber AS key, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return Q.duplicates(table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")), "key")


@query(
    "snk_upsert",
    "SELECT o_orderkey AS id, o_orderdate AS changed, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_orderdate, 'X' FROM orders WHERE o_orderkey % 3 = 0",
)
def _(spark, d):
    now = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("changed"), F.col("o_orderstatus").alias("status"))
    return S.upsert(now, now.where("id % 3 = 0").withColumn("status", F.lit("X")), "id", "changed")


@query("snk_delete", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 0")
def _(spark, d):
    now = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return S.delete(now, now.where("id % 10 = 0"), "id")


@query(
    "per_keyword_quota",
    """WITH f AS (SELECT event_type AS keyword, 'u' || (user_id % 90)::VARCHAR AS url, event_id AS seq FROM events),
    q AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY seq) <= 4), u AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)
    SELECT keyword, url, seq FROM u ORDER BY seq LIMIT 20""",
)
def _(spark, d):
    found = table(spark, d, "events").select(F.col("event_type").alias("keyword"), F.concat(F.lit("u"), (F.col("user_id") % 90).cast("string")).alias("url"), F.col("event_id").alias("seq"))
    return Q.keyword_quota(found, 5, 20).select("keyword", "url", "seq")


# --- retrieval ---------------------------------------------------------------------------------------------

_TERMS = "the and of ou tion"


@query(
    "rg_overlap_topk",
    "SELECT doc_id, len(list_filter(['the', 'and', 'of', 'ou', 'tion'], lambda t: list_contains(regexp_split_to_array(lower(text), '\\s+'), t)))::INTEGER AS score FROM documents ORDER BY score DESC, doc_id LIMIT 10",
)
def _(spark, d):
    return V.overlap_top(table(spark, d, "documents"), _TERMS, 10)


@query("rg_vector_topk", "SELECT vec_id, round(list_distance(embedding::DOUBLE[], list_resize([1.0, -1.0]::DOUBLE[], 64, 0.5)), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10")
def _(spark, d):
    return V.vector_top(table(spark, d, "embeddings"), [1.0, -1.0] + [0.5] * 62, 10)


@query("rg_chunk")
def _(spark, d):
    return V.chunks(table(spark, d, "documents")).select("doc_id", "chunk_no", F.md5("chunk").alias("digest"))


@query(
    "rg_cache",
    """SELECT md5(concat_ws(',', count(*)::VARCHAR, sum(('0x' || substr(md5(text), 1, 8))::BIGINT)::VARCHAR, bit_xor(('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 15))::BIGINT)::VARCHAR)) AS digest
    FROM documents""",
)
def _(spark, d):
    return V.index_key(table(spark, d, "documents"))


# --- pages -----------------------------------------------------------------------------------------------------


@query("ss_title", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>\\s*(.*?)\\s*</title>', 1)) AS title FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", H.page_title(F.col("html")).alias("title"))


@query("ss_generic")
def _(spark, d):
    p = H.pages_to_products(table(spark, d, "pages"))
    return p.select("page_id", "title", "description", F.size("specifications").alias("specifications"), F.size("image_urls").alias("images"), F.md5("raw_text").alias("text_md5"))


@query("ss_route", "SELECT page_id, CASE WHEN contains(lower(url), 'amazon') THEN 'amazon' WHEN contains(lower(url), 'flipkart') THEN 'flipkart' ELSE 'generic' END AS route FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", H.route(F.col("url")).alias("route"))


@query("ss_clean_spec", "SELECT p_partkey, p_brand AS value FROM part")
def _(spark, d):
    """Brands written twice with direction marks, as some pages do."""
    twice = F.concat(F.col("p_brand"), F.lit(":  "), F.col("p_brand"), F.lit("‎ "))
    return table(spark, d, "part").select("p_partkey", H.clean_value(twice).alias("value"))


# --- picture regions: words and boxes made of line items ------------------------------------------------------------

_WORDS = """WITH w AS (SELECT l_orderkey AS image_id, l_linenumber AS region, l_partkey * 1000000 + l_suppkey AS seq, l_returnflag || l_partkey::VARCHAR AS word, l_quantity * 2 AS confidence FROM lineitem),
r AS (SELECT image_id, region, string_agg(word, ' ' ORDER BY seq, word) AS text, round(avg(confidence) / 100, 6) AS confidence FROM w WHERE confidence >= 60 GROUP BY 1, 2)
"""


def words(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("region"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("seq"),
        F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("word"),
        (F.col("l_quantity") * 2).alias("confidence"),
    )


@query("ao_region_words", _WORDS + "SELECT * FROM r")
def _(spark, d):
    return G.region_text(words(spark, d))


@query(
    "agg_ocr_confidence",
    _WORDS + """SELECT image_id, round(avg(confidence), 4) AS confidence, count(*) FILTER (confidence < 0.65) AS low_confidence,
    CASE WHEN round(avg(confidence), 4) >= 0.85 THEN 'HIGH_CONFIDENCE' WHEN round(avg(confidence), 4) >= 0.7 THEN 'MEDIUM_CONFIDENCE' WHEN round(avg(confidence), 4) >= 0.5 THEN 'LOW_CONFIDENCE' ELSE 'VERY_LOW_CONFIDENCE' END AS level FROM r GROUP BY image_id""",
)
def _(spark, d):
    return G.confidence(G.region_text(words(spark, d)))


@query("agg_word_conf", "SELECT l_orderkey AS image_id, round(avg(CASE WHEN l_quantity > 5 THEN l_quantity END), 4) AS mean FROM lineitem GROUP BY 1")
def _(spark, d):
    c = F.when(F.col("l_quantity") > 5, F.col("l_quantity")).otherwise(F.lit(-1.0))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.round(G.word_confidence(c), 4).alias("mean"))


@query("oe_best_version", "WITH t AS (SELECT l_partkey AS image_id, l_linenumber AS version, max(l_quantity) AS confidence FROM lineitem GROUP BY 1, 2) SELECT image_id, arg_max(version, confidence * 100 - version) AS version FROM t GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("image_id"), F.col("l_linenumber").alias("version")).agg(F.max("l_quantity").alias("confidence"))
    return G.best_version(t.withColumn("text", F.lit("x")), "image_id").select("image_id", "version")


def boxes(spark, d):
    k = F.col("l_partkey")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        (k % 1000).cast("int").alias("box_no"),
        (k % 97).cast("int").alias("x"),
        (F.col("l_suppkey") % 89).cast("int").alias("y"),
        (k % 40 + 5).cast("int").alias("width"),
        (k % 20 + 5).cast("int").alias("height"),
    )


_BOXES = """WITH RECURSIVE b AS (SELECT l_orderkey AS image_id, (l_partkey % 1000)::INTEGER AS box_no, (l_partkey % 97)::INTEGER AS x, (l_suppkey % 89)::INTEGER AS y,
  (l_partkey % 40 + 5)::INTEGER AS width, (l_partkey % 20 + 5)::INTEGER AS height FROM lineitem)"""


@query(
    "ao_merge_boxes",
    _BOXES
    + """, p AS (SELECT image_id, list({l: x, t: y, r: x + width, b: y + height} ORDER BY box_no, x, y, width, height) AS rects FROM b GROUP BY image_id),
    s(image_id, now, scan, kept, done) AS (
      SELECT image_id, rects[1], rects[2:], []::STRUCT(l INTEGER, t INTEGER, r INTEGER, b INTEGER)[], []::STRUCT(l INTEGER, t INTEGER, r INTEGER, b INTEGER)[] FROM p
      UNION ALL
      SELECT image_id, CASE WHEN len(scan) = 0 THEN kept[1] WHEN hit THEN {l: least(now.l, o.l), t: least(now.t, o.t), r: greatest(now.r, o.r), b: greatest(now.b, o.b)} ELSE now END,
             CASE WHEN len(scan) = 0 THEN kept[2:] ELSE scan[2:] END, CASE WHEN len(scan) = 0 THEN []::STRUCT(l INTEGER, t INTEGER, r INTEGER, b INTEGER)[] WHEN hit THEN kept ELSE list_append(kept, o) END,
             CASE WHEN len(scan) = 0 THEN list_append(done, now) ELSE done END
      FROM (SELECT *, w > 0 AND h > 0 AND w * h / least((now.r - now.l) * (now.b - now.t), (o.r - o.l) * (o.b - o.t))::DOUBLE > 0.5 AS hit
            FROM (SELECT *, scan[1] AS o, least(now.r, scan[1].r) - greatest(now.l, scan[1].l) AS w, least(now.b, scan[1].b) - greatest(now.t, scan[1].t) AS h FROM s WHERE now IS NOT NULL))
    ), f AS (SELECT image_id, unnest(done) AS o, generate_subscripts(done, 1) - 1 AS box_no FROM s WHERE now IS NULL)
    SELECT image_id, box_no::INTEGER AS box_no, o.l AS x, o.t AS y, o.r - o.l AS width, o.b - o.t AS height FROM f""",
)
def _(spark, d):
    return G.merge_boxes(boxes(spark, d))


@query(
    "ao_sort_boxes",
    _BOXES
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY box_no, x, y, width, height) AS k, avg(height) OVER (PARTITION BY image_id) * 0.5 AS reach FROM b),
    d AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, k) AS i, y + height // 2 AS centre FROM n),
    r(image_id, i, line, mid) AS (
      SELECT image_id, i, 0, centre FROM d WHERE i = 1
      UNION ALL
      SELECT d.image_id, d.i, CASE WHEN abs(d.centre - r.mid) < d.reach THEN line ELSE line + 1 END, CASE WHEN abs(d.centre - r.mid) < d.reach THEN r.mid ELSE d.centre END
      FROM r JOIN d ON d.image_id = r.image_id AND d.i = r.i + 1
    )
    SELECT d.image_id, d.box_no, r.line::INTEGER AS row, (row_number() OVER (PARTITION BY d.image_id ORDER BY r.line, d.x, d.i) - 1)::INTEGER AS position FROM d JOIN r ON r.image_id = d.image_id AND r.i = d.i""",
)
def _(spark, d):
    return G.reading_order(boxes(spark, d))


_REGION = {n: "coalesce(" + ", ".join(D.cap("label_text", p, g) for g in range(1, __import__("re").compile(p).groups + 1)) + ")" for n, p in P.REGION.items()}


@query(
    "ao_fields",
    LISTINGS
    + f" SELECT audit_id, '₹' || replace({_REGION['mrp']}, ',', '') AS mrp, {_REGION['net_quantity']} AS net_quantity, {D.strip(_REGION['country_of_origin'])} AS country_of_origin, "
    + f"{_REGION['batch_number']} AS batch_number, {D.strip(_REGION['manufacturer'])} AS manufacturer, CASE WHEN category = 'food' THEN {_REGION['fssai_license']} END AS fssai_license FROM listings",
)
def _(spark, d):
    got = E.region_fields(F.col("label_text"), F.col("category"))
    return listings(spark, d).select("audit_id", *[got[n].alias(n) for n in ("mrp", "net_quantity", "country_of_origin", "batch_number", "manufacturer", "fssai_license")])


_BARE = f"regexp_extract_all(label_text, {D.q('(?i)' + P.REGION_DATES)}, 0)"


@query(
    "ao_dates",
    LISTINGS
    + f", d AS (SELECT audit_id, category, {_REGION['manufacture_date']} AS m, {_REGION['expiry_date']} AS e, {_BARE} AS bare FROM listings)"
    + """ SELECT audit_id, coalesce(m, CASE WHEN m IS NULL AND e IS NULL AND NOT (len(bare) = 1 AND category = 'food') THEN bare[1] END) AS made,
          coalesce(e, CASE WHEN m IS NULL AND e IS NULL AND len(bare) = 1 AND category = 'food' THEN bare[1] WHEN m IS NULL AND e IS NULL THEN bare[2] END) AS expires FROM d""",
)
def _(spark, d):
    got = E.region_fields(F.col("label_text"), F.col("category"))
    return listings(spark, d).select("audit_id", got["manufacture_date"].alias("made"), got["expiry_date"].alias("expires"))


# --- sources and sinks -------------------------------------------------------------------------------------------------


@query("src_form_merge", "SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_partkey % 3 <> 0 THEN p_name END, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END, p_type) AS text FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", S.merged_text(F.when(k % 3 != 0, F.col("p_name")).otherwise(""), F.when(k % 4 != 0, F.col("p_brand")), F.col("p_type")).alias("text"))


@query("src_url_text", "SELECT p_partkey, concat(p_name, chr(10), chr(10), 'Brand: ', p_brand, chr(10), 'Size: ', p_size::VARCHAR, chr(10), p_type) AS text FROM part")
def _(spark, d):
    specs = F.create_map(F.lit("Brand"), "p_brand", F.lit("Size"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", S.page_text(F.col("p_name"), F.lit(None), specs, F.col("p_type")).alias("text"))


@query("src_point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("src_mongo_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.count("*").alias("n"))


@query(
    "snk_csv_service",
    AUDITS + " SELECT audit_id, product_name, category, compliance_score, risk_level, n_violations::INTEGER AS violation_count, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at FROM audits",
)
def _(spark, d):
    """The rows of the CSV, JSON and spreadsheet exports."""
    return S.export_rows(audits(spark, d))


@query("snk_pdf_service", AUDITS + " SELECT audit_id, product_name[1:30] AS product_name, format('{:,.1f}', compliance_score) AS score, risk_level FROM audits ORDER BY created_at DESC, audit_id LIMIT 20")
def _(spark, d):
    return S.printed_report(audits(spark, d))


@query("snk_pdf_legacy", AUDITS + " SELECT audit_id, concat('Product: ', product_name, chr(10), 'Seller: ', seller_id, chr(10), 'Score: ', compliance_score::VARCHAR, chr(10), 'Risk: ', risk_level) AS block FROM audits")
def _(spark, d):
    return S.text_report(audits(spark, d))
