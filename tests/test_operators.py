"""Worked examples, and what has no SQL."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from labelaudit.functions import explain
from labelaudit.functions import extract as E
from labelaudit.functions import html as H
from labelaudit.functions import market as M
from labelaudit.functions import text as X
from labelaudit.operators import queues as Q
from labelaudit.operators import rate_limits
from labelaudit.operators import regions as G
from labelaudit.operators import retrieval as V
from labelaudit.operators import rules as R
from labelaudit.operators import scan as C
from labelaudit.operators import scoring as S
from labelaudit.sources import files


def one(spark, column, **values):
    """The value of a column over one row of typed literals."""
    frame = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first().x


def test_licences(spark):
    for text, value in (("FSSAI 05123456789012", "05123456789012"), ("FSSAI 38123456789012", None), ("FSSAI 05423456789012", None)):
        got = one(spark, E.fssai(F.col("t")), t=text)
        assert (got and got.value) == value


def test_prices(spark):
    assert one(spark, E.price(F.col("t"))["value"], t="MRP Rs. 1,234.50") == 1234.5
    assert one(spark, E.price(F.col("t"))["formatted"], t="MRP Rs. 1,234.50") == "₹1,234.50"
    assert one(spark, E.price(F.col("t")), t="MRP 200000") is None


def test_dates(spark):
    at = lambda t, lenient=False: (lambda d: d and d.parsed)(one(spark, E.dates(F.col("t"), lenient)["expiry_date"], t=t))
    assert at("EXP 12/03/2024") is None
    assert at("EXP March 2024") == "2024-03-01"
    assert at("EXP 12/03/2024", True) == "2024-03-12"
    assert one(spark, E.ocr_date(F.col("t")), t="12/03/24") == "2024-03-12"
    assert one(spark, E.ocr_date(F.col("t")), t="12/03/70") == "1970-03-12"
    assert one(spark, E.ocr_date(F.col("t")), t="15 Mar 2024") == "2024-03-15"


def test_units_and_batches(spark):
    assert one(spark, E.batch(F.col("t")), t="Batch: A1") is None
    assert one(spark, E.unit_valid(F.col("t")), t="500g") is False
    assert one(spark, E.unit_valid(F.col("t")), t="500 g") is True
    assert one(spark, E.unit_valid(F.col("t"), True), t="500g") is True


def test_normalise(spark):
    assert one(spark, X.normalise(F.col("t")), t="  Net  Wt\t५०० gms , ok.Yes ") == "Net Wt\n500 g, ok. Yes"
    assert one(spark, X.normalise(F.col("t")), t=None) == ""


NOW = "2024-01-10 12:00:00"


def passed(spark, operator, value, actual):
    now = F.lit(NOW).cast("timestamp_ntz")
    return one(spark, R.test(R.Condition("a", operator, value), now), a=actual)


def test_predicates(spark):
    assert [passed(spark, "exists", True, a) for a in ("", None, "0", "x")] == [False, False, True, True]
    assert passed(spark, "ne", "x", None) is True
    assert passed(spark, "not_contains", "x", None) is True
    assert passed(spark, "between", [5, 10], "5") is True and passed(spark, "between", [5, 10], None) is False
    assert passed(spark, "gt", 3, "12d") is False
    assert passed(spark, "regex", "(", "x") is False
    assert passed(spark, "is_expired", True, "2024-01-01") is True and passed(spark, "is_expired", True, None) is False
    assert passed(spark, "days_until_expiry", -1, "2024-01-10") is True  # half a day ago is minus one day
    assert passed(spark, "no such operator", 1, "x") is False


def test_nested_path(spark):
    frame = spark.range(1).select(F.struct(F.array(F.lit(1), F.lit(2)).alias("b")).alias("a"))
    assert frame.select(R.path("a.b.1").alias("x"), R.path("a.b.7").alias("y")).first() == (2, None)


def test_service_risk(spark):
    levels = [one(spark, S.service_risk(F.col("s"), F.lit(0)), s=s) for s in (90.0, 89.9, 70.0, 50.0, 30.0, 29.0)]
    assert levels == ["compliant", "low", "low", "medium", "high", "critical"]
    assert one(spark, S.service_risk(F.col("s"), F.lit(1)), s=100.0) == "critical"


def test_deductions(spark):
    score = lambda *c: one(spark, S.deduction_score(F.array(*[F.lit(x) for x in c])), s="")
    assert (score("A"), score(*"BBBBB"), score("x")) == (60, 0, 95)
    flags = {name: F.lit(None).cast("string") for _, name, _ in S.FLAG_CHECKS} | {"is_imported": F.lit(None).cast("string")}
    assert one(spark, F.size(S.flag_violations(flags)), s="") == 7


def test_boxes(spark):
    boxes = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "image_id long, box_no int, x int, y int, width int, height int")
    merged = G.merge_boxes(boxes([(0, 0, 0, 10, 10), (1, 1, 1, 8, 8), (2, 20, 20, 10, 10), (3, 9, 9, 3, 3), (4, 7, 7, 4, 4), (5, 9, 9, 2, 2)]))
    assert sorted(tuple(r)[1:] for r in merged.collect()) == [(0, 0, 0, 11, 11), (1, 20, 20, 10, 10), (2, 9, 9, 3, 3)]
    placed = G.reading_order(boxes([(0, 50, 1, 10, 10), (1, 5, 2, 10, 10), (2, 0, 40, 10, 10)]))
    assert [(r.box_no, r.row) for r in placed.orderBy("position").collect()] == [(1, 0), (0, 0), (2, 1)]
    assert G.merge_boxes(boxes([])).count() == 0 == G.reading_order(boxes([])).count()


def test_split_text():
    text = "\n\n".join("word " * n for n in (30, 90, 200))
    pieces = V.split_text(text.strip())
    assert all(len(p) <= 500 for p in pieces) and "".join(pieces).replace(" ", "").replace("\n", "") .count("word") >= 320
    assert V.split_text("") == []


def test_overlap(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b a"), (3, "c")], "doc_id long, text string")
    assert [r.doc_id for r in V.overlap_top(chunks, "a b", 2).collect()] == [2, 1]


def test_html():
    page = H.read_page(
        "http://x/y/", "<title> A &amp; B </title><p>first <b>bold</b></p><table><tr><th>Size</th><td>5 g</td></tr><tr><td>Size</td><td>6 g</td></tr></table>"
        "<ul><li>Origin: India</li><li>none</li></ul><img src='i.png'><img data-src='http://z/j.png'><script>no()</script>"
    )
    assert page["title"] == "A & B" and page["description"] == "first bold"
    assert page["specifications"] == {"Size": "5 g", "Origin": "India"}
    assert page["image_urls"] == ["http://x/y/i.png", "http://z/j.png"] and "no()" not in page["raw_text"]
    assert H.read_page("", None)["title"] is None


def test_rate_limit(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    hits = spark.createDataFrame(pd.DataFrame({"key": [1] * 5, "seq": range(5), "ts": [t(s) for s in (0, 10, 20, 59, 61)]})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.allowed for r in rate_limits.anchored_limit(hits, 2, 60).orderBy("seq").collect()] == [True, True, False, False, True]


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text('seller_id,product_name\ns1,"a ""b"", c"\ns2,\n')
    rows = files.read_batch_csv(spark, str(tmp_path)).orderBy("seller_id").collect()
    assert [tuple(r) for r in rows] == [("s1", 'a "b", c', "", ""), ("s2", "", "", "")]


def test_match_positions(spark):
    text = "x MRP: Rs. 45.50 only\nMade in India. MRP 9"
    m = one(spark, E.label_match(F.col("t"), "mrp"), t=text)
    assert (m.value, text[m.start : m.end], m.pattern_no) == ("45.50", "MRP: Rs. 45.50", 0)
    m = one(spark, E.label_match(F.col("t"), "country"), t=text)
    assert (m.value, text[m.start : m.end]) == ("India", "Made in India")  # the full stop is only looked at
    assert one(spark, E.label_match(F.col("t"), "mrp"), t="nothing") is None
    veg = one(spark, E.label_match(F.col("t"), "veg_status"), t="100% vegetarian")  # no group: the whole match
    assert (veg.value, veg.full_match, veg.start) == ("100% vegetarian", "100% vegetarian", 0)


def test_explanations(spark):
    answer = lambda t: tuple(one(spark, explain.answered(F.col("t")), t=t))
    assert answer('```JSON\n{"explanation": "a", "suggested_correction": {"x": 1, "y": [2]}, "risk_summary": null}\n```') == ("a", "x: 1\ny: [2]", explain.FALLBACK[2])
    assert answer('Well, {"explanation": [" p ", "", "q"]} so') == ("p\nq", *explain.FALLBACK[1:])
    assert answer("plain words") == ("plain words", *explain.FALLBACK[1:])
    assert answer("") == ("No model explanation returned.", *explain.FALLBACK[1:])
    assert tuple(one(spark, explain.explained(F.array()), t="")) == explain.NO_VIOLATIONS
    assert tuple(one(spark, explain.explained(F.array(F.lit("v"))), t="")) == explain.NO_MODEL


def test_marketplaces():
    page = M.amazon("https://a.example/dp/1", """<meta property="og:title" content="meta title"><span id="productTitle"></span>
      <span data-a-strike="true"> 120 </span><div id="productDetails_db_sections"><table><tr><th>Maker :</th><td>A  B: A  B</td></tr><tr><td>no head</td></tr></table></div>
      <div id="prodDetails"><table><tr><th>Maker</th><td>later</td></tr></table></div><table class="a-normal a-spacing-micro"><tr><td>Colour</td><td>red</td></tr></table>
      <div id="important-information"><b>Warning:</b><p>ok</p><p>12345678901234 is the number</p></div>
      <img id="landingImage" data-a-dynamic-image='{"https://i.example/s.jpg": [10, 10], "https://i.example/l.jpg": [100, 90]}' src="https://i.example/l._SX1_.jpg">
      <script type="text/javascript">x = {"hiRes":"https://i.example/h.jpg","large":"https://i.example/icon.png"}</script>""")
    assert page["title"] == "meta title" and page["description"] is None
    assert page["specifications"] == {"Maker": "A B", "Colour": "red", "Warning": "12345678901234 is the number", "FSSAI License Number": "12345678901234", "MRP": "120"}
    assert page["image_urls"] == ["https://i.example/l.jpg", "https://i.example/h.jpg"]
    page = M.flipkart("https://f.example", '<span class="B_NuCI">T</span><div class="_30jeq3 _16Jk6d">9</div><img class="_2r_T1I _396QI4" data-src="https://rukmini.flipkart.example/image/12/12/x.jpg">')
    assert (page["title"], page["specifications"], page["image_urls"]) == ("T", {"Selling Price": "9"}, ["https://rukmini.flipkart.example/image/832/832/x.jpg"])
    assert M.amazon("", None)["image_urls"] == [] and M.flipkart("", "")["title"] is None


def test_rule_value_types(spark):
    ok = lambda operator, value: one(spark, R.value_type_ok(F.col("o"), F.col("v")), o=operator, v=value)
    assert [ok("gt", v) for v in ("5", '"5.5"', '"x"', "[1]", "null", "true")] == [True, True, False, False, False, True]
    assert [ok("length_eq", v) for v in ("5", '"5"', '"5.5"', "5.5")] == [True, True, False, True]
    assert [ok("between", v) for v in ("[1, 2]", "[1]", '"1,2"')] == [True, False, False]
    assert (ok("exists", "true"), ok("exists", '"true"'), ok("in", "[]"), ok("regex", "5"), ok("eq", "null")) == (True, False, True, False, True)


def test_rule_packs(spark, tmp_path):
    (tmp_path / "packs.json").write_text('{"categories": {"food": {"name": "Food", "description": "d",\n "rules": [{"code": "F-1", "field": "mrp", "mandatory": true, "penalty": 25, "message": "m"}, {"code": "F-2", "field": "x", "penalty": 1}]}}}')
    rows = R.read_rule_packs(spark, str(tmp_path / "packs.json")).orderBy("code").collect()
    assert [(r.category, r.code, r.mandatory, r.penalty, r.message) for r in rows] == [("food", "F-1", True, 25, "m"), ("food", "F-2", None, 1, None)]
    assert R.read_rule_packs(spark, str(tmp_path / "none.json")).count() == 0


def test_sinks(spark, tmp_path):
    jobs = spark.createDataFrame([("u", 1), ("v", 2)], "url string, priority int")
    for _ in range(2):
        files.push(jobs, str(tmp_path / "queue"))
        files.insert(jobs, str(tmp_path / "table"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "queue")).collect()) == ['{"url":"u","priority":1}'] * 2 + ['{"url":"v","priority":2}'] * 2
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus/b.txt").write_text("bb\nb")
    before = {r.text: r.doc_id for r in files.read_corpus(spark, str(tmp_path / "corpus")).collect()}
    (tmp_path / "corpus/a.txt").write_text("a")
    after = {r.text: r.doc_id for r in files.read_corpus(spark, str(tmp_path / "corpus")).collect()}
    assert set(after) == {"a", "bb\nb"} and after["bb\nb"] == before["bb\nb"]


def test_gates(spark):
    assert [one(spark, C.usable_picture(F.col("k"), F.lit(n)), k=k) for k, n in (("image/png", 499), ("image/png", 500), ("text/html", 999), ("text/html", 1000), (None, 999))] == [False, True, False, True, False]
    assert one(spark, C.refuse_over(50, "URLs", F.lit(51)), t="") == "Maximum 50 URLs allowed, got 51" and one(spark, C.refuse_over(50, "URLs", F.lit(50)), t="") is None
    assert one(spark, C.title_or(F.col("t"), F.lit("n")), t="") == "n"
    texts = spark.createDataFrame([(1, 2, "second"), (1, 1, " first text "), (1, 3, "  abc  ")], "k int, n int, text string")
    assert C.joined_texts(texts, "k", "n").first().text == " first text \nsecond"


def ended(q):
    """A stream that does not end within two minutes fails the test."""
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    from labelaudit.streaming import live

    rows = [(i % 3, i, dt.datetime(2024, 1, 1 + i // 4, i)) for i in range(12)]
    spark.createDataFrame(rows, "key long, seq long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, seq long, ts timestamp").parquet(str(tmp_path / "in"))
    q = live.rate_limited(stream, 2, 3600 * 24 * 30).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    ended(q)
    assert spark.sql("SELECT count_if(allowed), count(*) FROM limited").first() == (6, 12)
    sink = live.upsert_into(str(tmp_path / "state"), "key", "seq")
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    ended(q)
    state = lambda: sorted((r.key, r.seq) for r in files.versioned(spark, str(tmp_path / "state")).collect())
    assert state() == [(0, 9), (1, 10), (2, 11)]
    later = spark.createDataFrame([(1, 50, dt.datetime(2024, 2, 1)), (7, 1, dt.datetime(2024, 2, 1)), (0, 2, dt.datetime(2024, 2, 1))], "key long, seq long, ts timestamp")
    for number in (0, 0, 1):  # another run that begins anew, and a batch that comes twice
        live.upsert_into(str(tmp_path / "state"), "key", "seq")(later.where("key <> 0"), number)
        assert state() == [(0, 9), (1, 50), (2, 11), (7, 1)]
    audits = stream.select(F.col("ts").alias("created_at"), F.lit(1.0).alias("compliance_score"))
    q = live.daily_trend(audits).writeStream.format("memory").outputMode("complete").queryName("days").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    ended(q)
    assert spark.sql("SELECT count(*), sum(audits) FROM days").first() == (3, 12)
