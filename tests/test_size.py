"""What must hold on larger tables: work is dealt over tasks, and nothing wide goes through the driver."""

import random

import numpy as np
from pyspark.sql import functions as F

from labelaudit import plans
from labelaudit.functions import extract as E
from labelaudit.functions import market as M
from labelaudit.functions import patterns as P
from labelaudit.functions import text as X
from labelaudit.functions.needs import may_match, needs
from labelaudit.operators import clauses as K
from labelaudit.operators import rules as R
from labelaudit.operators import scan as C
from labelaudit.operators import vector_join as V
from labelaudit.plans import scan_queries
from labelaudit.sources import tables

DATA = "/root/testdata/sf0.001"


def test_page_elements_are_slices():
    page = M.tree('<div id="a"><p id="b">x<br id="c"><b id="d">y</div><p id="b">z')  # p and b are never closed
    assert [e.attrs["id"] for e in page.walk()] == ["a", "b", "c", "d", "b"]
    assert [e.attrs["id"] for e in page.one(id="a").walk()] == ["b", "c", "d"]
    assert page.ids()["b"] is page.all("p")[0] and page.ids()["c"].walk() == [] and page.all("p")[1].walk() == []


def test_pages_and_listings_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 5)
    parts, orders = tables.table(spark, DATA, "part").count(), tables.table(spark, DATA, "orders").count()
    assert scan_queries._pages(spark, DATA, [F.lit("")]).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-parts // 5))
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    # a broadcast of the few parts and suppliers leaves the listings where they were dealt
    assert tables.listings(spark, DATA).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-orders // 50))


def test_rules_whose_ids_repeat_are_all_selected(spark):
    rows = [("r1", "brand#1", ["all"], "active"), ("r1", "brand#2", ["x", "all"], "active"), ("r1", "brand#1", ["x"], "active"), ("r2", "brand#2", ["x"], "active"), ("r3", "brand#1", ["x"], "draft")]
    rules = spark.createDataFrame(rows, "id string, category string, applicable_to array<string>, status string")
    assert [r.id for r in R.select_rules(rules, category="brand#1", or_all=True).collect()] == ["r1"] * 3
    assert R.select_rules(rules, category="brand#1").count() == 2


def test_mean_confidence_does_not_hang_on_the_order_of_arrival(spark):
    rows = [(1, i, "t", c / 100.0) for i, c in enumerate((3, 95, 83, 99))] + [(2, 0, "t", None)]
    for order in (rows, rows[::-1]):
        regions = spark.createDataFrame(order, "image_id long, region int, text string, confidence double").coalesce(1)
        found = {r.image_id: (r.confidence_level, r.needs_review, r.confidence_score) for r in C.picture_scan(regions, []).collect()}
        assert found[1] == ("MEDIUM_CONFIDENCE", False, 0.7) and found[2][2] is None


def test_a_field_is_captured_once(spark):
    """Plans name a pattern once per use; each use runs it over the text."""
    label = spark.createDataFrame([("MFG Jan 2001\nEXP 5 March 2002\nBest Before May 2003\nMFD 3 Sept 2001",)], "t string")
    plan = lambda c: label.select(F.inline(F.array(F.struct(c.alias("c")))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(E.price_value(F.col("t"))).count("MRP") == 1 and plan(E.country(F.col("t"))).count("Made") == 1
    assert plan(E.ocr_dates(F.col("t"))).count("PKD") == 1
    # a label's place: whether and where it matches, the match, its value
    assert plan(E.label_match(F.col("t"), "batch")).count("(?is)") == 3
    dates = label.select(E.ocr_dates(F.col("t")).alias("d")).first().d
    assert (dates.manufacturing_date, dates.expiry_date, dates.shelf_life_months) == ("2001-01-01", "2003-05-01", None)


def test_units_of_texts_with_and_without_spellings(spark):
    rows = spark.createDataFrame([("5 Gms, 2 KGS 3 ltrs",), ("9 g",), ("",), (None,)], "t string")
    assert [r.t for r in rows.select(X.units(F.col("t")).alias("t")).collect()] == ["5 g, 2 kg 3 L", "9 g", "", None]
    assert rows.select(X.strip(F.lit(" \n\t\x0b\f\ra b\r\n ")).alias("t")).first().t == "a b"


def test_word_lists_are_not_broadcast(spark):
    turns, documents = tables.table(spark, DATA, "conversations"), tables.table(spark, DATA, "documents")
    found = K.with_clauses(turns.limit(40), documents.limit(30), F.col("text"), 3, key="doc_id")
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert all(len(r.clauses) == 3 for r in found.collect())


def test_blocks_of_vectors_do_not_grow_in_number():
    """A query may go to every block, so with as many blocks as vectors / 512 what is shuffled was quadratic."""
    assert all(n / V.block_size(n) <= V.BLOCKS for n in (1, 10_000, 600_000, 2_000_000))
    assert V.block_size(10**12) * V.MAX_BLOCKS >= 10**12 - V.MAX_BLOCKS


def test_a_category_is_inferred_without_extraction(spark):
    plan = plans.QUERIES["ca_infer"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FSSAI" not in plan and "Generate" not in plan


def test_patterns_are_left_out_only_where_they_cannot_match(spark):
    """Each pattern is asked for words first; every text it matches must hold them."""
    assert needs(r"(?:Warranty|Guarantee)\s*[:\-]?\s*([0-9]+)") == (("guarantee", "warranty"),)
    assert needs(r"(?:EXP|BB)\s*(?:JAN|FEB)?\d") == (("bb", "exp"),) and needs(r"\b(\d{14})\b") == () and needs(r"(?:x|₹)?a*") == ()
    texts = ["Expiry Date: 01/02/2003", "exp 3 mar 2004", "ＭＲＰ mrp rs. 5", "price ₹ 7", "MADE IN INDİA", "NET WT 5 KG", "contents: 5 g", "b. no. AB12", "n.w. 3 ml", "नेट वजन 5 g", "", "S/N: ABC123"]
    patterns = [p for fields in (P.UNIVERSAL, P.FOOD, P.ELECTRONICS, P.COSMETICS) for ps in fields.values() for p in ps] + [p for _, ps in P.LABEL.values() for p in ps]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        wrong = rows.select(F.col("t").rlike(f"(?i){p}").alias("found"), may_match(F.col("t"), p).alias("may")).where("found AND NOT may")
        if needs(p):
            assert wrong.count() == 0, p
    assert "contains" in rows.select(E.capture(F.col("t"), r"Warranty\s*(\d+)"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_only_what_a_pack_asks_for_is_extracted(spark):
    plan = plans.QUERIES["vs_pack"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Voltage" not in plan and "Storage" not in plan and "Warranty" not in plan and "Manufacturer" in plan


def test_runs_of_spaces_are_what_is_replaced(spark):
    rows = spark.createDataFrame([("  a  b c   ",), (" ",), (None,)], "t string")
    assert [r.t for r in rows.select(X.whitespace(F.col("t")).alias("t")).collect()] == ["a b c", "", None]


def _shuffled(spark) -> int:
    """Rows written to shuffles by all stages so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_clauses_that_share_common_words_are_no_rows(spark, monkeypatch):
    """Each of the clauses shares words with each of the queries; many blocks of each meet."""
    monkeypatch.setattr(K, "LEAST_BYTES", 9_000, raising=False)
    monkeypatch.setattr(K, "QUERY_BYTES", 9_000, raising=False)
    rng = random.Random(5)
    texts = lambda n, most: [(i, " ".join(rng.sample([f"w{j}" for j in range(60)], rng.randrange(20, most)))) for i in range(n)]
    clauses, queries = texts(400, 60), texts(300, 40)
    before = _shuffled(spark)
    found = K.with_clauses(spark.createDataFrame(queries, "k long, q string"), spark.createDataFrame(clauses, "item_id long, text string"), F.col("q"))
    got = {r.k: r.clauses for r in found.collect()}
    assert _shuffled(spark) - before < 40_000  # of 120,000 pairs, all of which share words
    held = {i: set(t.split()) for i, t in clauses}
    assert got == {i: [x for _, x in sorted((-len(set(t.split()) & held[x]), x) for x in held)[:3]] for i, t in queries}


def test_a_block_is_worked_on_in_pieces(monkeypatch):
    """Queries with and without a bound, words that no clause has, rare and common ones; one query or a few at once."""
    rng = np.random.default_rng(2)
    has = rng.random((90, 200)) < np.linspace(0.01, 0.9, 90)[:, None]
    has = has[np.argsort(has.sum(axis=1), kind="stable")]
    asks = rng.random((40, 90)) < 0.4
    shared = asks.astype(int) @ has.astype(int)
    who, word = np.nonzero(asks)
    who, word = np.append(who, [0, 7]), np.append(word, [-1, -1])
    starts, members = np.concatenate([[0], np.cumsum(has.sum(axis=1))]), np.nonzero(has)[1].astype(np.int32)
    for least in (np.ones(40, np.int32), (np.sort(shared, axis=1)[:, -3] - np.arange(40) % 3).astype(np.int32), np.full(40, 99, np.int32)):
        wanted = {(q, c, shared[q, c]) for q in range(40) for c in sorted(range(200), key=lambda c: (-shared[q, c], c))[:3] if shared[q, c] >= least[q]}
        for step, size in ((1, 1), (5_000, 64), (1 << 20, 1 << 20)):
            monkeypatch.setattr(K, "STEP", step)
            monkeypatch.setattr(K, "STEP_BYTES", size)
            assert set(zip(*[x.tolist() for x in K.best(starts, members, 200, who, word, least, 3)], strict=True)) == wanted
