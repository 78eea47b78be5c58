"""Rules as data, rate limits in pieces, vector joins and the clause index, against plain computations."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelaudit.operators import clauses as C
from labelaudit.operators import rate_limits as L
from labelaudit.operators import rule_tables as D
from labelaudit.operators import rules as R
from labelaudit.operators import scan
from labelaudit.operators import vector_join as V
from labelaudit.operators.joins import keyed_join
from labelaudit.plans import rule_queries as Q
from labelaudit.sources.tables import AS_OF

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def pieces(spark):
    """Sets how many partitions shuffles make."""
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rules_from_a_table_judge_as_compiled_ones(spark):
    now = F.lit(AS_OF).cast("timestamp_ntz")
    rows = Q.tried(spark, DATA).withColumn("category", F.lit("c"))
    rules = tuple(R.Rule(n, n, "", "custom", "c", "low", (c,), ("m",)) for n, (c, _) in Q.PREDICATES.items())
    got = {(r.id, r.rule_id): (r.passed, r.status) for r in D.judge(rows, D.rules_as_rows(spark, rules), "id", now).collect()}
    for name, (condition, _) in Q.PREDICATES.items():
        expected = {r.id: r.p for r in rows.select("id", R.test(condition, now).alias("p")).collect()}
        assert len(expected) > 1000
        assert {i: got[i, name] for i in expected} == {i: (p, "passed" if p else "warning") for i, p in expected.items()}


def test_rules_from_a_file(spark, tmp_path):
    """Nested paths, values of every type, and what is wrong with rules and values."""
    condition = lambda field, operator, value=None, other=None: {"field": field, "operator": operator, "value": value, "value_field": other}
    conditions = {
        "nested": condition("a.b.1.c", "eq", 5),
        "type": condition("a.b.1.c", "eq", "5"),
        "none": condition("a.b.9.c", "eq", None),
        "deep": condition("a.b.c.d", "exists", False),
        "dot": condition("a.b", "exists", True),
        "empty_list": condition("e", "exists", False),
        "true_is_one": condition("t", "eq", 1),
        "fields": condition("a.b.1.c", "lt", None, "n"),
        "list": condition("n", "in", [1, "x", 7.5]),
        "text": condition("s", "gt", "3"),
        "odd_pattern": condition("s", "regex", "(["),
        "possessive": condition("s", "regex", "4+"),
        "unknown": condition("s", "almost", 1),
        "no_number": condition("q", "gt", 1),
        "quote": condition("it's", "eq", "q"),
        "between_text": condition("n", "between", "1,9"),
        "between": condition("n", "between", [7, 8]),
    }
    rules = [{"id": k, "name": k, "category": "c", "severity": "high", "status": "active", "conditions": [v], "messages": ["m"]} for k, v in conditions.items()]
    rules += [{"id": "all", "name": "n", "category": "x", "severity": "low", "status": "active", "applicable_to": ["c", "c"], "conditions": [], "messages": None}]
    rules += [{"id": "off", "name": "n", "category": "c", "severity": "low", "status": "draft", "conditions": []}]
    (tmp_path / "rules.json").write_text("\n".join(map(json.dumps, rules)))
    doc = {"a": {"b": [{"c": 1}, {"c": 5}]}, "e": [], "t": True, "n": 7.5, "s": "4", "q": "abc", "it's": "q"}
    rows = spark.createDataFrame([(1, "c", json.dumps(doc)), (2, None, "{}"), (3, "other", "{}")], "id int, category string, j string").withColumn("d", F.parse_json("j"))
    out = D.judge(rows, D.read_rules(spark, str(tmp_path)), "id", F.lit(AS_OF).cast("timestamp_ntz"), doc="d").collect()
    assert {r.id for r in out} == {1} and len(out) == len(conditions) + 1
    passed = {r.rule_id for r in out if r.passed}
    assert passed == {"nested", "none", "deep", "dot", "empty_list", "true_is_one", "fields", "list", "text", "possessive", "quote", "between", "all"}
    assert {r.status for r in out if not r.passed} == {"failed"} and all(r.messages == ([] if r.passed else ["m"]) for r in out)
    assert D.judge(rows.limit(0), D.read_rules(spark, str(tmp_path)), "id", F.current_timestamp(), doc="d").count() == 0


def test_patterns_are_judged_by_the_engine_that_runs_them(spark):
    rows = spark.createDataFrame([("a++",), ("(?<x>a)\\k<x>",), ("(",), ("a{2,1}",), (None,), ("x\\z",)], "p string")
    assert [r.ok for r in rows.select(R.compiles(F.col("p")).alias("ok")).collect()] == [True, True, False, False, None, True]


def test_keyed_join_cuts_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(900)] + [(-1, None)], "id int, k string").repartition(5)
    table = spark.createDataFrame([("hot", 1), ("hot", 2), *[(f"k{i}", i) for i in range(30)]], "k string, v int")
    for how in ("inner", "left"):
        plain = sorted(map(str, rows.join(table, "k", how).select("id", "k", "v").collect()))
        for most in (10**6, 1):
            monkeypatch.setattr("labelaudit.operators.joins.at_most", lambda df, rows=0, most=most: df.limit(most + 1).count() <= most)
            assert sorted(map(str, keyed_join(rows, table, "k", how, heavy=50).select("id", "k", "v").collect())) == plain


def allowed_by_hand(rows, limit, seconds):
    state, out = {}, {}
    for key, seq, ts in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
        opened, used = state.get(key, (None, 0))
        if opened is None or (ts - opened).total_seconds() >= seconds:
            opened, used = ts, 0
        state[key] = opened, used + 1
        out[seq] = used + 1 <= limit
    return out


@pytest.mark.parametrize("trial", range(6))
def test_rate_limits_in_pieces(spark, pieces, trial):
    """One client in many pieces, several in one, windows longer than pieces and shorter than gaps."""
    rng = random.Random(trial)
    n, seconds, span, parts = [(3000, 60, 3000, 16), (2000, 5000, 30, 7), (2000, 7, 100_000, 16), (1, 5, 5, 3), (1500, 900, 3000, 16), (2500, 1, 50, 5)][trial]
    pieces(parts)
    start = dt.datetime(2020, 1, 1)
    rows = [(rng.choice([1, 1, 1, 1, 2, None, 3]) if trial % 2 else 5, i, start + dt.timedelta(seconds=rng.randrange(span))) for i in range(n)]
    frame = spark.createDataFrame(rows, "key long, seq long, ts timestamp_ntz").withColumn("allowed", F.lit("own"))
    out = L.anchored_limit(frame, 2, seconds)
    assert {r.seq: r.allowed for r in out.collect()} == allowed_by_hand(rows, 2, seconds)


def test_one_client_takes_many_tasks(spark, pieces):
    pieces(8)
    rows = spark.range(4000).select(F.lit("only").alias("key"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 3).cast("timestamp_ntz").alias("ts"))
    out = L.anchored_limit(rows, 5, 60)
    assert out.select(F.spark_partition_id()).distinct().count() >= 6
    assert out.where("allowed").count() == 4000 // 20 * 5
    assert L.anchored_limit(rows.limit(0), 5, 60).count() == 0


def nearest_by_hand(queries, vectors, k):
    by = {}
    for i, q in queries:
        best = {}
        for x, v in vectors:
            d = float(np.sqrt(((v - q) ** 2).sum()))
            best[x] = min(d, best.get(x, d))
        for x, d in best.items():
            by.setdefault(i, {})
            by[i][x] = min(d, by[i].get(x, d))
    return {i: [(x, round(d, 9)) for d, x in sorted((d, x) for x, d in b.items())[:k]] for i, b in by.items()}


@pytest.mark.parametrize(("n", "m", "dim", "block"), [(900, 200, 8, 50), (1, 5, 3, None), (1200, 150, 2, 64), (600, 100, 48, None)])
def test_vector_join(spark, n, m, dim, block):
    """Clusters, a third of all vectors equal, ties, repeated ids, and what takes no part."""
    rng = np.random.default_rng(n)
    v, q = (rng.normal(size=(k, dim)).round(1) + 4 * rng.integers(0, 5, (k, 1)) for k in (n, m))
    v[: n // 3] = v[0]
    vectors, queries = list(enumerate(v)), list(enumerate(q))
    vectors += [(3, v[-1] + 1), (3, v[-1] + 1)] if n > 1 else []
    queries += [(0, q[-1])]
    schema = "vec_id long, embedding array<double>, id int, block int"
    frame = lambda rows: spark.createDataFrame([(i, x.tolist(), 0, 0) for i, x in rows], schema)
    odd = spark.createDataFrame([(7, None, 0, 0), (8, [], 0, 0), (None, [1.0] * dim, 0, 0), (9, [float("nan")] * dim, 0, 0), (10, [1.0, None], 0, 0)], schema)
    out = V.vector_join(frame(queries), frame(vectors).unionByName(odd), 3, block=block).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.id, round(r.distance, 9)))
    assert got == nearest_by_hand(queries, vectors, 3)


def test_vector_join_leaves_blocks_out(spark):
    """Far clusters are not met: fewer pairs of query and block than there are."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2000, 4)) + 1000 * rng.integers(0, 8, (2000, 1))
    rows = V.usable(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>"), "vec_id", "embedding")
    pivots = v[:32]
    placed, blocks = V.blocks_of(rows, pivots, 100)
    asked = rows.withColumn("bound", F.lit(3.0))
    assert V.routed(asked, blocks, False).count() < 0.4 * 2000 * len(blocks.count) and blocks.count.sum() == 2000 == placed.count()
    empty = rows.limit(0).withColumnsRenamed({"id": "vec_id", "v": "embedding"})
    some = rows.withColumnsRenamed({"id": "vec_id", "v": "embedding"})
    assert V.vector_join(empty, some).count() == 0 and V.vector_join(some, empty).count() == 0


@pytest.mark.parametrize(("seed", "budget"), [(0, 1), (1, 50), (2, 2000), (3, 50)])
def test_clause_index(spark, seed, budget):
    """Common and rare words, queries that repeat, share nothing or are empty, clauses that repeat a key."""
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    clauses = [(rng.randrange(200) if seed == 3 else i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(300)] + [(None, "w1 w2"), (1000, None)]
    queries = [(i, rng.choice([None, "", "zzz", "w1", "w1 w2 W1"]) if i % 5 == 0 else " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(150)]
    table = spark.createDataFrame(clauses, "item_id long, text string")
    asked = spark.createDataFrame(queries, "k long, q string").withColumns({"found": F.lit(1), "term": F.lit("t"), "known": F.lit(2)})
    got = {r.k: r.clauses for r in scan.with_clauses(asked, table, F.col("q"), 3, budget=budget).collect()}
    split = lambda s: set((s or "").lower().split())
    by = {}
    for key, text in clauses:
        if key is not None:
            by.setdefault(key, set()).update(split(text))
    assert got == {i: [x for _, x in sorted((-len(split(s) & by[x]), x) for x in by)[:3]] for i, s in queries}
    assert {tuple(r.clauses) for r in C.with_clauses(asked, table.limit(0), F.col("q")).collect()} == {()}
