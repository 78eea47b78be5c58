"""The registered training-data queries on the small tables."""

import os
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelaudit.llm import queries, simhash

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    ours = queries.QUERIES[name](spark, DATA)
    names = sorted(ours.columns)
    theirs = con.sql(f"SELECT {', '.join(names)} FROM ({queries.SQL[name]})")
    assert names == sorted(con.sql(queries.SQL[name]).columns)
    assert sorted(map(str, map(tuple, ours.select(*names).collect()))) == sorted(map(str, theirs.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_table(spark, name):
    table, key = {"op4": ("pages", "page_id"), "op9": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
    out = queries.QUERIES[name](spark, DATA)
    if name.startswith("op9"):
        assert out.groupBy("query_id").count().where("count <> 5").count() == 0 and {r[0] for r in out.select("query_id").collect()} == {i for i in ids if i % 50 == 0}
    else:
        assert {r[0] for r in out.select(key).collect()} == ids


def test_quality_held_out(spark):
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = queries.QUERIES["op1_quality"](spark, data).where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    rank = np.argsort(np.argsort(score)) + 1
    good = int(label.sum())
    auc = (rank[label == 1].sum() - good * (good + 1) / 2) / (good * (len(label) - good))
    assert auc > 0.9
    assert np.mean(np.array([r.predicted for r in rows]) == label) > 0.8


def test_neighbours_recall(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    ids, v = np.array([i for i, _ in rows]), np.stack([x for _, x in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = defaultdict(set)
    for r in queries.QUERIES["op9_neighbours"](spark, "/root/testdata/sf0.1").collect():
        found[r.query_id].add(r.vec_id)
    assert all(len(x) == 5 for x in found.values())
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[q]
        near[q] = -np.inf
        hits += len(found[ids[q]] & set(ids[np.argsort(-near)[:5]].tolist()))
        total += 5
    assert hits >= 0.9 * total


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept, held against what it must keep."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect() if name != "packing" else None
        out = stage(spark, docs, DATA)
        if name == "packing":
            assert out.agg(F.countDistinct("doc_id")).first()[0] == docs.select("doc_id").distinct().count()
            break
        assert out.columns == columns
        folder = os.path.join(tmp_path, name)
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
        kept = docs.collect()
        assert set(kept) <= set(before)
        seen[name] = len(kept)
        if name == "exact_dedup":
            fold = lambda t: (t or "").encode().lower()
            assert sorted(r.doc_id for r in kept) == sorted({fold(r.text): r.doc_id for r in sorted(before, key=lambda r: r.doc_id)}.values())
        if name == "near_dedup":
            sets = {r.doc_id: set(simhash.shingle_digests(r.text, 5).tolist()) for r in kept}
            ids = sorted(sets)
            close = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            assert not close
    assert seen["quality"] >= seen["exact_dedup"] >= seen["near_dedup"] > 0
    assert corpus_pipeline.run(spark, DATA).count() > 0
