"""Merkle manifest, importance resampling and toxicity, and repeated ids in mixing and neighbours, against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelaudit.llm import merkle, mixing, neighbours, resampling, simhash, toxicity

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, g string, h string, payload string, part int, score double"


def rows_of(n, seed=2):
    rng = random.Random(seed)
    rows = [(i, f"Text {rng.randrange(10**6)} of N{i}" * rng.randrange(1, 4), "en", "hot" if i % 3 else rng.choice([None, "", "a", "é", "b" * 40]), i, "g", "h", "p", 1, 0.5) for i in range(n)]
    rows += [(None, "no id", None, "hot", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows + [rows[1], rows[1], (1, "other TEXT of one", "en", "hot", 3, "", "", "", 0, 0.0), (10**12, "", "", "only here", 0, "", "", "", 0, 0.0)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, fanout):
    """(doc_id, leaf, subroot, root, proof, folded root) by plain recursion over sorted lists."""

    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def tree(nodes):  # the root, and each node's steps to it
        steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, k in enumerate(at):
                run = k // fanout
                some = level[run * fanout : (run + 1) * fanout]
                steps[i].append((k % fanout, some[: k % fanout] + some[k % fanout + 1 :]))
                at[i] = run
            level = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
        return level[0], steps

    by = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n_chars = r[:5]
        lower = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        mine = leaf(doc_id, text, lang, source, n_chars)
        by[source].append(((doc_id is not None, doc_id or 0, mine), doc_id, mine, leaf(doc_id, lower, lang, source, n_chars) if bad else mine))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort()
        trees[s] = tree([x[2] for x in by[s]])
    root, above = tree([trees[s][0] for s in sources])
    out = Counter()
    for s, up in zip(sources, above, strict=True):
        subroot, steps = trees[s]
        for (_, doc_id, mine, used), own in zip(by[s], steps, strict=True):
            path = own + up
            node = used
            for pos, others in path:
                node = sha("".join(others[:pos] + [node] + others[pos:]))
            out[doc_id, mine, subroot, root, sha("".join(x for _, o in path for x in o)), node, node == root] += 1
    return out


@pytest.mark.parametrize(("n", "fanout", "parts"), [(0, 16, 4), (1, 16, 4), (300, 2, 7), (700, 3, 13), (1200, 16, 5)])
def test_merkle(spark, n, fanout, parts):
    """Sources that lie in many partitions and many sources in one, levels of every number, repeated rows."""
    rows = rows_of(n) if n else []
    rows = rows[:1] if n == 1 else rows
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = merkle.proofs(spark.createDataFrame(rows, SCHEMA).repartition(3), fanout).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(r[c] for c in names) for r in out) == (brute_manifest(rows, fanout) if rows else Counter())
    if n > 1:
        assert {r.verified for r in out} == {True, False}


def test_merkle_many_sources(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 700:03}", i, None, None, None, None, None) for i in range(1000)]
    out = merkle.proofs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in out) == brute_manifest(rows, 16)


def brute_resampling(docs, target):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for i in range(len(w)) for k in (1, 2, 3) if i + k <= len(w)]

    s, t = Counter(), Counter()
    for r in docs:
        s.update(features(r[1])[1])
    for x in target:
        t.update(features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out, fit = [], []
    for r in docs:
        n, f = features(r[1])
        h = int(sha(f"42:{'' if r[0] is None else r[0]}")[:8], 16)
        weight = sum(gain[b] for b in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r[0], len(f), weight, score, None])
        fit += [(-score, r[0] is None, r[0] or 0, len(f), weight, len(out) - 1)] if n >= 20 else []
    for rank, (*_, k) in enumerate(sorted(fit)[: 5 * len(fit) // 100], 1):
        out[k][4] = rank
    return Counter(map(tuple, out))


def test_resampling(spark):
    """Texts that are split, on both sides of a chunk's end, and rows that repeat."""
    rng = random.Random(8)
    words = "rice OIL price, Élodie's año x9 ... b-c d_e 12.5 naïve".split()
    texts = [None, "", " ,.!", "one", "one two", "ONE two\tthree"] + [" ".join(rng.choices(words, k=rng.randrange(5, 400))) for _ in range(300)]
    docs = [(i, t, "en", "s", 1, None, None, None, None, None) for i, t in enumerate(texts)]
    docs += [docs[-1], docs[-1], docs[2], (None, texts[-1], *docs[0][2:]), (None, None, *docs[0][2:]), (5, texts[-2], *docs[0][2:]), (7, "...." * 300, *docs[0][2:])]
    target = ["Rice price naïve", None, "", "oil oil oil x9"]
    table = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    names = ("doc_id", "n_features", "weight", "score", "rank")
    for long, chunk in ((100, 7), (500, 1), (10**6, 50)):
        out = resampling.resample(frame, table, long=long, chunk=chunk).collect()
        assert Counter(tuple(r[c] for c in names) for r in out) == brute_resampling(docs, target)
    assert resampling.resample(spark.createDataFrame([], SCHEMA), table).count() == 0
    none = resampling.resample(frame, spark.createDataFrame([], "text string")).collect()
    assert Counter(tuple(r[c] for c in names) for r in none) == brute_resampling(docs, [])


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.op11_toxicity(spark, DATA)
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    score, label = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    assert ((score >= 0) & (score <= 1)).all() and all(r.predicted == (r.score >= 0.7) for r in rows)
    assert (score[label == 0] >= 0.7).mean() < 0.01  # clean documents are left alone
    assert (score[label == 1] >= 0.7).mean() > 0.7  # about a tenth of the labels is noise
    rank = np.argsort(np.argsort(score)) + 1
    bad = int(label.sum())
    assert (rank[label == 1].sum() - bad * (bad + 1) / 2) / (bad * (len(label) - bad)) > 0.93


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(rows_of(30), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.5 * 0.999 + 0.001 * 0.5}
    odd = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(0, 0, 1), (None, 1, 1), (3, 1, None)], none.schema)
    model = toxicity.train(docs, odd)
    assert not model.trees and toxicity.score(docs, model).count() == docs.count()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_features():
    words = toxicity.Words({"blorp-": 3.0, "zonk": 2.0})
    at = dict(zip(toxicity.FEATURES, toxicity.dense("You are an IDIOT!! What a m0r0n, s t u p i d blorpish zonk zonks sooo", words).tolist(), strict=True))
    assert at["hits"] == np.log1p(3) and at["near_second"] == np.log1p(1) and at["masked_hits"] == np.log1p(2)
    assert at["spaced_out"] and at["drawn_out"] and at["shouted"] and at["marks"] and at["learned"] > 0
    whole = "quiet text about rice " * 30_000
    assert toxicity.dense(whole + "idiot", words)[toxicity.FEATURES.index("hits")] == np.log1p(1)  # the very end counts
    assert not toxicity.dense(None, words).any() and not toxicity.dense("", words).any()


def test_isotonic_regression():
    rng = np.random.default_rng(3)
    m = rng.normal(size=400).round(1)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * m))).astype(float)
    knots, levels = toxicity.isotonic(m, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all()
    fitted = np.interp(m, knots, levels)
    assert abs(fitted.mean() - y.mean()) < 1e-9
    best = min(((np.where(m < c, a, b) - y) ** 2).sum() for c in np.unique(m) for a, b in [(y[m < c].mean() if (m < c).any() else 0, y[m >= c].mean())] if a <= b)
    assert ((fitted - y) ** 2).sum() <= best + 1e-9  # no rising step function of two levels is nearer


def test_mixing_comes_near_its_targets_where_ids_repeat(spark):
    rng = random.Random(1)
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(rng.randrange(5, 40)))
    rows = [(None if i % 2 else 7, text(i), "a" if i < 600 else "b") for i in range(1200)] + [(i, None, "b") for i in range(50)] + [(i, "", "c") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    for r in mixed.groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.max("size").alias("size")).collect():
        assert abs(r.taken - r.target) <= r["size"] or not r.source_size
    assert mixed.where("copies > 2").count() == 0
    taken = mixing.take(docs).where("text is null or text = ''").groupBy("doc_id", "source").count()
    assert taken.where("count > 2").count() == 0


def brute_nearest(rows, queries, k):
    by = {}
    for i, v in rows:
        by[i] = min(by.get(i, v), v)
    ids = sorted(by)
    m = np.array([by[i] for i in ids])
    out = {}
    for q in queries:
        score = neighbours.cosine(np.array(by[q]), m)
        best = sorted((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != q)[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


@pytest.mark.parametrize(("n", "dim", "seed"), [(300, 8, 1), (1000, 4, 2), (400, 2, 3)])
def test_neighbours_every_row_as_query(spark, n, dim, seed):
    """Five different ids for each query; with repeated ids, vectors and scores that tie."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).round(2 if dim > 2 else 1)
    v[~v.any(axis=1)] = 1.0
    rows = [(i, v[i].tolist()) for i in range(n)] + [(i, v[i + 1].tolist()) for i in range(0, 20, 4)] + [(n + i, (2 * v[i]).tolist()) for i in range(10)]
    frame = neighbours.one_each(neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    found = defaultdict(list)
    for r in sorted(neighbours.nearest(frame, frame).collect(), key=lambda r: r["rank"]):
        found[r.query_id].append((r.vec_id, r.score))
    expected = brute_nearest(rows, sorted({i for i, _ in rows}), 5)
    assert set(found) == set(expected)
    assert all(len({i for i, _ in x}) == 5 for x in found.values())
    same = sum(found[q] == expected[q] for q in expected)
    assert same >= 0.98 * len(expected)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.99 * 5 * len(expected)


def test_graph_search_names_no_node_twice():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        unit = neighbours.unit_rows(rng.normal(size=(40 + seed, 5)))
        found = neighbours.Graph(unit, degree=8, beam=16).search(unit, 16)
        assert all(len(set(f[f >= 0].tolist())) == (f >= 0).sum() for f in found)


def test_refuted_pairs_are_not_similar():
    """No pair of a similarity of 4/5 or more is refuted, and most others are."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 9000, np.uint64)
    sets = []
    for n in (0, 1, 3, 30, 63, 64, 65, 130, 600, 4000):
        for _ in range(6):
            base = rng.choice(pool, n, replace=False)
            sets.append(np.unique(base))
            for share in (0.05, 0.1, 0.11, 0.12, 0.2, 0.4):
                changed = base.copy()
                some = rng.choice(n, int(n * share), replace=False)
                changed[some] = rng.choice(pool, len(some))
                sets.append(np.unique(changed))
    refuted = simhash.Refuted(np.array([len(s) for s in sets]), [simhash.parity(s) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    keep = refuted.keep(a, b)
    true = np.array([5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert keep[true].all() and true.sum() > 100
    assert keep[~true].mean() < 0.05


def test_near_copies_in_rounds(spark, monkeypatch):
    """Many pairs for few components: the rounds find what a check of all pairs finds, also if the first pass finds little."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]

    def edited(words, n):
        words = list(words)
        for k in rng.sample(range(len(words)), n):
            words[k] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    rows = [(i, edited(base, rng.choice((0, 3, 5, 8, 12, 16, 25)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(simhash.shingle_digests(t, 5).tolist()) for i, t in rows}
    near = {i: {j for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    first = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in first:
                first[x] = i
                todo += near[x]
    assert 1 < len(set(first.values())) < 70
    for rounds in (1, 10**6):
        monkeypatch.setattr(simhash, "ROUND", rounds)
        assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == set(first.values())
    monkeypatch.setattr(simhash, "partners", lambda nodes, radius, chunk: nodes.select("fp", F.col("fp").alias("other")).limit(0))
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == set(first.values())


def test_components_of_a_long_chain_keep_a_small_plan(spark):
    n = 16
    names = [f"{(i * 7919) % 10007:05d}" for i in range(n)]  # along the chain in no order, so there are several rounds
    links = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "fp string, other string")
    label = simhash.connect(links)
    assert {r.fp: r.root for r in label.collect()} == dict.fromkeys(names, min(names))
    # each round's estimated size was the product of those before it: a number of thousands of digits
    assert label._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 40


def test_searches_for_near_copies_hold_little():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 4, np.uint64)
    items = base ^ (rng.integers(0, 2**64, (3000, 4), np.uint64) & rng.integers(0, 2**64, (3000, 4), np.uint64) & rng.integers(0, 2**64, (3000, 4), np.uint64))
    forest = simhash.Forest(items, np.zeros(3000, np.int64))
    refuted = simhash.Refuted(np.full(3000, 2000), [bytes(rng.integers(0, 256, 1024, np.uint8)) for _ in range(3000)])
    a, b = rng.integers(0, 3000, (2, 100_000))
    tracemalloc.start()
    pairs = sum(len(x) for x, _ in forest.apart(72, np.arange(3000)))
    searched = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    refuted.keep(a, b)
    compared = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = np.array([simhash.distance(items, items[[i]]) for i in range(3000)])
    assert pairs == np.triu(d <= 72, 1).sum() > 0
    assert searched < 60e6 and compared < 40e6, (searched, compared)
