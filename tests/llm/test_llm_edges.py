"""The training-data operators against brute force, on rows with every defined edge case."""

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from labelaudit.llm import exact_dedup, language, merkle, mixing, neighbours, packing, quality, queries, resampling, sharding, simhash, substring_dedup, token_files, tokens
from labelaudit.llm.common import skew_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, __own string, __digest string, __text string, h long, `a.b` string"
WORDS = "the price of rice and oil declared on this packet was checked by nobody else but Élodie für año".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


def made():
    rng = random.Random(4)
    base = prose(rng, 60)
    texts = [None, "", " ", "\t\n", "A", "a", base, base.upper(), base + " x", base.replace("price", "cost", 1), prose(rng, 30_000), "é" * 80, "É" * 80, "ab" * 200]
    passage = prose(rng, 25)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(8)]
    texts += ["same text here"] * 30 + [prose(rng, rng.randrange(1, 80)) for _ in range(40)]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 5}", 1, "o", "d", "t", i, "x") for i, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "hot", 1, "o", "d", "t", 7, "x"), (7, "another text of document seven", None, None, None, None, None, None, None, None)]
    rows += [(None, "same text here", None, None, None, None, None, None, None, None), (None, None, None, "", None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_skew_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(900)] + [(1000, None), (1001, "alone")], "id long, k string").repartition(7)
    table = spark.createDataFrame([(f"k{i}", i, 6) for i in range(60)] + [("hot", 99, 600)], "k string, v long, n long")
    for how in ("inner", "left"):
        plain = Counter(map(tuple, rows.join(table.drop("n"), "k", how).select("id", "k", "v").collect()))
        for least in (1, 10**6):
            assert Counter(map(tuple, skew_join(rows, table, "k", ["id"], how=how, least=least).select("id", "k", "v").collect())) == plain
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put small partitions together again
    try:
        dealt = skew_join(rows, table.hint("merge"), "k", ["id"], least=1).where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert dealt > 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_edge_rows_against_sql(docs, name):
    """Null ids, texts and sources, empty texts, repeated rows and ids."""
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    target = docs.sparkSession.createDataFrame([(t,) for t in ("Price of rice3 and oil", None, "", "the PRICE of")], "text string")
    con.register("benchmark", target.toArrow())
    operators = {
        "op2_sharding": sharding.shard_rows,
        "op7_exact_dedup": exact_dedup.exact_dedup,
        "op8_mixing": mixing.mix,
        "op12_merkle": merkle.proofs,
        "op13_resampling": lambda d: resampling.resample(d, target, long=300, chunk=20),
    }
    ours = operators[name](docs)
    names = sorted(ours.columns)
    shown = lambda rows: Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    assert shown(map(tuple, ours.select(*names).collect())) == shown(con.sql(f"SELECT {', '.join(names)} FROM ({queries.SQL[name]})").fetchall())


def test_mixing_fills_sources_in_the_order_of_cap_per_weight(spark):
    sizes = spark.createDataFrame([("=a", 1000), ("=b", 1001), ("=c", 40), ("=d", 7)], "src string, source_size long")
    weights, share = (5, 7, 1), 150
    left, w, capped = {"=a": 1000, "=b": 1001, "=c": 40, "=d": 7}, {"=a": 5, "=b": 7, "=c": 1, "=d": 5}, {}
    total = sum(left.values()) * share / 100
    while True:  # level by level, as the text of the contract says
        free = {k: (total - sum(capped.values())) * w[k] / sum(w[x] for x in left if x not in capped) for k in left if k not in capped}
        over = [k for k, t in free.items() if t > 2 * left[k]]
        if not over:
            break
        capped |= {k: 2.0 * left[k] for k in over}
    expected = {k: capped.get(k, free.get(k)) for k in left}
    got = {r.src: r.target for r in mixing.targets(sizes, share, weights).collect()}
    assert got == pytest.approx(expected)


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for r in made():
        groups[fold(r[1])].append(r[0])
    expected = Counter()
    for r in made():
        ids = groups[fold(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        expected[r[0], keep, len(ids), r[0] == keep, hashlib.sha256(fold(r[1]).encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == expected
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert Counter(fold(r.text) for r in left.collect()) == Counter(list(groups))
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_sharding(docs, empty):
    out = sharding.shard_rows(docs, 8, buckets=16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in made())
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(empty).count() == 0


def test_sharding_repeats_the_mixture(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    out = sharding.shard_rows(rows).join(rows.select("doc_id", "source"), "doc_id").groupBy("source", "shard").count().collect()
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r["count"])
    assert all(len(n) == 8 and max(n) - min(n) <= 2 for n in by.values())


def reference_fingerprint(text, k):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def smallest_reachable(fps, radius):
    """Per item, the smallest item that links lead to."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_simhash(docs, empty):
    rows = made()
    fps = [reference_fingerprint(r[1], 4) for r in rows]
    root = smallest_reachable(fps, 4)
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    expected = Counter((rows[i][0], f"{fps[i]:016x}", least[root[i]]) for i in range(len(rows)))
    assert Counter(map(tuple, simhash.components(docs).collect())) == expected
    assert simhash.components(empty).count() == 0


def test_simhash_links_clusters(spark):
    rng = random.Random(8)
    fps = []
    for _ in range(60):
        seed = rng.getrandbits(64)
        fps += [seed]
        for _ in range(rng.randrange(5)):
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            fps.append(seed)
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(f"{x:016x}",) for x in fps], "fp string")
    for chunk in (simhash.CHUNK, 3):  # shards cut into chunks that meet in pairs
        roots = dict(map(tuple, simhash.connect(simhash.link(frame, simhash.exact_masks(len(fps), 4), 4, chunk)).collect()))
        label = smallest_reachable(fps, 4)
        assert [roots.get(f"{x:016x}", f"{x:016x}") for x in fps] == [f"{fps[i]:016x}" for i in label]


def test_near_copies(docs, empty, spark):
    rng = random.Random(6)
    base = [prose(rng, 300) for _ in range(6)]
    near = [b.replace(b.split()[150], "changed", 1) for b in base]
    frame = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate([*base, *near, prose(rng, 300), ""])], "doc_id long, text string, __doc string, __tag string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(frame).collect()) == [0, 1, 2, 3, 4, 5, 12, 13]
    assert simhash.drop_near_copies(docs).columns == docs.columns
    assert simhash.drop_near_copies(empty).count() == 0


def test_near_copies_at_the_threshold(spark):
    rng = random.Random(12)
    texts, kept = [], []
    for n in (5, 10, 50, 200):
        for _ in range(12):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
            for shingles in (n * 4 // 5, n * 4 // 5 - 1):  # similar to 0.8 just, and less
                other = [f"{w}x" for w in words] if shingles < n * 4 // 5 else words
                kept += [len(texts)] + [len(texts) + 1] * (other != words)
                texts += [" ".join(other), " ".join(other[: shingles + 4])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(frame).collect()) == kept


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 3])
def test_near_copies_link_by_exact_similarity(spark, chunk):
    rng = random.Random(13)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        for _ in range(25):  # chains, with neighbours on both sides of 0.8
            at, n = rng.randrange(100), rng.randrange(4, 14)
            words = words[:at] + [f"w{rng.randrange(10**9)}" for _ in range(n)] + words[at + n :]
            texts.append(" ".join(words))
    sets = [set(simhash.shingle_digests(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 6 < len(set(root)) < len(texts)
    assert sorted(r.doc_id for r in simhash.drop_near_copies(frame, chunk=chunk).collect()) == sorted(set(root))


def without_repeats(rows, length=50):
    data = [(r[1] or "").encode() for r in rows]
    key = [r[0] if r[0] is not None else 1 << 62 for r in rows]
    first = {}
    for k, d in zip(key, data, strict=True):
        for p in range(len(d) - length + 1):
            s = d[p : p + length]
            first[s] = min(first.get(s, k), k)
    out = Counter()
    for r, k, d in zip(rows, key, data, strict=True):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if first[d[p : p + length]] < k:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        n_spans = int(np.diff(np.concatenate([[False], gone]).astype(int)).clip(0).sum())
        out[r[0], len(d), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_substring_dedup(docs, empty):
    assert Counter(map(tuple, substring_dedup.remove_repeats(docs).collect())) == without_repeats(made())
    assert substring_dedup.remove_repeats(empty).count() == 0
    spans = substring_dedup.remove_repeats(docs, with_kept=True).where("n_removed > 0").first()
    assert sum(s.end - s.start for s in spans.removed) == spans.n_removed


@pytest.mark.parametrize("how", [{}, {"hot": 3, "hold": 200, "flush": 500, "bucket": 2000}, {"hot": 1, "hold": 64, "flush": 50, "bucket": 10**6}, {"hot": 10**9, "hold": 100}, {"block": 64}])
def test_substring_dedup_opens_hot_digits(spark, how):
    rng = random.Random(1)
    words = "alpha beta gamma delta the of and price oil rice".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(n))
    passages = [text(20) for _ in range(3)]
    rows = [(i, text(rng.randrange(1, 40)) + rng.choice(passages)[: rng.randrange(120)] + text(rng.randrange(30))) for i in range(200)]
    rows += [(300 + i, "a" * rng.randrange(300)) for i in range(8)] + [(400 + i, "ab" * rng.randrange(150) + rng.choice(passages)) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, substring_dedup.remove_repeats(frame, **how).collect())) == without_repeats(rows)


def test_equal_digits_of_different_strings_are_told_apart(spark, monkeypatch):
    """Runs whose digits and digests all agree still differ by their bytes."""
    monkeypatch.setattr(substring_dedup, "row_digest", lambda rows, n: np.zeros(len(rows), np.uint64))
    rng = np.random.default_rng(9)
    parts, texts = [], rng.integers(97, 123, (300, 50), np.uint8)
    texts[200:] = texts[:100]
    for doc, data in enumerate(texts):
        _, rows, start, n = substring_dedup.cut_runs(data, 50, 14)
        one = np.ones(1)
        parts.append(substring_dedup.entries(np.zeros(1, np.uint64), rows, one * doc, one * 0, n, one, start))
    found = [what for kind, what in substring_dedup.settled(substring_dedup.joined(parts), 50, 10**6) if kind == substring_dedup.COVERED]
    assert sorted(d for spans in found for d in spans[0].tolist()) == list(range(200, 300))


@cache
def library():
    """The library's tokenizer as it comes, with no setting of ours."""
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encoded(text, end):
    return [*library().encode(text or "", add_special_tokens=False).ids, end]


def test_tokens_match_the_library():
    odd = ["a b", " a  b ", "x\n\ny", "tab\tx", "don't  stop", "für año​", "a\r\nb", "<|endoftext|>", "x <|endoftext|> y", "a<|endoftext|>b\nc d", "1 234 5.6", "日本 語", "end ", "\n", "a\n b", " x"]
    texts = [r[1] or "" for r in made()] + odd
    assert [x.tolist() for x in tokens.encode(texts, tokens.vocabulary_path())] == [encoded(t, 0)[:-1] for t in texts]


@pytest.mark.parametrize("window", [64, 2048])
def test_packing(docs, empty, window):
    out = packing.pack(docs, window=window, open_windows=4, with_ids=True).collect()
    whole, windows = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert r.length == len(ids) > 0 and r.ids_crc32 == zlib.crc32(ids.tobytes())
        windows[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id, r.doc_tokens].append((r.start, ids))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert sum(n for w in windows.values() for _, n in w) == sum(len(encoded(r[1], 1)) for r in made())
    twice = {(i, n) for (i, n), c in Counter((r[0], len(encoded(r[1], 1))) for r in made()).items() if c > 1}
    for i, text, *_ in made():
        ids = encoded(text, 1)
        if (i, len(ids)) not in twice:
            assert np.concatenate([x for _, x in sorted(whole[i, len(ids)], key=lambda p: p[0])]).tolist() == ids
    total = sum(n for w in windows.values() for _, n in w)
    assert len(windows) * window - total < window * (1 + 5)
    assert packing.pack(empty).count() == 0


def best_fit(docs, window, most):
    """Windows that leave a packer of `most` open ones, as lists of (doc_id, start, length), by plain search."""
    left, open_, made = [], {}, 0  # window number -> [room, pieces]
    for doc_id, size in docs:
        start = 0
        while size - start >= window:
            left.append([(doc_id, start, window)])
            start += window
        if start == size:
            continue
        need = size - start
        fits = [(room, k) for k, (room, _) in open_.items() if room >= need]
        if fits:
            k = min(fits)[1]
        else:
            if len(open_) >= most:
                left.append(open_.pop(min((room, n) for n, (room, _) in open_.items())[1])[1])
            k, made = made, made + 1
            open_[k] = [window, []]
        open_[k][1].append((doc_id, start, need))
        open_[k][0] -= need
        if open_[k][0] == 0:
            left.append(open_.pop(k)[1])
    return left


def test_packing_places_best_fit(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([1, 3, 8, 20, 40]))) for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=128, open_windows=5).collect()
    windows = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        windows[r.sequence_id].append((r.doc_id, r.start, r.length))
    expected = best_fit([(i, len(encoded(t, 1))) for i, t in rows], 128, 5)
    assert len(expected) > 50 and all(w in windows.values() for w in expected)
    assert len(windows) - len(expected) <= 5


@pytest.mark.parametrize("doc_id", [3, None])
def test_token_files_of_one_id(spark, tmp_path, doc_id):
    rows = [(doc_id, f"text number {i % 7}") for i in range(60)]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"file://{tmp_path}/one", file_ids=40)
    out = token_files.read_token_files(manifest, with_ids=True).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((i, tuple(encoded(t, 0))) for i, t in rows)
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]


def test_token_files_read_each_block_once(tmp_path):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 3000, 0, 9000, 12, 4096, 70_000, 5)]

    class Reader(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    source = Reader(token_files.dump(list(range(len(docs))), docs, 16))
    file = token_files.TokenFile(source)
    assert all((a == b).all() for a, b in zip(file.documents(at_once=8192), docs, strict=True))
    assert source.taken <= len(source.getvalue()) * 1.5


def test_token_files(docs, empty, spark, tmp_path):
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/files", file_ids=2000)
    out = token_files.read_token_files(manifest, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((r[0] for r in made()), key=lambda i: (i is not None, i or 0))
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((r[0], tuple(encoded(r[1], 0))) for r in made())
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in out)
    assert token_files.read_token_files(token_files.write_token_files(empty, f"file://{tmp_path}/none")).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003, np.uint64).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), len(ids), bits) == ids).all()


def test_mixing_takes_what_mix_says(docs, empty):
    planned = Counter()
    for r in mixing.mix(docs).collect():
        assert r.taken == r.size * r.copies <= 2 * r.size
        planned[r.doc_id] += r.copies
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert Counter(r.doc_id for r in taken.collect()) == +planned
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0


def test_word_count(spark):
    import re

    texts = ["", " ", "a", " a", "a ", " a\tb\n\x0bc\x0c\rd ", "x\x1fy z w", "\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(mixing.word_count(F.col("t"))).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_quality_edges(docs, empty, spark):
    labels = spark.createDataFrame([(10, 1, 0), (20, 0, 0), (21, 1, 1), (21, 0, 0), (None, 1, 0), (30, None, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    net = quality.train(docs, labels)
    out = quality.score(docs, net, ["doc_id"]).collect()
    assert len(out) == len(made()) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.score(docs, quality.train(docs, none), ["doc_id"]).collect()} == {0.5}
    assert quality.drop_rejected(docs, labels, 0.0).columns == docs.columns and quality.drop_rejected(docs, labels, 0.0).count() == len(made())
    assert quality.drop_rejected(empty, none).count() == 0


def test_quality_rejects_nothing_without_labels(docs, spark):
    for labels in ([], [(10**9, 1)], [(10, None)]):  # none, of no document, unusable
        assert quality.drop_rejected(docs, spark.createDataFrame(labels, "doc_id long, quality int")).count() == len(made())


def test_quality_learns_from_every_chunk():
    """What tells good from bad stands only near the end of long texts."""
    rng = random.Random(5)
    filler = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    label = np.array([i % 2 for i in range(120)], np.float32)
    texts = [filler(9000) + ("ZQXZQXZQX" if y else "") + filler(200) for y in label]
    net = quality.fit([t.encode() for t in texts], label, epochs=12, batch=8)
    p = quality.scores(net, texts)
    assert p[label == 1].min() > p[label == 0].max()


def test_quality_sample_is_bounded_by_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = quality.sample_labelled(docs.unionByName(docs).unionByName(docs.withColumn("text", F.lit("z"))), labels, rows=10).collect()
    assert len(rows) == 10 and len({r.doc_id for r in rows}) == 10


def test_quality_covers_the_whole_text():
    rng = np.random.default_rng(0)
    net = quality.Net(rng.normal(size=(6, 257, 4)).astype(np.float32), np.zeros(4, np.float32), np.ones(4, np.float32), 0.0)
    net.tables[:, quality.PAD] = 0
    for n in (0, 1, 5, 383, 384, 385, 512, 513, 5000, quality.BLOCK, quality.BLOCK + 200, 2 * quality.BLOCK + 700):
        text = "".join(chr(c) for c in rng.integers(32, 127, n))
        data = np.concatenate([np.frombuffer(text.encode(), np.uint8).astype(np.int16), np.full(6, quality.PAD, np.int16)])
        response = net.responses(data)
        best = np.array([response[s : min(s + quality.CHUNK, n + 1)].max(axis=0) for s in quality.chunk_starts(n)])
        logit = np.maximum(best, 0).mean(axis=0).sum()
        assert quality.scores(net, [text])[0] == pytest.approx(1 / (1 + np.exp(-min(logit, 40))), abs=1e-5)


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).round(3).tolist()
    rows = list(enumerate(vectors)) + [(400, None), (401, [0.0] * 8), (402, [nan] + [1.0] * 7), (403, [inf] + [1.0] * 7), (404, [None] + [1.0] * 7), (405, []), (406, [1.0, 2.0]), (None, vectors[0]), (5, vectors[5])]
    rows += [(500 + i, vectors[0]) for i in range(40)]  # a hot vector
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, shard string")
    usable = neighbours.usable(frame)
    found = neighbours.nearest(usable, usable.where("vec_id % 50 = 0")).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and (i < 400 or i >= 500 or i == 406)}
    best, expected = {}, {}
    for q in (i for i in good if i % 50 == 0):
        some = [(-float(neighbours.cosine(good[q], v[None])[0]), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
        best[q], expected[q] = some, [i for _, i in sorted(some)[:5]]
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(-next(s for s, i in best[r.query_id] if i == r.vec_id), abs=1e-12)
    assert got == expected and {r.rank for r in found} <= {1, 2, 3, 4, 5}
    assert neighbours.nearest(usable.limit(0), usable.limit(0)).count() == 0


def test_cosine_of_extreme_vectors():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=16), rng.normal(size=(5, 16))
    plain = (b @ a) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum()))
    assert np.allclose(neighbours.cosine(a, b), plain, rtol=1e-15)
    for scale in (1e-300, 1e-170, 1e160, 1e300):
        assert np.allclose(neighbours.cosine(a * scale, b), plain, rtol=1e-12) and np.allclose(neighbours.cosine(a, b * scale), plain, rtol=1e-12)


def brute_language(pages, model):
    """The fusion, page by page in plain Python."""
    rows = []
    for page_id, url, page in pages:
        host = (url or "").split("://", 1)[1].split("/")[0].split("@")[-1].split(":")[0].lower() if "://" in (url or "") else None
        numeric = host and host.replace(".", "").isdigit()
        like = model.likelihood(language.visible(page))
        p = np.exp(like - like.max())
        own = np.rint(language.UNIT * p / p.sum())
        keys = {"domain": host if numeric else host and ".".join(host.split(".")[-2:]), "host": host, "declared": language.declared(page), "suffix": None if numeric else host and host.split(".")[-1]}
        rows.append((page_id, like, own, keys))
    unit, n, out = language.UNIT, len(model.languages), {}
    for page_id, like, own, keys in rows:
        everything = sum(r[2] for r in rows) - own
        sums = {k: sum((r[2] for r in rows if r[3][k] == v), np.zeros(n)) - own if v is not None else np.zeros(n) for k, v in keys.items()}
        prior = (everything + unit) / (everything.sum() + n * unit)
        for k, w in (("domain", language.DOMAIN_WEIGHT), ("host", language.HOST_WEIGHT)):
            prior = (sums[k] + w * unit * prior) / (sums[k].sum() + w * unit)
        logs = np.log(prior) + like
        for k in ("declared", "suffix"):
            if keys[k] is not None:
                share = (sums[k].sum() + unit) / (everything.sum() + 2 * unit)
                w = language.TABLE_WEIGHT * unit
                logs = logs + np.log((sums[k] + w * share) / (everything + w))
        p = np.exp(logs - logs.max())
        out[page_id] = (model.languages[int(p.argmax())], float(p.max() / p.sum()))
    return out


def test_language(spark):
    read = spark.read.parquet
    docs = read("/root/testdata/sf0.001/documents.parquet")
    real = [tuple(r) for r in read("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    odd = [(-1, None, None), (-2, "no address", ""), (-3, "http://10.0.0.1/x", "<html lang=fr>"), (-4, "http://user@Hot.example.org:80/", '<html xml:lang="de-AT"><p>und der die'), (-5, "http://hot.example.org", "<!-- open"), (-6, "https://hot.example.org/?q", "<script>x"), (-8, "http://hot.example.org/long", "<p>" + "und der die das " * 20_000), (-7, "http://hot.example.org", '<HTML LANG="zz"><meta http-equiv="content-language" content="es">')]
    pages = spark.createDataFrame([(*r, "x") for r in real + odd], "page_id long, url string, html string, lang string").repartition(4)
    model = language.train(docs)
    expected = brute_language(real + odd, model)
    out = language.identify(pages, docs).collect()
    assert len(out) == len(real + odd)
    for r in out:
        assert r.lang == expected[r.page_id][0] and r.probability == pytest.approx(expected[r.page_id][1], rel=1e-9)
    again = language.identify(pages.unionByName(pages.where("page_id = -3")), docs)
    assert again.count() == len(out) + 1
    assert language.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in language.identify(pages, docs.limit(0)).collect()} == {None}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 40")
    model = language.train(docs.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1").select("lang", "text").collect()
    hits = [model.languages[int(model.likelihood(r.text).argmax())] == r.lang for r in rows]
    assert sum(hits) >= 0.95 * len(hits)


def test_pipeline_stages_on_edge_rows(spark, docs, empty, tmp_path):
    """No documents at all, and rows with null ids, texts and sources and clashing columns, one stage after the other."""
    labels = spark.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (empty, docs):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            if name == corpus_pipeline.STAGES[-1][0]:
                assert (out.count() > 0) == (rows.count() > 0)
                break
            assert out.columns == start.columns
            folder = f"{tmp_path}/{name}-{start is docs}"
            out.write.parquet(folder)
            rows = spark.read.parquet(folder)
            assert (rows.count() > 0) == (start is docs) or name == "quality"
