"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A text's features are the densities of a stated lexicon of slurs, contempt and threats and of one learned
from labels, how often such words stand near the second person, rates of capitals and punctuation, and of
obfuscated spelling (digits and signs for letters, drawn-out letters, letters set apart). Trees of depth
DEPTH are grown on quantile bins by second-order gains. Their margins become probabilities by the pool of
adjacent violators over margins that were found out of fold.

Learned are at most SAMPLE labelled documents (those with the smallest hashes of their ids), a documented
bound: a third of them gives the learned lexicon, by counts that Spark groups; of the others only the
feature vectors are collected. Scores see whole texts and nothing else. The fit is seeded, so reruns agree.

Defined cases: null text is the empty text and is scored like any other; null or contradicting labels are not
learned from; of rows that repeat a sampled doc_id the one whose text has the smallest hash is learned from;
without any label, or with labels of one kind, every score is the share of toxic labels (0.5 without any); rows that
repeat are scored one by one; very long texts are worked off in blocks of whole words; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.llm.common import read

SAMPLE = 18_000
FOLDS = 3
TREES = 60
DEPTH = 3
BINS = 32
RATE = 0.2
RIDGE = 1.0
THRESHOLD = 0.7
#: Words of the learned lexicon, and in how many toxic documents, and which share of them, a word must be.
LEARNED = 200
LEAST_DOCS = 3
LEAST_SHARE = 0.02
#: Lengths of the beginnings of words that are learned beside whole words; a beginning ends with `-`.
STEMS = (4, 5, 6)
#: Words between an insult and a pronoun that count as near.
NEAR = 5
#: Words whose weight a task remembers.
REMEMBERED = 1 << 17
#: Characters of a text worked off at once.
BLOCK = 1 << 18

# The stated lexicon, and pronouns of the second person in the languages of the corpus.
CONTEMPT = {"idiot", "moron", "loser", "clown", "stupid", "pathetic", "worthless", "disgusting", "trash", "scum", "dumb", "fool", "imbecile", "ugly", "filthy"}
CONTEMPT |= {"dummkopf", "abschaum", "versager", "widerlich", "imbécile", "minable", "ordure", "dégoûtant", "idiota", "imbécil", "basura", "escoria", "asqueroso"}
SLURS = {"bastard", "bitch", "asshole", "cunt", "slut", "whore", "fuck", "fucking", "shit", "crap", "arschloch", "scheiße", "connard", "salope", "merde", "cabrón", "puta", "mierda"}
THREATS = {"kill", "murder", "hang", "burn", "beat", "hurt", "destroy", "töten", "umbringen", "tuer", "crever", "matar", "morir"}
SECOND = {"you", "your", "yours", "yourself", "du", "dich", "dein", "deine", "ihr", "euch", "tu", "toi", "vous", "votre", "tú", "usted", "ustedes", "vosotros"}

FEATURES = (
    "words", "contempt", "slurs", "threats", "learned", "hits", "hit_rate", "near_second", "near_rate", "second", "capitals", "shouted",
    "exclaimed", "asked", "marks", "signs", "masked", "masked_hits", "drawn_out", "spaced_out",
)

_WORD = re.compile(r"[^\W_]+")
#: A token that may hide a word: letters with digits or signs in between.
_MASKED = re.compile(r"[^\W\d_]+(?:[0-9@$!*|+]+[^\W\d_]+)+")
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-_*][^\W\d_]){3,}(?!\w)")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_PLAIN = str.maketrans("013457@$!|+", "oieastasiit", "*.-_ ")
#: Kinds of bytes; what lies beyond ASCII counts as a letter.
_LETTER, _CAPITAL, _SIGN, _MARK, _GAP = (
    np.array([test(c) for c in range(256)])
    for test in (
        lambda c: c >= 128 or chr(c).isalpha(),
        lambda c: c < 128 and chr(c).isupper(),
        lambda c: chr(c) in "0123456789@$!*|+",
        lambda c: chr(c) in "!?",
        lambda c: chr(c) in " .-_*",
    )
)
_KINDS = {w: kind for kind, words in (("second", SECOND), ("threats", THREATS), ("slurs", SLURS), ("contempt", CONTEMPT)) for w in words}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def plain(token: str) -> str:
    """A token without its disguise: signs read as letters, separators dropped, drawn-out letters once."""
    return _DRAWN.sub(r"\1", token.lower().translate(_PLAIN))


def _blocks(text: str) -> Iterator[str]:
    """The text in pieces of about BLOCK characters that end with a word."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not text[end].isspace() and end < at + 2 * BLOCK:
            end += 1
        yield text[at:end]
        at = end


def parts_of(word: str) -> list[str]:
    """What the learned lexicon may hold of a word: its beginnings, and the word."""
    return [word[:k] + "-" for k in STEMS if len(word) > k] + [word]


class Words(dict):
    """The weight of each word, by its longest part that is learned; remembers up to REMEMBERED words."""

    def __init__(self, learned: dict[str, float]) -> None:
        self.learned = learned

    def __missing__(self, word: str) -> float:
        weight = next((self.learned[p] for p in reversed(parts_of(word)) if p in self.learned), 0.0)
        if len(self) < REMEMBERED:
            self[word] = weight
        return weight


def dense(text: str | None, learned: Words) -> np.ndarray:
    """The features of a whole text."""
    n = dict.fromkeys(FEATURES, 0.0)
    size = 0
    for part in _blocks(text or ""):
        raw = np.frombuffer(part.encode("utf-8", "replace"), np.uint8)
        low = part.lower()
        words = _WORD.findall(low)
        size += len(raw)
        n["words"] += len(words)
        told = [i for i, w in enumerate(words) if learned[w] or w in _KINDS]
        hits, second = [], []
        for i in told:
            kind = _KINDS.get(words[i])
            if kind:
                n[kind] += 1
            n["learned"] += learned[words[i]]
            if kind == "second":
                second.append(i)
            elif kind != "threats":
                hits.append(i)
        n["hits"] += len(hits)
        if hits and second:
            near, at = np.array(second), np.searchsorted(second, hits)
            gap = np.minimum(np.abs(near[np.minimum(at, len(near) - 1)] - hits), np.abs(near[np.maximum(at - 1, 0)] - hits))
            n["near_second"] += int((gap <= NEAR).sum())
        letter, capital, sign, mark = _LETTER[raw], _CAPITAL[raw], _SIGN[raw], _MARK[raw]
        n["capitals"] += int(capital.sum())
        if (capital[1:] & capital[:-1]).any():
            n["shouted"] += sum(1 for w in part.split() if len(w) > 1 and w.isupper())
        n["exclaimed"] += part.count("!")
        n["asked"] += part.count("?")
        pairs = mark[1:] & mark[:-1]
        n["marks"] += int(pairs[:1].sum() + (pairs[1:] & ~pairs[:-1]).sum())
        n["signs"] += sum(map(part.count, "@#$%^&*"))
        hidden = _MASKED.findall(low) if (letter[:-1] & sign[1:]).any() and (sign[:-1] & letter[1:]).any() else []
        n["masked"] += len(hidden)
        gaps = _GAP[raw]
        if (letter[:-4] & gaps[1:-3] & letter[2:-2] & gaps[3:-1] & letter[4:]).any():
            spaced = _SPACED.findall(low)
            n["spaced_out"] += len(spaced)
            hidden += spaced
        bare = [plain(token) for token in hidden]
        n["masked_hits"] += sum(1 for w in bare if learned[w] or _KINDS.get(w) in ("contempt", "slurs"))
        thrice = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & letter[2:]
        n["drawn_out"] += int(thrice[:1].sum() + (thrice[1:] & ~thrice[:-1]).sum())
    words, size = max(1.0, n["words"]), max(1, size)
    n["hit_rate"], n["near_rate"] = 100 * n["hits"] / words, 100 * n["near_second"] / words
    for name in ("contempt", "slurs", "threats", "learned", "second", "shouted", "masked", "drawn_out", "spaced_out"):
        n[name] *= 100 / words
    for name in ("capitals", "exclaimed", "asked", "marks", "signs"):
        n[name] *= 100 / size
    for name in ("words", "hits", "near_second", "masked_hits"):
        n[name] = np.log1p(n[name])
    return np.array([n[name] for name in FEATURES])


@dataclass
class Tree:
    """A full binary tree: node k splits on a feature's value and has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray  # of the leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while at.size and at[0] < len(self.feature):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.cut[at])
        return self.value[at - len(self.feature)]


def grow(bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, depth: int = DEPTH) -> Tree:
    """A tree by gains of second order, from histograms over the bins of all nodes of a level at once."""
    inner = 2**depth - 1
    tree = Tree(np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1))
    at = np.zeros(len(bins), np.int64)
    for level in range(depth):
        first, nodes = 2**level - 1, 2**level
        best = np.full(nodes, 1e-6)
        place = at - first
        for f, cuts in enumerate(edges):
            key = place * BINS + bins[:, f]
            g = np.bincount(key, slope, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
            h = np.bincount(key, curve, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
            all_g, all_h = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(h < 1) | (all_h - h < 1)] = 0
            cut = gain[:, : len(cuts)].argmax(axis=1) if len(cuts) else np.zeros(nodes, np.int64)
            high = gain[np.arange(nodes), cut]
            better = (high > best) & bool(len(cuts))
            best[better] = high[better]
            tree.feature[first : first + nodes][better] = f
            tree.cut[first : first + nodes][better] = cuts[cut[better]] if len(cuts) else np.inf
        values = np.array([np.append(e, np.inf)[np.minimum(b, len(e))] for e, b in zip(edges, bins.T, strict=True)]).T
        at = 2 * at + 1 + (values[np.arange(len(bins)), tree.feature[at]] > tree.cut[at])
    leaf = at - inner
    g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
    tree.value = -RATE * g / (h + RIDGE)
    return tree


@dataclass
class Model:
    learned: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.margins(x) for t in self.trees), np.zeros(len(x)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; the margin itself decides between equal ones, by a thousandth."""
        m = self.margins(x)
        logistic = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
        return 0.999 * np.interp(m, self.knots, self.levels) + 0.001 * logistic if len(self.knots) else logistic


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> tuple[float, list[Tree]]:
    """Log loss, by Newton's steps."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1], method="lower")) for c in x.T]
    bins = np.array([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]).T
    margin, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(grow(bins, edges, p - y, p * (1 - p)))
        margin += out[-1].margins(x)
    return base, out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots at the ends of each block, and the block's share of ones, rising."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least and largest margin
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, m, m])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    knots = np.array([e for b in blocks for e in b[2:]])
    levels = np.repeat([b[0] / b[1] for b in blocks], 2)
    return knots, levels


def fit(x: np.ndarray, y: np.ndarray, learned: dict[str, float], folds: int = FOLDS, seed: int = 7) -> Model:
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.5
        return Model(learned, 0.0, [], np.array([0.0]), np.array([rate]))
    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    apart = np.zeros(len(y))
    for k in range(folds):
        rest, own = fold != k, fold == k
        part = Model(learned, *boost(x[rest], y[rest]))
        apart[own] = part.margins(x[own])
    return Model(learned, *boost(x, y), *isotonic(apart, y))


def sample_labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """At most `rows` labelled documents outside the held-out part: doc_id, toxic, text, and `for_words`, which holds for
    a third of them."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("high"))
        .where(F.col("toxic") == F.col("high"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select("doc_id", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("for_words"))
    )
    # at most `rows` narrow rows are broadcast
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id", "toxic", "for_words").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def learned_words(sample: DataFrame, most: int = LEARNED, least: int = LEAST_DOCS) -> dict[str, float]:
    """Words that are in far more of the toxic documents, with the logarithm of how many times more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = {w for part in _blocks(text) for w in _WORD.findall(part.lower()) if len(w) < 40}
                words = sorted({p for w in words for p in parts_of(w)})
                for lo in range(0, len(words), 10_000):
                    some = words[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([toxic] * len(some), pa.int32())], names=["word", "toxic"])

    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    least = max(least, LEAST_SHARE * n.get(1, 0))
    counts = sample.select("toxic", "text").mapInArrow(run, "word string, toxic int")
    bad, good = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    odds = F.log((F.col("bad") + 0.5) / (n.get(1, 0) + 1.0)) - F.log((F.col("good") + 0.5) / (n.get(0, 0) + 1.0))
    rated = counts.groupBy("word").agg(bad.alias("bad"), good.alias("good")).where(F.col("bad") >= least).withColumn("odds", odds)
    # a word of ten toxic documents to each other one
    telling = rated.where((F.col("odds") > 2.3) & (F.col("bad") >= 10 * F.col("good"))).orderBy(F.desc("bad"), "word").limit(most)
    return {r.word: r.odds for r in telling.collect()}  # at most `most` words


def vectors(docs: DataFrame, keep: list[str], learned: dict[str, float]) -> DataFrame:
    """The columns in `keep` and the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(learned)
        for batch in batches:
            x = [dense(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    kept = ", ".join(f"{c} {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """At most `rows` short vectors and LEARNED words are collected."""
    sample = sample_labelled(docs, labels, rows)
    learned = learned_words(sample.where("for_words"))
    found = sorted((r.doc_id, r.toxic, r.x) for r in vectors(sample.where(~F.col("for_words")), ["doc_id", "toxic"], learned).collect())
    x = np.array([v for *_, v in found]).reshape(len(found), len(FEATURES))
    return fit(x, np.array([t for _, t, _ in found], np.float64), learned)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.learned)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                x = np.array([dense(t, words) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
