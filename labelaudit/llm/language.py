"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each language: the likelihood of the visible text, that of the
language the markup declares, that of the address suffix, and the prior of the page's host.

Text: a naive Bayes model over hashed three-byte grams of letters, whose counts cover every labelled
document; tasks add up their own counts and send them in blocks. Neighbouring grams are no independent
evidence, so a text's mean log-likelihood counts at most EFFECTIVE times, however long it is.

Declared language, suffix and host: pages carry no labels, so each page gives its text's posterior, in
whole millionths, to grouped sums by declared language, by suffix, by domain and by host. Sums of whole
numbers do not depend on order. A host's prior is smoothed with its domain's and that with the whole
table's; conditional tables are smoothed with the share of their value. What a page gave itself is taken
off again before its sums are used, so text is not counted twice.

Defined cases: null html is the empty text, which likes all languages alike; null or malformed addresses
have no host, domain and suffix, and give no evidence; numeric hosts have no suffix; unknown declared
codes are values like any other; null page_id is kept; rows that repeat are judged one by one; ties go
to the first language by code; without labelled documents lang is null; an empty table gives no rows;
other columns are ignored. Labels are languages if their first part has two or three letters, so a model
has at most 18,252; each costs BUCKETS numbers in every task.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.llm.common import BROADCAST_ROWS, durable, partitions, read, skew_join

BUCKETS = 1 << 15
#: Buckets whose counts travel as one row.
BLOCK = 512
EFFECTIVE = 40
UNIT = 1_000_000
#: Pages' worth of smoothing for host and domain, and for the conditional tables.
HOST_WEIGHT, DOMAIN_WEIGHT, TABLE_WEIGHT = 4, 8, 2
_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^<>]*>")
_DECLARED = (
    re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I),
    re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I),
)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def visible(page: str | None) -> str:
    return markup.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def declared(page: str | None) -> str | None:
    for pattern in _DECLARED:
        if found := pattern.search(page or ""):
            return found[1].lower()
    return None


def grams(text: str | None) -> np.ndarray:
    """Buckets of a text's three-byte grams, letters only, a space at both ends."""
    data = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_LETTERS) + b"  ", np.uint8).astype(np.uint32)
    code = (data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
    return code >> np.uint32(17)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # (BUCKETS, languages)

    def likelihood(self, text: str | None) -> np.ndarray:
        """Tempered log-likelihood for each language."""
        codes = grams(text)
        return self.logs[codes].sum(axis=0) * (min(len(codes), EFFECTIVE) / len(codes))


def counted(docs: DataFrame) -> dict[str, np.ndarray]:
    """Gram counts of every labelled document, by language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, n in held.items():
            yield _blocks([(lang, b, n[b * BLOCK : (b + 1) * BLOCK]) for b in range(BUCKETS // BLOCK)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, b, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "n")), strict=True):
                more = np.frombuffer(n, "<i8")
                held[lang, b] = held[lang, b] + more if (lang, b) in held else more
        if held:
            yield _blocks([(*k, n) for k, n in held.items()])

    primary = F.lower(F.regexp_extract(F.trim("lang"), r"\A([A-Za-z]{2,3})(?:[-_].*)?\z", 1))  # of pt-BR, pt
    known = docs.select(primary.alias("lang"), "text").where(F.col("lang") != "")
    sums = known.mapInArrow(count, _BLOCKS).repartition(partitions(docs.sparkSession), "lang", "block").mapInArrow(add, _BLOCKS)
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # one row for each block of each language
        out.setdefault(r.lang, np.zeros(BUCKETS, np.int64))[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.n, "<i8")
    return out


_BLOCKS = "lang string, block int, n binary"


def _blocks(rows: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].astype("<i8").tobytes() for r in rows], pa.binary())], names=["lang", "block", "n"])


def train(docs: DataFrame) -> Model:
    counts = counted(docs)
    languages = sorted(counts)
    n = np.stack([counts[x] for x in languages], axis=1).astype(np.float64) if languages else np.zeros((BUCKETS, 0))
    share = n.sum(axis=1, keepdims=True) + 1
    smooth = n + 100 * share / share.sum()
    return Model(languages, np.log(smooth / smooth.sum(axis=0)))


def text_evidence(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, host, domain, suffix, declared, likelihood, own: the text's posterior in whole millionths."""
    schema = "page_id long, url string, declared string, likelihood array<double>, own array<long>"
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("declared", pa.string()), ("likelihood", pa.list_(pa.float64())), ("own", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column("html").to_pylist()
            logs = np.stack([model.likelihood(visible(p)) for p in pages]) if pages else np.zeros((0, len(model.languages)))
            odds = np.exp(logs - logs.max(axis=1, keepdims=True))
            own = np.rint(UNIT * odds / odds.sum(axis=1, keepdims=True)).astype(np.int64)
            columns = [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array([declared(p) for p in pages], pa.string()), pa.array(list(logs), arrow.field("likelihood").type), pa.array(list(own), arrow.field("own").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    found = pages.select("page_id", "url", "html").mapInArrow(run, schema)
    host = F.lower(F.rtrim(F.regexp_extract("url", _HOST, 1), F.lit(".")))
    found = found.withColumn("host", F.when(host != "", host))
    numeric = F.col("host").rlike(r"\A[0-9.]+\z")
    return found.select(
        "page_id",
        "host",
        F.when(numeric, F.col("host")).otherwise(F.substring_index("host", ".", -2)).alias("domain"),
        F.when(~numeric, F.substring_index("host", ".", -1)).alias("suffix"),
        "declared",
        "likelihood",
        "own",
    )


def sums_by(evidence: DataFrame, key: str, n: int) -> DataFrame:
    """key, sums: what the pages of a value gave to each language; a hot value is summed inside each task first."""
    each = F.array(*[F.sum(F.col("own")[i]) for i in range(n)])
    summed = evidence.where(F.col(key).isNotNull()).groupBy(key).agg(each.alias("sums"), F.count("*").alias("n"))
    return durable(summed.select(F.col(key).alias("__key"), "sums", "n"))


def joined(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Broadcast while the values are few; beyond that, frequent values are split over many tasks."""
    few = sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(sums.drop("n")), "__key", "left") if few else skew_join(rows, sums, "__key", ["page_id"], how="left")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def smoothed(sums: str, prior: Column, weight: int) -> Column:
    """Shares of the languages in `sums`, drawn towards `prior`."""
    return F.zip_with(sums, prior, lambda x, p: (x + weight * p) / (F.col(f"n_{sums}") + weight))


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """page_id, host, declared, suffix, lang, probability, text_lang, text_probability."""
    n = len(languages)
    whole = evidence.agg(*[F.coalesce(F.sum(F.col("own")[i]), F.lit(0)).alias(f"c{i}") for i in range(n)]).first()
    everything = F.array(*[F.lit(int(x)).cast("long") for x in whole])
    rows = evidence
    for key in ("domain", "host", "declared", "suffix"):
        sums = sums_by(evidence, key, n)
        # rows without a value meet no sums; spread out, they make no hot key
        own = F.coalesce(F.col(key), F.concat(F.lit("~ "), F.pmod(F.xxhash64("page_id", "own"), F.lit(4096)).cast("string")))
        rows = rows.withColumn("__key", own)
        rows = joined(rows, sums).withColumn(f"of_{key}", F.col("sums")).drop("__key", "sums")

    without = lambda a: F.zip_with(a, F.col("own"), lambda x, y: x - y)
    others = lambda key: F.coalesce(without(F.col(f"of_{key}")), F.array_repeat(F.lit(0).cast("long"), n))
    rows = rows.withColumns({"__all": without(everything)} | {f"of_{k}": others(k) for k in ("domain", "host", "declared", "suffix")})
    rows = rows.withColumns({f"n_{k}": _total(F.col(k)) for k in ("__all", "of_domain", "of_host", "of_declared", "of_suffix")})
    prior = F.transform("__all", lambda x: (x + UNIT) / (F.col("n___all") + n * UNIT))
    for key, weight in (("domain", DOMAIN_WEIGHT), ("host", HOST_WEIGHT)):
        prior = smoothed(f"of_{key}", prior, weight * UNIT)

    def table(key: str) -> Column:
        """Log of P(value | language)."""
        share = (F.col(f"n_of_{key}") + UNIT) / (F.col("n___all") + 2 * UNIT)
        logs = F.zip_with(f"of_{key}", "__all", lambda x, c: F.log((x + TABLE_WEIGHT * UNIT * share) / (c + TABLE_WEIGHT * UNIT)))
        return F.when(F.col(key).isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(logs)

    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = plus(plus(F.transform(prior, lambda x: F.log(x)), F.col("likelihood")), plus(table("declared"), table("suffix")))
    names = F.array(*[F.lit(x) for x in languages])

    def best(logs: str) -> tuple[Column, Column]:
        most = F.array_max(logs)
        return F.element_at(names, F.array_position(logs, most).cast("int")), 1 / F.aggregate(F.col(logs), F.lit(0.0), lambda s, x: s + F.exp(x - most))

    rows = rows.withColumn("__logs", logs)
    lang, p = best("__logs")
    text_lang, text_p = best("likelihood")
    return rows.select("page_id", "host", "declared", "suffix", lang.alias("lang"), p.alias("probability"), text_lang.alias("text_lang"), text_p.alias("text_probability"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The language of every page, by a model of the labelled `docs` (text, lang)."""
    model = train(docs)
    if not model.languages:
        none = F.lit(None)
        host = F.regexp_extract("url", _HOST, 1)
        return pages.select(
            F.col("page_id").cast("long").alias("page_id"), F.when(host != "", F.lower(host)).alias("host"), *[none.cast(t).alias(c) for c, t in (("declared", "string"), ("suffix", "string"), ("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("text_probability", "double"))]
        )
    return fuse(durable(text_evidence(pages, model)), model.languages)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))
