"""Clause retrieval: chunking, term overlap and vector distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = 500, overlap: int = 80, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that does, with up to `overlap`
    characters carried over."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    parts = list(text) if separator == "" else [p for p in text.split(separator) if p]
    out: list[str] = []
    held: list[str] = []

    def length(pieces: list[str]) -> int:
        return sum(map(len, pieces)) + len(separator) * max(0, len(pieces) - 1)

    def flush() -> None:
        joined = separator.join(held).strip()
        if joined:
            out.append(joined)

    for part in parts:
        if len(part) > size and finer:
            flush()
            held = []
            out += split_text(part, size, overlap, finer)
            continue
        if held and length([*held, part]) > size:
            flush()
            while held and (length(held) > overlap or length([*held, part]) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def chunks(docs: DataFrame, size: int = 500, overlap: int = 80) -> DataFrame:
    """doc_id, chunk_no, chunk: a generator over batches; a document's chunks do not depend on others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n, c) for i, t in zip(f["doc_id"], f["text"], strict=True) for n, c in enumerate(split_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_no int, chunk string")


def overlap_top(chunks: DataFrame, query: str, k: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The k texts that share most distinct lower-case terms with the query, ties to the smaller key."""
    terms = F.array(*[F.lit(t) for t in sorted(set(query.lower().split()))])
    own = F.array_distinct(F.split(F.lower(text), r"\s+"))
    return chunks.select(key, F.size(F.array_intersect(own, terms)).alias("score")).orderBy(F.desc("score"), key).limit(k)


def vector_top(rows: DataFrame, query: list[float], k: int = 3, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest by Euclidean distance, as a running top-k in each task."""
    at = F.array(*[F.lit(float(x)) for x in query])
    squares = F.zip_with(F.col(vector).cast(T.ArrayType(T.DoubleType())), at, lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return rows.select(key, F.round(distance, 6).alias("distance")).orderBy("distance", key).limit(k)


def index_key(corpus: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A digest that changes with any text: an index made for another one is out of date. Sums are decimals, and
    the rest is combined by XOR, so it holds at any number of rows and in any order."""
    part = lambda x, digits: F.conv(F.substring(F.md5(x), 1, digits), 16, 10)
    total = F.sum(part(F.col(text), 8).cast("decimal(20,0)")).cast("string")
    marks = F.bit_xor(part(F.concat_ws(":", F.col(key).cast("string"), F.col(text)), 15).cast("long")).cast("string")
    return corpus.agg(F.md5(F.concat_ws(",", F.count("*").cast("string"), total, marks)).alias("digest"))
