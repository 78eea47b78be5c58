"""Clause lookup by shared words, for any number of queries and clauses: blocks of queries meet blocks of clauses.

Queries with the same words are one query. Clauses are dealt over blocks of bounded length, and so are queries; a block is
one row of a checkpoint and holds its words once, from rare to common, so no block is shuffled for each that it meets and
what lies on disk grows with the tables. Each block of clauses meets each block of queries in a task of its own.

The longest clauses, met first, give each query a number of shared words that k clauses reach at least. A clause that
reaches it (s of m words) must hold one of any m - s + 1 words of the query, and j of any m - s + j; so only the rarest of
these are looked up in their postings, and the common words are counted for what that leaves, by bits.

Defined cases: null and empty texts have no words and get the k smallest keys; ties go to the smaller key;
null keys are no clauses; of clauses that repeat a key all words count; with fewer clauses than k all are given;
without clauses the list is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelaudit.operators.joins import durable, keyed_join, stored

#: How many of the longest clauses are met first; it only estimates.
BUDGET = 256
#: Bytes of text in a block: at most, and below which there are no more blocks only to have work for each core.
CLAUSE_BYTES, QUERY_BYTES, LEAST_BYTES = 32_000_000, 16_000_000, 1_000_000
#: A word is common if more than one of so many clauses of a block hold it.
COMMON = 32
#: Postings and counters that are worked on at once, and bytes of bits.
STEP, STEP_BYTES = 1 << 20, 1 << 23


def terms(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")), lambda w: w != "")


def joined(words: Column) -> Column:
    """Words with a space between two; no word holds one."""
    return F.array_join(words, " ")


def blocks(rows: DataFrame, number: int, by_word: bool) -> DataFrame:
    """One row for each of `number` shares of rows (key, words, least): its keys in order, its words from rare to common, and for
    each word the places of the keys that have it (or for each key those of its words), `members` from one of `starts` to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield packed(pa.Table.from_batches(held), by_word)

    share = F.pmod(F.xxhash64("key"), F.lit(number)).cast("int")
    dealt = rows.select("key", "words", F.col("least").cast("int").alias("least"), share.alias("share")).repartitionById(number, "share")
    # a checkpoint keeps one block a task, so that no task holds more than a pair at once; files are read some at a time
    return durable(dealt.mapInArrow(run, f"keys array<{rows.schema['key'].dataType.simpleString()}>, terms string, starts binary, members binary, least binary"))


def packed(rows: pa.Table, by_word: bool) -> pa.RecordBatch:
    """A block of rows."""
    rows = rows.sort_by("key").combine_chunks()
    named, lists = _one(rows["key"]).dictionary_encode(), pc.split_pattern(_one(rows["words"]), " ")
    coded = lists.flatten().dictionary_encode()
    key, word = np.repeat(named.indices.to_numpy(), lists.value_lengths().to_numpy()), coded.indices.to_numpy()
    keys, words = len(named.dictionary), len(coded.dictionary)
    if keys < rows.num_rows:  # rows of a key share their words
        key, word = np.divmod(_distinct(key * np.int64(words) + word), words)
    held = np.bincount(word, minlength=words)
    order = np.argsort(held, kind="stable")
    members = np.argsort(order)[word]
    if by_word:
        members = np.sort(members * keys + key) % keys
    starts = np.concatenate([[0], np.cumsum(held[order] if by_word else np.bincount(key, minlength=keys))])
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    columns = {"keys": one(named.dictionary), "terms": pc.binary_join(one(coded.dictionary.take(pa.array(order))), " ")}
    columns |= {n: pa.array([v.astype(t).tobytes()], pa.binary()) for n, v, t in (("starts", starts, np.int64), ("members", members, np.int32), ("least", rows["least"].to_numpy(), np.int32))}
    return pa.RecordBatch.from_pydict(columns)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def met(clauses: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """set, key, n: of each block of clauses the k that share most words with each query, where these are `least` or more."""
    kind = clauses.schema["keys"].dataType.elementType.simpleString()
    pairs = clauses.crossJoin(asked.select(*[F.col(c).alias(f"asked_{c}") for c in asked.columns]).hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield paired(batch.slice(i, 1), k)

    return pairs.mapInArrow(run, f"set long, key {kind}, n int")


def paired(row: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """What a block of clauses and a block of queries have."""
    words, asked_words = (pc.split_pattern(row[n], " ").flatten() for n in ("terms", "asked_terms"))
    code = pc.fill_null(pc.index_in(asked_words, value_set=words), -1).to_numpy()
    starts, asked_starts = (np.frombuffer(row[n][0].as_buffer(), np.int64) for n in ("starts", "asked_starts"))
    members, asked_members, least = (np.frombuffer(row[n][0].as_buffer(), np.int32) for n in ("members", "asked_members", "asked_least"))
    asks = np.repeat(np.arange(len(least)), np.diff(asked_starts))
    keys, sets = (row[n].flatten() for n in ("keys", "asked_keys"))
    who, what, n = best(starts, members, len(keys), asks, code[asked_members], least, k)
    columns = [sets.take(pa.array(who)), keys.take(pa.array(what)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["set", "key", "n"])


def best(starts: np.ndarray, members: np.ndarray, clauses: int, asks: np.ndarray, word: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query, clause, shared words: the k best clauses of a block for each of its queries, by the queries' words (asks, word;
    -1 where no clause has it)."""
    held, words = np.diff(starts), len(starts) - 1
    asks, word = (x.astype(np.int32) for x in np.divmod(np.sort((asks * np.int64(words) + word)[word >= 0]), words))  # a query's words from rare to common
    size = np.bincount(asks, minlength=len(least))
    some = size >= least  # others can't reach it
    place = (np.cumsum(some) - 1).astype(np.int32)
    who, word = np.flatnonzero(some), word[some[asks]]
    asks, size, least = place[asks[some[asks]]], size[who], least[who]
    common = int(np.searchsorted(held, clauses // COMMON, "right"))
    looked = np.maximum(size - least + 1, np.bincount(asks[word < common], minlength=len(who)))
    need = looked - (size - least)
    first = np.arange(len(asks)) < np.repeat(np.cumsum(size) - size + looked, size)
    look, look_word, rest, rest_word = asks[first], word[first], asks[~first], word[~first] - common
    bits = _bits(members[starts[common] :], np.repeat(np.arange(words - common), held[common:]), clauses, words - common)
    work = np.cumsum(np.bincount(look, held[look_word], len(who)) + clauses + words - common) // STEP
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(work)) + 1, [len(who)]])
    kind = np.uint16 if looked.max(initial=0) < 1 << 16 else np.int64
    out = [(np.zeros(0, np.int64),) * 3]
    look_at, rest_at = np.searchsorted(look, cuts), np.searchsorted(rest, cuts)
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        a, b = look_at[i : i + 2]
        number = held[look_word[a:b]]
        at = np.arange(number.sum()) + np.repeat(starts[look_word[a:b]] - (np.cumsum(number) - number), number)
        count = np.zeros((hi - lo) * clauses, kind)
        np.add.at(count, members[at] + np.repeat((look[a:b] - lo) * np.int64(clauses), number), kind(1))
        at = np.flatnonzero(count.reshape(hi - lo, clauses) >= need[lo:hi, None].astype(kind))
        (q, c), n = np.divmod(at, clauses), count[at].astype(np.int64)
        a, b = rest_at[i : i + 2]
        others = _bits(rest[a:b] - lo, rest_word[a:b], hi - lo, words - common)
        step = max(1, STEP_BYTES // max(1, bits.shape[1] * 8))
        for x in range(0, len(q) if b > a else 0, step):
            n[x : x + step] += np.bitwise_count(bits[c[x : x + step]] & others[q[x : x + step]]).sum(axis=1, dtype=np.int64)
        able = n >= least[lo + q]
        q, c, n = q[able], c[able], n[able]
        order = np.lexsort((c, -n, q))  # places are in the order of keys
        q, c, n = q[order], c[order], n[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((who[lo + q[top]], c[top], n[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bits(row: np.ndarray, column: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Rows of bits in words of 64, of which those at (row, column) are set."""
    out = np.zeros((rows, -(-columns // 64) * 64), bool)
    out[row, column] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k rows of each set with most shared words, the smaller key on ties."""
    order = Window.partitionBy("set").orderBy(F.desc("n"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_clauses(sets: DataFrame, clauses: DataFrame, key: str, text: str, k: int, budget: int = BUDGET) -> DataFrame:
    """set, found: keys of the clauses that share most words with each set (set, words), most first."""
    cores = clauses.sparkSession.sparkContext.defaultParallelism
    length = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    pieces = lambda n, most, least: max(-(-n // most), min(least, -(-n // LEAST_BYTES)), 1)
    number = pieces(clauses.agg(F.sum(length)).first()[0] or 0, CLAUSE_BYTES, 2 * cores)
    asked = pieces(sets.agg(F.sum(F.octet_length("words"))).first()[0] or 0, QUERY_BYTES, -(-2 * cores // number))
    rows = lambda some: some.select(F.col(key).alias("key"), joined(terms(F.col(text))).alias("words"), F.lit(1).alias("least")).where("words <> ''")
    queries = sets.select(F.col("set").alias("key"), "words", F.lit(1).alias("least"))
    long = stored(clauses.select(F.col(key), length.alias("__n")).orderBy(F.desc("__n")).limit(budget))
    some = pieces(long.agg(F.sum("__n")).first()[0] or 0, CLAUSE_BYTES, 1)
    longest = stored(clauses.select(key, text).join(F.broadcast(long.select(key)), key, "left_semi"))  # else all are taken apart before the join
    first = met(blocks(rows(longest), some, True), blocks(queries, asked, False), k)
    reached = _top(first, k).where(F.col("rank") == k).select(F.col("set").alias("key"), F.col("n").alias("least"))
    bounded = queries.drop("least").join(reached.hint("merge"), "key", "left").withColumn("least", F.coalesce("least", F.lit(1)))
    top = _top(met(blocks(rows(clauses), number, True), blocks(bounded, asked, False), k), k)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "key")))
    return top.groupBy("set").agg(F.transform(ordered, lambda x: x["key"]).alias("found"))


def with_clauses(rows: DataFrame, clauses: DataFrame, query: Column, k: int = 3, key: str = "item_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """`rows` with `clauses`: the keys of the k clauses that share most words with the query, the smaller key on ties."""
    asked, clauses = rows.withColumn("__words", joined(F.sort_array(terms(query)))), clauses.where(F.col(key).isNotNull())
    wanted = asked.where("__words <> ''").select(F.col("__words").alias("words")).distinct()
    sets = stored(wanted.select(F.monotonically_increasing_id().alias("set"), "words"))
    found = best_clauses(sets, clauses, key, text, k, budget).join(sets.hint("merge"), "set")
    # texts of words are long and none of these tables is broadcast
    by_words = stored(found.select(F.col("words").alias("__words"), F.col("found").alias("__found")))
    smallest = [r.k for r in clauses.select(F.col(key).alias("k")).distinct().orderBy("k").limit(k).collect()]
    kind = clauses.schema[key].dataType
    none = F.array().cast(by_words.schema["__found"].dataType)
    fill = F.array(*[F.lit(x).cast(kind) for x in smallest]).cast(by_words.schema["__found"].dataType) if smallest else none
    have = F.coalesce("__found", none)
    filled = F.slice(F.concat(have, F.array_except(fill, have)), 1, k)
    return keyed_join(asked, by_words, "__words", "left", wide=True).withColumn("clauses", filled).drop("__words", "__found")
