"""Token-id files with fixed-width bit packing.

Each id takes ceil(log2(vocabulary)) bits. A file holds a header, the documents' ids and their starts,
the byte offset of every block of ids, and the packed blocks, each padded to a whole byte; so any run
of ids is found by its block and unpacked with numpy without reading what is before it.

Documents are range-partitioned and sorted by doc_id and their text's hash; every task writes its run as files of at most
FILE_IDS ids (a document is never cut) into the shared folder under names of its own attempt. Only the
manifest that the job commits names files, so what an attempt that was lost or ran twice left behind is
never read.

Defined cases: null text is the empty text, a document of just the end id; null doc_id comes first and
is read back as null; rows that repeat a doc_id are kept one by one, ordered by their text's hash;
very long texts make one long file; an empty table gives no files and no rows; other columns are
ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelaudit.llm import tokens
from labelaudit.llm.common import new_folder, partitions, read

MAGIC = b"IDPACK01"
HEADER = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 4096
FILE_IDS = 1 << 23
MANIFEST = "part int, seq int, uri string, n_docs long, n_ids long, n_bytes long"


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit packing, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first `n` ids of a packed block, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def dump(doc_ids: list[int | None], docs: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    """One file's bytes."""
    lengths = np.array([len(d) for d in docs], np.uint64)
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    return b"".join(
        [
            HEADER.pack(MAGIC, bits, block, len(docs), len(ids), len(blocks)),
            np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            starts.tobytes(),
            offsets.tobytes(),
            *blocks,
        ]
    )


class TokenFile:
    """Random access to one file, given a seekable binary reader."""

    def __init__(self, source) -> None:
        self.source = source
        magic, self.bits, self.block, self.n_docs, self.n_ids, n_blocks = HEADER.unpack(source.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        ids = np.frombuffer(source.read(8 * self.n_docs), "<i8").tolist()
        null = np.frombuffer(source.read(self.n_docs), np.uint8).tolist()
        self.doc_ids = [None if n else i for i, n in zip(ids, null, strict=True)]
        self.starts = np.frombuffer(source.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(source.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.payload = HEADER.size + 9 * self.n_docs + 8 * (self.n_docs + 1) + 8 * (n_blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the file; reads only the blocks they lie in."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(self.payload + int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        base = int(self.offsets[first])
        parts = [
            unpack(data[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], min(self.block, self.n_ids - b * self.block), self.bits)
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, at_once: int = 1 << 18) -> Iterator[np.ndarray]:
        """The ids of every document in turn; each block is read and unpacked once, some `at_once` ids at a time."""
        k = 0
        while k < self.n_docs:
            start = int(self.starts[k])
            stop = max(k + 1, int(np.searchsorted(self.starts, start + at_once, side="right")) - 1)
            ids = self.ids(start, int(self.starts[stop]))
            for j in range(k, stop):
                yield ids[int(self.starts[j]) - start : int(self.starts[j + 1]) - start]
            k = stop


def _save(folder: str, name: str, data: bytes) -> str:
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/{name}") as out:
        out.write(data)
    return f"{folder}/{name}"


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode `docs`, write the files under `folder` in ascending doc_id order; returns the manifest read back."""
    spark = docs.sparkSession
    path = path or tokens.vocabulary_path()
    bits = width(max(tokens.load(path).get_vocab_size(with_added_tokens=True), end_id + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt, seq = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            data = dump(names, held, bits)
            uri = _save(f"{folder}/data", f"ids-{part:06d}-{seq:06d}-{attempt}.bin", data)
            row = {"part": part, "seq": seq, "uri": uri, "n_docs": len(names), "n_ids": n, "n_bytes": len(data)}
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST_ARROW)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(texts, path), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                names.append(doc_id)
                held.append(ids)
                n += len(ids)
                if n >= file_ids:
                    yield flush()
                    names, held, n, seq = [], [], 0, seq + 1
        if names:
            yield flush()

    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    )
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


_MANIFEST_ARROW = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]
)
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_ROWS_ARROW = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked, ids of each document, from the files themselves.

    The running sum that gives a file its first start is over one row per file.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))
    schema = pa.schema(_ROWS_ARROW + [("ids", pa.list_(pa.int64()))] * with_ids)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_file(place) as source:
                    file = TokenFile(source)
                    rows = []
                    for k, (doc_id, ids) in enumerate(zip(file.doc_ids, file.documents(), strict=True)):
                        row = {"doc_id": doc_id, "start": base + int(file.starts[k]), "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
                        rows.append(row | ({"ids": ids.astype(np.int64)} if with_ids else {}))
                        if len(rows) >= (500 if with_ids else 10_000):
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spread = placed.repartition(partitions(manifest.sparkSession), "uri")
    return spread.mapInArrow(load, ROWS + ", ids array<long>" * with_ids)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(read(spark, sf_dir, "documents"), new_folder(spark, "token-files")))
