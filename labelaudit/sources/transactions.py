"""Tables that several writers may change at once: insert, upsert and a unique key, each whole or not at all.

Rows lie in buckets by a hash of their key, and each commit names for each bucket the folders that hold its rows. A
writer prepares new folders from what it has read and then tries to commit. If another was faster, it looks at
what that one has changed: as long as these are other buckets its own folders still hold, and it commits on
top; else it prepares them again from the new state. A unique key is checked within the buckets that the new rows
touch, against the very state that the commit follows. Folders that no commit names are left over from writers
that failed; readers never see them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelaudit.sources.commits import CommitLog

BUCKETS = 64


class DuplicateKeyError(ValueError):
    """A key that must be unique is there already, or comes twice."""


class Table:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.log = CommitLog(spark, path)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by bucket into new folders; bucket -> folder."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)
        names = [s.getPath().getName() for s in found if s.isDirectory()]
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in names}

    def _rows(self, state: dict, touched: list[str] | None, like: DataFrame | None = None) -> DataFrame | None:
        folders = [f for b, fs in sorted(state.get("buckets", {}).items()) if touched is None or b in touched for f in fs]
        return self.spark.read.schema(T.StructType.fromJson(state["schema"])).parquet(*folders) if folders else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a commit, the last one unless told; None before the first."""
        state = self.log.last()[1] if version is None else self.log.read(version)
        if not state:
            return None
        rows = self._rows(state, None)
        return rows if rows is not None else self.spark.createDataFrame([], T.StructType.fromJson(state["schema"]))

    def _commit(self, rows: DataFrame, schema: T.StructType, prepare: Callable[[dict, list[str]], dict[str, list[str]]]) -> int:
        """Commit what `prepare` makes of a state for the touched buckets, as often as it takes; the commit's number."""
        touched = [str(r[0]) for r in self._bucketed(rows).select("__bucket").distinct().collect()]  # at most `buckets`
        seen, made = None, None
        while True:
            version, state = self.log.last()
            held = {b: state.get("buckets", {}).get(b, []) for b in touched}
            if made is None or held != seen:  # the first time, or another writer has changed these buckets
                made, seen = prepare(state, touched), held
            entry = {"schema": state.get("schema", schema.jsonValue()), "buckets": state.get("buckets", {}) | made}
            if self.log.put(version + 1, entry):
                return version + 1

    def insert(self, rows: DataFrame, unique: bool = True) -> int:
        """Add rows. With `unique`, none is added if a key is there already or comes twice."""
        new: dict[str, str] = {}

        def prepare(state: dict, touched: list[str]) -> dict[str, list[str]]:
            if unique:
                there = self._rows(state, touched)
                if there is not None and there.select(self.key).join(rows.select(self.key), self.key, "left_semi").limit(1).count():
                    raise DuplicateKeyError(f"{self.key} is there already")
                if not new and rows.groupBy(self.key).count().where("count > 1").limit(1).count():
                    raise DuplicateKeyError(f"{self.key} comes twice")
            if not new:  # what is added does not depend on what is there
                new.update(self._written(self._bucketed(rows)))
            return {b: [*state.get("buckets", {}).get(b, []), f] for b, f in new.items()}

        return self._commit(rows, rows.schema, prepare)

    def upsert(self, changes: DataFrame, order: str) -> int:
        """Put the last change of each key in place of the row it had."""

        def prepare(state: dict, touched: list[str]) -> dict[str, list[str]]:
            from labelaudit.sources.files import upsert

            there = self._rows(state, touched)
            base = there if there is not None else changes.limit(0)
            return {b: [f] for b, f in self._written(self._bucketed(upsert(base, changes, self.key, order))).items()}

        return self._commit(changes, changes.schema, prepare)

    def delete(self, keys: DataFrame) -> int:
        """Remove the rows of these keys."""

        def prepare(state: dict, touched: list[str]) -> dict[str, list[str]]:
            there = self._rows(state, touched)
            if there is None:
                return {}
            left = self._written(self._bucketed(there.join(keys.select(self.key), self.key, "left_anti").select(*there.columns)))
            return {b: [left[b]] if b in left else [] for b in touched}

        return self._commit(keys, keys.schema, prepare)
