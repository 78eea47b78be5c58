"""Reading and writing listings, reports and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV = {"seller_id": "unknown", "product_name": "Unnamed Product", "description": "", "packaging_text": ""}


def read_batch_csv(spark: SparkSession, path: str, blank: str = "") -> DataFrame:
    """Uploaded listings; a column that is missing takes its default, a blank cell `blank`. Rows that `rejected_csv`
    names are left out."""
    rows = _uploaded(spark, path)
    there = set(rows.columns)
    cells = [(F.coalesce(F.col(c), F.lit(blank)) if c in there else F.lit(v)).alias(c) for c, v in CSV.items()]
    return rows.where(F.col("__reason").isNull()).select(*cells)


def rejected_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, line, reason of the uploaded rows that are no listing: too many or too few cells, or bytes that are no
    UTF-8. What was uploaded is kept as it is, so it can be put right and uploaded again."""
    rows = _uploaded(spark, path).where(F.col("__reason").isNotNull())
    cells = F.to_csv(F.struct(*[c for c in rows.columns if c not in ("__line", "__reason")]))
    return rows.select(F.col("_metadata.file_name").alias("file"), F.coalesce("__line", cells).alias("line"), F.col("__reason").alias("reason"))


def _uploaded(spark: SparkSession, path: str) -> DataFrame:
    """All rows of CSV files with the columns of their header, what is wrong with them, and the line if it could not be
    read. Cells may hold line breaks between quotes, so a file is read by one task; uploads are many files."""
    options = {"header": True, "pathGlobFilter": "*.csv", "escape": '"', "multiLine": True}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("__line", T.StringType())])
    # without pruning, so that a row's cells are counted whichever columns are asked for
    rows = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="__line", columnPruning=False, enforceSchema=True).schema(schema).csv(path)
    torn = F.exists(F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names]), lambda c: F.contains(c, F.lit("\ufffd")))
    return rows.withColumn("__reason", F.when(F.col("__line").isNotNull(), "number of cells").when(torn, "not UTF-8"))


def merged_text(*parts: F.Column) -> F.Column:
    """Parts that are not empty, a line each."""
    return F.concat_ws("\n", *[F.when(F.trim(p) != "", p) for p in parts])


def page_text(title, description, specifications, raw) -> F.Column:
    """Title, description, `key: value` lines and text, a line each, empty ones kept."""
    lines = F.array_join(F.transform(F.map_entries(specifications), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.array_join(F.array(*[F.coalesce(x, F.lit("")) for x in (title, description, lines, raw)]), "\n")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One document a file; its id is a hash of the file's path, so it stays when files are added."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def export_rows(audits: DataFrame) -> DataFrame:
    """The columns of the report exports."""
    return audits.select(
        "audit_id",
        F.coalesce("product_name", F.lit("")).alias("product_name"),
        "category",
        "compliance_score",
        "risk_level",
        F.size("violations").alias("violation_count"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"),
    )


def legacy_rows(reports: DataFrame) -> DataFrame:
    """The six columns of the legacy export."""
    return reports.select("product_id", "seller_id", "product_name", "score", "risk_level", "created_at")


def write_legacy_csv(reports: DataFrame, path: str) -> None:
    legacy_rows(reports).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_report(audits: DataFrame, kind: str) -> DataFrame:
    """The rows of a JSON report: `summary` one row, `violation` one a rule, otherwise the audits."""
    from labelaudit.operators import analytics

    return {"summary": analytics.summary, "violation": analytics.violation_report}.get(kind, lambda a: a)(audits)


def write_json_report(audits: DataFrame, kind: str, path: str) -> None:
    json_report(audits, kind).write.mode("overwrite").json(path)


def insert(rows: DataFrame, path: str) -> None:
    """Append; what is there stays as it is."""
    rows.write.mode("append").parquet(path)


def queue_lines(jobs: DataFrame) -> DataFrame:
    """One JSON line a job, as queues carry them."""
    return jobs.select(F.to_json(F.struct(*jobs.columns)).alias("value"))


def push(jobs: DataFrame, path: str) -> None:
    """Append jobs to a queue kept as files of JSON lines; `streaming` sources read it."""
    queue_lines(jobs).write.mode("append").text(path)


def picture_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, size and bytes of picture files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,webp,bmp,tif,tiff,gif}").load(path)
    return found.select("path", F.col("length").alias("size"), F.col("content").alias("bytes"))


def picture_of(encoded: F.Column) -> F.Column:
    """Bytes of a base64 picture, with or without a data address before it; null where it is none."""
    return F.try_to_binary(F.regexp_replace(encoded, r"\Adata:[^,]*,", ""), F.lit("base64"))


def write_csv(audits: DataFrame, path: str) -> None:
    export_rows(audits).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(audits: DataFrame, path: str) -> None:
    audits.write.mode("overwrite").json(path)


def printed_report(audits: DataFrame, rows: int = 20, width: int = 30) -> DataFrame:
    """The lines of the printed report: the newest `rows`, names cut to `width`."""
    head = audits.orderBy(F.desc("created_at"), "audit_id").limit(rows)
    return head.select("audit_id", F.substring("product_name", 1, width).alias("product_name"), F.format_number("compliance_score", 1).alias("score"), "risk_level")


def text_report(audits: DataFrame) -> DataFrame:
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return audits.select("audit_id", F.concat_ws("\n", line("Product", "product_name"), line("Seller", "seller_id"), line("Score", "compliance_score"), line("Risk", "risk_level")).alias("block"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Current rows with the last change of each key in place of the row it had."""
    columns = [F.col(f"`{c}`") for c in current.columns]
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    last = F.max_by(F.struct(*columns), F.struct("__new", F.col(order)))
    return both.groupBy(F.col(key).alias("__key")).agg(last.alias("r")).select("r.*")


def delete(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return current.join(gone.select(key), key, "left_anti")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The folders right below a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(s.getPath()) for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def _written(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote a folder ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def version_folders(spark: SparkSession, path: str) -> dict[int, tuple[int, str]]:
    """bucket -> newest complete version and its folder, of a state that `streaming.live.upsert_into` keeps."""
    out: dict[int, tuple[int, str]] = {}
    for folder in _folders(spark, path):
        version = int(folder.rsplit("version=", 1)[1])
        if _written(spark, folder):
            for part in _folders(spark, folder):
                bucket = int(part.rsplit("bucket=", 1)[1])
                out[bucket] = max(out.get(bucket, (-1, "")), (version, part))
    return out


def versioned(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of such a state."""
    return spark.read.parquet(*[folder for _, folder in version_folders(spark, path).values()])


def drop_versions(spark: SparkSession, path: str, held: dict[int, tuple[int, str]], buckets: list[int], before: int) -> None:
    """Delete the folders of `held` for buckets that have a newer version, where older than `before`; the version
    before the last stays for those who are reading it."""
    for bucket in buckets:
        version, folder = held.get(bucket, (before, ""))
        if version < before:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
