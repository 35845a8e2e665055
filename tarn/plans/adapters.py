"""The test tables as tables of the data model: files, chunks, searches, jobs. With the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans.registry import table
from tarn.sources.schema import FILE_STATUS, JOB_KINDS

EXTENSIONS = ("md", "txt", "html", "pdf", "csv", "py")


def _pick(values: tuple[str, ...], key: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], key: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({key} % {len(values)} + 1 AS INTEGER))"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source_id, path, size_bytes, content_hash, file_status, text) of ``documents``."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), _pick(EXTENSIONS, "doc_id"))
    return d.select("doc_id", F.col("source").alias("source_id"), path.alias("path"), F.col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("content_hash"), _pick(FILE_STATUS, "doc_id").alias("file_status"), "text")


FILES = f"""files AS (SELECT doc_id, source AS source_id, '/corpus/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.' || {_pick_sql(EXTENSIONS, "doc_id")} AS path,
  n_chars AS size_bytes, sha256(text) AS content_hash, {_pick_sql(FILE_STATUS, "doc_id")} AS file_status, text FROM documents)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, job_kind, priority, status, created_at, source_id) of ``events``."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in ("queued", "running", "succeeded", "failed")]), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("job_id"), _pick(JOB_KINDS, "event_id").alias("job_kind"), (F.col("user_id") % 5).cast("int").alias("priority"), status.alias("status"), F.col("ts").alias("created_at"), F.col("event_type").alias("source_id"))


JOBS = f"""jobs AS (SELECT event_id AS job_id, {_pick_sql(JOB_KINDS, "event_id")} AS job_kind, CAST(user_id % 5 AS INTEGER) AS priority,
  list_extract(['queued', 'running', 'succeeded', 'failed'], CAST(user_id % 4 + 1 AS INTEGER)) AS status, ts AS created_at, event_type AS source_id FROM events)"""
