"""Table schemas, closed vocabularies and their checks, and the ledger of schema versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The closed vocabularies of the data model.
FILE_STATUS = ("discovered", "indexed", "stale", "missing", "deleted", "permission_denied", "unsupported", "failed")
CHUNK_KINDS = ("document", "section", "paragraph", "fallback", "page", "code_block", "table")
JOB_KINDS = ("scan", "extract", "chunk", "keyword", "embedding", "maintenance")
JOB_STATUS = ("queued", "running", "succeeded", "failed", "canceled", "blocked", "paused", "waiting_for_dependency")
JOB_TYPES = ("scan", "extract", "chunk", "keyword_index", "embedding", "delete_stale", "rebuild")
VECTOR_FORMATS = ("fp32", "fp16", "int8", "binary")
VERSIONS = {"normalization": "norm-v1", "chunker": "chunker-v1", "keyword_text": "kw-text-v1", "embedding_text": "embed-text-v1"}

SEGMENT = "struct<kind:string, text:string, line_start:int, line_end:int, location_kind:string, heading_path:string, location_quality:string>"
WARNING = "struct<kind:string, reason:string, pages:array<int>, limit_name:string, part:string>"
EXTRACT = f"struct<extractor_name:string, extractor_version:string, segments:array<{SEGMENT}>, char_count:bigint, warnings:array<{WARNING}>, error_category:string, message:string>"
CHUNK = "struct<chunk_kind:string, chunk_ordinal:int, heading_path:string, title:string, normalized_text:string, location_kind:string, line_start:int, line_end:int, location_quality:string, parent_ordinal:int>"

TABLES = {
    "sources": "source_id string, display_name string, root_path string, source_type string, source_status string, index_mode string, include_patterns array<string>, exclude_patterns array<string>, hidden_file_policy string, symlink_policy string, max_file_size_bytes bigint, created_at timestamp, last_scanned_at timestamp",
    "files": "file_id string, source_id string, canonical_path string, size_bytes bigint, modified_at timestamp, content_hash string, file_status string, last_seen_at timestamp, last_indexed_at timestamp",
    "extraction_records": "extraction_id string, file_id string, extractor_name string, extractor_version string, status string, completed_at timestamp",
    "chunks": "chunk_id string, file_id string, extraction_id string, chunk_kind string, chunk_ordinal int, heading_path string, title string, normalized_text string, content_hash string, char_count bigint, line_start int, line_end int, chunk_status string",
    "embeddings": "chunk_id string, model_id string, format string, dimension int, vector array<float>, status string",
    "models": "model_id string, role string, name string, version string, dimension int, path string, status string",
    "jobs": "job_id string, source_id string, file_id string, job_kind string, status string, priority int, attempts int, created_at timestamp, started_at timestamp, completed_at timestamp",
    "search_queries": "query_id string, query_text string, filters string, created_at timestamp, expires_at timestamp",
    "rerank_scores": "cache_key string, chunk_id string, model_id string, score double, created_at timestamp, expires_at timestamp",
    "snippets": "chunk_id string, query_id string, snippet string, created_at timestamp",
    "app_events": "event_id string, severity string, kind string, details string, created_at timestamp",
    "storage_usage": "category string, bytes bigint, items bigint, updated_at timestamp",
    "settings": "key string, value string, updated_at timestamp",
    "cache_entries": "namespace string, path string, content_hash string, version string, payload binary, created_at timestamp",
    "schema_version": "version int, name string, applied_at timestamp",
}
MIGRATIONS = ((1, "baseline"), (2, "trigram_index"), (3, "scheduler"))


def one_of(column: Column, values: tuple[str, ...], what: str) -> Column:
    """The value itself; anything outside the vocabulary raises when it is read."""
    return F.when(column.isin(*values), column).otherwise(F.raise_error(F.concat(F.lit(f"bad {what}: "), F.coalesce(column, F.lit("null")))))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def pending_migrations(ledger: DataFrame) -> DataFrame:
    """Migrations that the ledger does not have, in order."""
    known = ledger.sparkSession.createDataFrame(list(MIGRATIONS), "version int, name string")
    return known.join(ledger.select("version"), "version", "left_anti").orderBy("version")
