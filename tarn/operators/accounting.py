"""Counts and sums over the catalog: statuses, storage, integrity, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.catalog import orphans

# Bytes that an index row, a cached result and an event are taken for.
KEYWORD_ROW, RESULT_ROW, EVENT_ROW = 256, 512, 256
GROUPS = {"keyword_index": "search_index", "vector_index": "search_index", "model_files": "models", "snippet_cache": "caches", "search_cache": "caches", "temporary_extraction": "caches"}


def by_status(rows: DataFrame, *keys: str, status: str = "file_status") -> DataFrame:
    return rows.groupBy(*keys, status).agg(F.count("*").alias("n"))


def with_status(rows: DataFrame, status: str, source_id: str | None = None, column: str = "file_status") -> DataFrame:
    own = rows.where(F.col(column) == status)
    return (own.where(F.col("source_id") == source_id) if source_id else own).agg(F.count("*").alias("n"))


def storage(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(category, bytes, items): each category's rows and the sum of their sizes."""
    one = [df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"), F.count("*").alias("items")).select(F.lit(c).alias("category"), "bytes", "items") for c, (df, size) in parts.items()]
    return reduce(DataFrame.unionByName, one)


def rolled_up(usage: DataFrame) -> DataFrame:
    """The three groups that are shown; the catalog and logs are in none."""
    group = F.element_at(F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv]), F.col("category"))
    return usage.withColumn("display_group", group).where("display_group is not null").groupBy("display_group").agg(F.sum("bytes").alias("bytes"), F.sum("items").alias("items"))


def integrity(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check, orphans): children without a parent in each (child, key, parent, key)."""
    one = [orphans(c, ck, p, pk).agg(F.count("*").alias("orphans")).select(F.lit(name).alias("check_name"), "orphans") for name, (c, ck, p, pk) in checks.items()]
    return reduce(DataFrame.unionByName, one)


def health(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """(indexed, stale, failed, queued)."""
    n = lambda s: F.count_if(F.col("file_status") == s).alias(s)
    return files.agg(n("indexed"), n("stale"), n("failed")).crossJoin(jobs.agg(F.count_if(F.col("status") == "queued").alias("queued")))  # one row each


def source_cards(sources: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each source, with or without files."""
    n = lambda s: F.count_if(F.col("file_status") == s).alias(s)
    counts = files.groupBy("source_id").agg(n("indexed"), n("stale"), n("failed"))
    return sources.join(counts, "source_id", "left").na.fill(0, ["indexed", "stale", "failed"])


def cache_usage(entries: DataFrame) -> DataFrame:
    return entries.groupBy("namespace").agg(F.count("*").alias("entries"), F.sum(F.octet_length("payload")).alias("bytes"))
