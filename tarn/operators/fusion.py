"""Reciprocal rank fusion of candidate lists, and the limits of each search mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


@dataclass(frozen=True)
class Limits:
    keyword: int
    vector: int
    fused: int
    rerank: bool


# Candidates of each mode.
MODES = {"auto": Limits(100, 100, 50, True), "exact": Limits(100, 0, 50, False), "conceptual": Limits(0, 100, 50, True), "fast": Limits(50, 50, 20, False)}
STYLES = {"best_results": "auto", "exact_words": "exact", "meaning": "conceptual"}


def rrf(keyword: DataFrame, vector: DataFrame, key: str, limit: int, by: str = "query_id") -> DataFrame:
    """(query_id, key, rrf, keyword_rank, vector_rank, rank) from lists with ``rank``; ties go to the smaller key."""
    a = keyword.select(by, key, F.col("rank").alias("keyword_rank"))
    b = vector.select(by, key, F.col("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    fused = a.join(b, [by, key], "full_outer").withColumn("rrf", part("keyword_rank") + part("vector_rank"))
    order = Window.partitionBy(by).orderBy(F.col("rrf").desc(), F.col(key).asc())
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def reranked(results: DataFrame, score: Column, most: int = 20, by: str = "query_id") -> DataFrame:
    """The first ``most`` results by a new score, best first, the rest behind them as they were."""
    top = F.col("rank") <= most
    rows = results.withColumn("rerank_score", F.when(top, score))
    order = Window.partitionBy(by).orderBy(top.desc(), F.col("rerank_score").desc_nulls_last(), F.col("rank").asc())
    return rows.withColumn("rank", F.row_number().over(order))
