"""The search facade: candidates, fusion, enrichment and reranking as one plan for a table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import badges, short_path, snippet, title
from tarn.operators import fusion, keyword, vector
from tarn.operators.filters import ActiveFilters, Scope, trust_state

#: Candidates of all queries up to which they are sent to the files, whose texts then are not shuffled.
MOST_SENT = 100_000


class SearchEngine:
    """Search over tables of files and chunks.

    ``chunks``: chunk_id, file_id, heading_path, title, normalized_text, line_start, line_end, chunk_status;
    ``files``: file_id, source_id, path, file_status, modified_at, text; ``vectors``: chunk_id, vector.
    ``embed`` turns a query column into a vector column; without it, or without vectors, search is by keywords alone.
    ``rerank`` turns a result's snippet column into a score. With an ``index`` of the active chunks keyword search reads its postings; without, it splits all texts.
    """

    def __init__(self, chunks: DataFrame, files: DataFrame, vectors: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, rerank: Callable[[Column], Column] | None = None, index: keyword.KeywordIndex | None = None):
        self.chunks, self.files, self.vectors, self.embed, self.rerank, self.index = chunks, files, vectors, embed, rerank, index

    @classmethod
    def from_settings(cls, chunks: DataFrame, files: DataFrame, settings: dict, vectors: DataFrame | None = None, index: keyword.KeywordIndex | None = None) -> SearchEngine:
        """The engine that settings ask for: hybrid if a model is configured and its backend works, else by keywords alone."""
        try:
            embed = vector.backend(settings["embedding_model"]) if settings.get("embedding_model") else None
        except vector.BackendMissing:
            embed = None
        rerank = (lambda s: F.octet_length(s).cast("double")) if embed and settings.get("reranker") == "mock" else None
        return cls(chunks, files, vectors if embed else None, embed, rerank, index)

    def with_model(self, vectors: DataFrame, embed: Callable[[Column], Column]) -> SearchEngine:
        return SearchEngine(self.chunks, self.files, vectors, embed, self.rerank, self.index)

    def with_reranker(self, rerank: Callable[[Column], Column]) -> SearchEngine:
        return SearchEngine(self.chunks, self.files, self.vectors, self.embed, rerank, self.index)

    @property
    def capability(self) -> str:
        if self.vectors is None or self.embed is None:
            return "keyword_only"
        return "hybrid_with_rerank" if self.rerank else "hybrid"

    def keyword_candidates(self, queries: DataFrame, limit: int) -> DataFrame:
        if self.index is not None:
            return self.index.routed(queries, limit)
        live = self.chunks.where(F.col("chunk_status") == "active")
        fields = {"title": F.col("title"), "heading_path": F.col("heading_path"), "text": F.col("normalized_text")}
        return keyword.routed(live, queries, "chunk_id", fields, limit)

    def vector_candidates(self, queries: DataFrame, limit: int) -> DataFrame:
        asked = queries.select("query_id", self.embed(F.col("query")).alias("q"))
        return vector.top_k_batch(self.vectors, "chunk_id", "vector", asked, "query_id", "q", limit, digits=9)

    def candidates(self, queries: DataFrame, mode: str) -> DataFrame:
        """Fused candidates; a side whose limit is zero is not planned at all."""
        limits = fusion.MODES[mode]
        none = queries.limit(0).select("query_id", F.lit("").alias("chunk_id"), F.lit(0).alias("rank"))
        words = self.keyword_candidates(queries, limits.keyword) if limits.keyword else none
        near = self.vector_candidates(queries, limits.vector) if limits.vector and self.capability != "keyword_only" else none
        return fusion.rrf(words, near, "chunk_id", limits.fused)

    def search(self, queries: DataFrame, mode: str = "auto", limit: int = 20, filters: ActiveFilters = ActiveFilters(), scope: Scope = Scope(), now: Column | None = None, rerank_pool: int | None = None, one_per_file: bool = False) -> DataFrame:
        """(query_id, rank, chunk_id, file_id, path, display_path, title, snippet, rrf, badges, trust_state).

        Filters and scope see all fused candidates, 50 for each query at most, and the list is cut to ``limit`` behind them.
        ``rerank_pool`` lets the reranker promote from below the cut.
        """
        pool = max(limit, rerank_pool or 0)
        found = self.candidates(queries, mode)
        live = self.chunks.where(F.col("chunk_status") == "active").select("chunk_id", "file_id", "heading_path", "line_start", "line_end")
        if few := queries.count() * fusion.MODES[mode].fused <= MOST_SENT:
            found = F.broadcast(found)
        rich = found.join(live, "chunk_id")
        rich = (F.broadcast(rich) if few else rich).join(self.files, "file_id")
        rich = rich.withColumn("trust_state", trust_state(F.col("file_status"), F.array().cast("array<string>")))
        rich = filters.apply(rich.where(scope.predicate(F.col("path"))), now)
        if one_per_file:
            rich = rich.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "file_id").orderBy("rank"))).where("_n = 1").drop("_n")
        rich = rich.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= pool)
        rich = rich.withColumn("snippet", snippet(F.col("text"), F.col("line_start"), F.col("line_end")))
        if self.rerank is not None and fusion.MODES[mode].rerank:
            rich = fusion.reranked(rich, self.rerank(F.coalesce("snippet", F.lit(""))))
        rich = rich.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= limit)
        return rich.select("query_id", "rank", "chunk_id", "file_id", "path", short_path(F.col("path")).alias("display_path"), title(F.col("heading_path"), F.col("path")).alias("title"), "snippet", "rrf", badges(F.col("keyword_rank"), F.col("vector_rank")).alias("badges"), "trust_state")
