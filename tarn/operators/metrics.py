"""Retrieval quality and latency."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bins between a group's smallest and greatest value.
BINS = 4_096


def percentiles(rows: DataFrame, value: str, by: list[str], marks: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Each group's value at place floor(p/100·n) from 0 in order, and its extremes: no interpolation.

    Equal values are counted first. Places come from the counts of bins of values, ``BINS`` for each group between its extremes, and from the counts of the values within a
    bin that holds a mark, so no window holds a whole group.
    """
    known = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ends = known.groupBy(*by).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.sum("_c").alias("n"))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by], F.lit(True))
    span = (F.col("max_value") - F.col("min_value")).cast("double")
    bin_of = F.when(span > 0, F.least(F.floor((F.col(value) - F.col("min_value")).cast("double") / span * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    binned = known.alias("k").join(ends.alias("e"), same("k", "e")).select("k.*", bin_of.alias("_bin"), "n")
    sizes = binned.groupBy(*by, "_bin").agg(F.sum("_c").alias("_size"), F.first("n").alias("n"))
    upto = F.sum("_size").over(Window.partitionBy(*by).orderBy("_bin"))
    place = lambda p: F.least(F.floor(F.lit(p) * F.col("n") / 100), F.col("n") - 1)
    near = sizes.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_size"))
    near = near.where(reduce(lambda x, y: x | y, [(place(p) >= F.col("_start")) & (place(p) < F.col("_end")) for p in marks]))
    held = binned.drop("n").alias("b").join(near.alias("s"), same("b", "s") & (F.col("b._bin") == F.col("s._bin"))).select("b.*", "s.n", "s._start")
    last = F.col("_start") + F.sum("_c").over(Window.partitionBy(*by, "_bin").orderBy(value))
    held = held.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_c"))
    found = held.groupBy(*by).agg(*[F.max(F.when((place(p) >= F.col("_first")) & (place(p) < F.col("_last")), F.col(value))).alias(f"p{p}") for p in marks])
    return found.alias("f").join(ends.alias("e"), same("f", "e")).select("f.*", "min_value", "max_value", "n")


def hit_rate(results: DataFrame, queries: DataFrame, query_id: str, relevant: Column, k: int = 5) -> DataFrame:
    """(hit_rate, n_queries): share of queries with a relevant result in the first k."""
    hits = results.where(F.col("rank") <= k).groupBy(query_id).agg(F.bool_or(relevant).alias("hit"))
    return queries.select(query_id).join(hits, query_id, "left").agg(F.avg(F.coalesce("hit", F.lit(False)).cast("double")).alias("hit_rate"), F.count("*").alias("n_queries"))


def mrr(results: DataFrame, queries: DataFrame, query_id: str, relevant: Column) -> DataFrame:
    first = results.where(relevant).groupBy(query_id).agg(F.min("rank").alias("first"))
    return queries.select(query_id).join(first, query_id, "left").agg(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n_queries"))


def ndcg(results: DataFrame, truth: DataFrame, queries: DataFrame, query_id: str, key: str, k: int = 10) -> DataFrame:
    """Mean nDCG at k with relevance 0 or 1; ``truth`` lists relevant (query, key). Queries without a relevant document count as 0."""
    gain = lambda r: 1.0 / F.log2(r + 1)
    got = results.where(F.col("rank") <= k).join(truth, [query_id, key], "left_semi").groupBy(query_id).agg(F.sum(gain(F.col("rank"))).alias("dcg"))
    best = truth.groupBy(query_id).agg(F.least(F.count("*"), F.lit(k)).alias("m"))
    best = best.withColumn("idcg", F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1)))
    rows = queries.select(query_id).join(best, query_id, "left").join(got, query_id, "left")
    return rows.agg(F.avg(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0))).alias("ndcg"), F.count("*").alias("n_queries"))


def identifier_success(results: DataFrame, queries: DataFrame, query_id: str, query: str, text: Column, k: int = 5) -> DataFrame:
    """(success, n_queries): share of the queries with an identifier (a token with a digit) for which one of the first k results has it word for word."""
    token = F.regexp_extract(F.col(query), r"(\S*\d\S*)", 1)
    asked = queries.select(F.col(query_id), token.alias("_token")).where("_token <> ''")
    hit = results.where(F.col("rank") <= k).join(asked, query_id).groupBy(query_id).agg(F.bool_or(F.contains(text, F.col("_token"))).alias("hit"))
    return asked.join(hit, query_id, "left").agg(F.avg(F.coalesce("hit", F.lit(False)).cast("double")).alias("success"), F.count("*").alias("n_queries"))


def stale_rate(results: DataFrame, state: str = "trust_state") -> DataFrame:
    """(stale_rate, n): share of results whose file is not as it was indexed."""
    return results.agg(F.avg(F.col(state).isin("needs_update", "file_not_found").cast("double")).alias("stale_rate"), F.count("*").alias("n"))


def rerank_gain(before: DataFrame, after: DataFrame, queries: DataFrame, query_id: str, relevant: Column) -> DataFrame:
    """(mrr_before, mrr_after, gain) of a reranker over the same queries."""
    a = mrr(before, queries, query_id, relevant).select(F.col("mrr").alias("mrr_before"))
    b = mrr(after, queries, query_id, relevant).select(F.col("mrr").alias("mrr_after"))
    return a.crossJoin(b).withColumn("gain", F.col("mrr_after") - F.col("mrr_before"))  # one row each


def timed(run: Callable[[], object], rounds: int = 3, warm: int = 3) -> list[float]:
    """Seconds of each round after warm-up calls."""
    import time

    for _ in range(warm):
        run()
    out = []
    for _ in range(rounds):
        t = time.perf_counter()
        run()
        out.append(time.perf_counter() - t)
    return out


def throughput(files: int, size: int, seconds: float) -> dict[str, float]:
    return {"files_per_second": files / seconds if seconds else 0.0, "bytes_per_document": size / files if files else 0.0}
