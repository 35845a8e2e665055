"""Exact vector search over cells of pivots: what a cell can give at most is known before its vectors are read.

Every vector belongs to its nearest pivot and, within that cell, to one of ``SHELLS`` shells by its distance from the pivot. A shell keeps its distances' bounds, its greatest norm and its
number of vectors. For a query q and a shell with distances from lo to hi around c, by the triangle inequality no inner product is over q.c + |q| hi, nor over
(|q|^2 + norm^2 - gap^2) / 2, gap being how far q's own distance from c lies outside of lo to hi. A search reads the shells with the best bounds, and then those whose bound is not below the
score of the last place. Rows are those of a full scan; ``reads`` has the share of vectors that were compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators.vector import best_of, finite_rows
from tarn.session import local, ship_package

#: Pivots at most, which the driver holds, and vectors for each; shells of a cell; shells of a query that are read first; queries of one batch.
MOST_PIVOTS, PER_PIVOT, SHELLS, FIRST, BATCH = 4_096, 512, 4, 4, 4_096
#: Rounding of inner products, relative to the norms.
SLACK = 1e-9


class PivotIndex:
    """Vectors of one dimension in a folder, by cell and shell. Rows with a null key, or with a vector that is null, of another dimension or not finite, are not indexed."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.reads: dict[str, int] = {}

    def build(self, vectors: DataFrame, vector: str, dimension: int, pivots: int | None = None) -> None:
        """Writes the cells. Pivots are the vectors with the smallest hashes of their keys, a bounded sample that says where cells are and leaves out none."""
        ship_package(self.spark)
        rows = vectors.select(F.col(self.key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("key").isNotNull() & (F.size("v") == dimension))
        n = pivots or min(MOST_PIVOTS, max(1, rows.count() // PER_PIVOT))
        good = rows.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
        head = [r.v for r in good.orderBy(F.xxhash64("key"), "key", "v").limit(n).collect()]
        centers = np.array(head).reshape(-1, dimension)
        held = self.spark.sparkContext.broadcast(centers)
        kind = vectors.schema[self.key].dataType.simpleString()

        def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            square = (c**2).sum(axis=1)
            for batch in batches:
                x, at = finite_rows(batch.column(1), dimension)
                for s in range(0, len(x), 1_024):
                    part = x[s : s + 1_024]
                    cell = np.argmin(square - 2 * (part @ c.T), axis=1)
                    far = np.sqrt(((part - c[cell]) ** 2).sum(axis=1))
                    own = pa.array(at[s : s + 1_024])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array(list(part), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((part**2).sum(axis=1)))], names=["key", "v", "cell", "far", "norm"])

        placed = rows.mapInArrow(place, f"key {kind}, v array<double>, cell int, far double, norm double")
        # shells of one width each; a cell that many vectors are in has them in several files
        widest = placed.groupBy("cell").agg(F.max("far").alias("widest"))
        shell = F.least(F.floor(F.col("far") / F.greatest("widest", F.lit(1e-300)) * SHELLS), F.lit(SHELLS - 1)).cast("int")
        own = placed.join(widest, "cell").select("key", "v", "far", "norm", (F.col("cell") * SHELLS + shell).alias("shell"))
        own.hint("rebalance", "shell").sortWithinPartitions("shell").write.mode("overwrite").parquet(f"{self.root}/vectors")
        stored = self.spark.read.parquet(f"{self.root}/vectors")
        bounds = stored.groupBy("shell").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"), F.max("norm").alias("norm")).where("n > 0")
        bounds.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/shells")  # some rows for each pivot
        names = [("cell", pa.int32()), ("center", pa.list_(pa.float64()))]
        local(self.spark, [(i, list(map(float, c))) for i, c in enumerate(centers)], names).write.mode("overwrite").parquet(f"{self.root}/pivots")

    def search(self, queries: DataFrame, query_id: str, query: str, k: int, digits: int | None = None) -> DataFrame:
        """(query_id, key, score, rank) of every query that has the vectors' dimension and is finite; best inner products first, ties by key."""
        spark = self.spark
        ship_package(spark)
        rows = queries.select(F.col(query_id).alias("query_id"), F.col(query).cast("array<double>").alias("q")).where("q is not null")
        n = rows.count()
        parts = -(-n // BATCH) or 1
        self.reads = {"compared": 0, "all": 0}
        outs = [self._batch(rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), k, digits) for i in range(parts)]
        if parts == 1:
            return outs[0]
        path = f"{self.root}/found-{uuid.uuid4().hex}"
        for out in outs:
            out.write.mode("append").parquet(path)
        return spark.read.schema(outs[0].schema).parquet(path)

    def _batch(self, rows: DataFrame, k: int, digits: int | None) -> DataFrame:
        spark, key = self.spark, self.key
        stored = spark.read.parquet(f"{self.root}/vectors")
        kind, id_kind = stored.schema["key"].dataType.simpleString(), rows.schema["query_id"].dataType.simpleString()
        pivots = spark.read.schema("cell int, center array<double>").parquet(f"{self.root}/pivots").orderBy("cell").toArrow()
        none = spark.createDataFrame([], f"query_id {id_kind}, `{key}` {kind}, score double, rank int")
        if not pivots.num_rows:
            return none
        centers = np.array(pivots["center"].to_pylist())
        shells = spark.read.parquet(f"{self.root}/shells").orderBy("shell").toPandas()
        asked = rows.orderBy("query_id").toArrow()
        own = [i for i, v in enumerate(asked["q"].to_pylist()) if len(v) == centers.shape[1] and all(x is not None and np.isfinite(x) for x in v)]
        ids, q = asked["query_id"].take(pa.array(own, pa.int64())), np.array([asked["q"][i].as_py() for i in own]).reshape(len(own), -1)
        if not own or not len(shells):
            return none
        cell = shells["shell"].to_numpy() // SHELLS
        lo, hi, norm, size = (shells[c].to_numpy() for c in ("lo", "hi", "norm", "n"))
        length = np.sqrt((q**2).sum(axis=1))[:, None]
        inner = (q @ centers.T)[:, cell]
        away = np.sqrt(np.maximum(length**2 + (centers**2).sum(axis=1) - 2 * (q @ centers.T), 0))[:, cell]
        gap = np.maximum(np.maximum(away - hi, lo - away), 0)
        scale = SLACK * (1 + length * (norm + hi)) + (0.0 if digits is None else 10.0**-digits)
        bound = np.minimum(inner + length * hi, (length**2 + norm**2 - gap**2) / 2 + SLACK * length**2) + scale
        self.reads["all"] += int(size.sum()) * len(own)
        order = np.argsort(-bound, axis=1)
        todo = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(todo, order[:, :FIRST], True, axis=1)
        found: list[tuple] = []
        floor = np.full(len(own), -np.inf)
        for first in (True, False):
            work = todo if first else ~todo & (bound >= floor[:, None])
            if not work.any():
                continue
            self.reads["compared"] += int((work * size).sum())
            found += self._compare(stored, work, shells["shell"].to_numpy(), q, k, digits, kind).collect()  # k rows of each query of the batch
            per: dict[int, list[float]] = {}
            for r in found:
                per.setdefault(r.query, []).append(r.score)
            for i, scores in per.items():
                if len(scores) >= k:
                    floor[i] = sorted(scores, reverse=True)[k - 1]
        out = spark.createDataFrame(found, f"query int, `{key}` {kind}, score double")
        names = local(spark, list(enumerate(ids.to_pylist())), [("query", pa.int32()), ("query_id", ids.type)])
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col(key).asc()))
        return out.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "query").select("query_id", key, "score", "rank")

    def _compare(self, stored: DataFrame, work: np.ndarray, numbers: np.ndarray, q: np.ndarray, k: int, digits: int | None, kind: str) -> DataFrame:
        """(query, key, score): the k best of each query in the shells that it asks for."""
        spark, key, width = self.spark, self.key, q.shape[1]
        asking = {int(numbers[s]): np.flatnonzero(work[:, s]) for s in np.flatnonzero(work.any(axis=0))}
        held = spark.sparkContext.broadcast((asking, q))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asking, q = held.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                shell, keys = batch.column(2).to_numpy(), batch.column(0).to_numpy(zero_copy_only=False)
                x, at = finite_rows(batch.column(1), width)
                for s in np.unique(shell):
                    mine = np.flatnonzero(shell[at] == s)
                    for step in range(0, len(asking[int(s)]), 256):
                        who = asking[int(s)][step : step + 256]
                        score = q[who] @ x[mine].T
                        score = score if digits is None else np.round(score, digits)
                        for i, row in zip(who.tolist(), score):
                            some, names = row, keys[at[mine]]
                            if i in best:
                                some, names = np.concatenate([best[i][0], some]), np.concatenate([best[i][1], names])
                            top = best_of(some[None], names, k)[0]
                            best[i] = some[top], names[top]
            for i, (score, names) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, dtype=np.int32)), pa.array(names), pa.array(score)], names=["query", key, "score"])

        needed = sorted(asking)
        rows = stored.select("key", "v", "shell")
        # literals reach the scan, whose files and pages are sorted by shell
        rows = rows.where(F.col("shell").isin(needed)) if len(needed) <= 1_000 else rows.join(F.broadcast(local(spark, [(s,) for s in needed], [("shell", pa.int32())])), "shell", "left_semi").select("key", "v", "shell")
        out = rows.mapInArrow(run, f"query int, `{key}` {kind}, score double")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col(key).asc()))
        return out.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
