"""Vector tables: exact top-k for one query or blocks of queries, INT8 search, upserts, model registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.vectors import dequantize, dot, hashed_chars, l2_normalize, mock_embedding, quantize
from tarn.session import ship_package
from tarn.sources.store import upsert

#: Queries whose vectors go to every task at once, and those that one matrix product takes; more queries need another scan.
BLOCK, STEP = 65_536, 512


class BackendMissing(RuntimeError):
    """An embedding backend is not there; search goes on by keywords."""


@dataclass(frozen=True)
class EmbeddingModel:
    """What an embedding model is to the engine: a name, a version, a dimension and a column function."""

    name: str
    version: str
    dimension: int
    embed: Callable[[Column], Column]

    @property
    def model_id(self) -> str:
        return f"{self.name}_{self.version}"


# The recommended model.
RECOMMENDED = {"name": "multilingual-e5-small", "version": "v1", "dimension": 384, "max_tokens": 512}
BACKENDS = {"mock": EmbeddingModel("mock", "mock-v1", 8, mock_embedding), "hashed": EmbeddingModel("hashed", "v1", 8, hashed_chars)}


def model(config: dict) -> EmbeddingModel:
    """The model that ``backend`` of a configuration names."""
    if (name := config.get("backend", "mock")) not in BACKENDS:
        raise BackendMissing(f"no embedding backend {name}: search by keywords, or register one in BACKENDS")
    return BACKENDS[name]


def backend(config: dict) -> Callable[[Column], Column]:
    return model(config).embed


def embed_chunks(chunks: DataFrame, texts: DataFrame, own: EmbeddingModel) -> DataFrame:
    """(chunk_id, model_id, format, dimension, vector, status) of active chunks; ``texts`` has file_id and the file's whole ``text``.

    A chunk's text is its heading path, if it has one, and the whole text of its file.
    """
    live = chunks.where(F.col("chunk_status") == "active").select("chunk_id", "file_id", "heading_path").join(texts.select("file_id", "text"), "file_id")
    vectors = live.select("chunk_id", own.embed(F.concat_ws("\n", "heading_path", "text")).cast("array<float>").alias("vector"))
    return vectors.select("chunk_id", F.lit(own.model_id).alias("model_id"), F.lit("fp32").alias("format"), F.lit(own.dimension).alias("dimension"), "vector", F.lit("active").alias("status"))


def register(models: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new models, or new data of known ones."""
    return upsert(models, new, ["model_id"])


def by_role(models: DataFrame, role: str) -> DataFrame:
    return models.where(F.col("role") == role)


def set_model_status(models: DataFrame, ids: list[str], status: str) -> DataFrame:
    return models.withColumn("status", F.when(F.col("model_id").isin(ids), status).otherwise(F.col("status")))


def validated(models: DataFrame, present: DataFrame) -> DataFrame:
    """Models with the status that their files give: missing, invalid (another dimension than ``expected_dimension``) or available.

    ``present`` has the paths that exist and, or null, the dimension that is expected.
    """
    there = present.select(F.col("path").alias("_path"), F.col("expected_dimension").cast("int").alias("_expected"))
    joined = models.join(there, F.col("path") == F.col("_path"), "left")
    other = F.coalesce(F.col("_expected") != F.col("dimension"), F.lit(False))
    return joined.withColumn("status", F.when(F.col("_path").isNull(), "missing").when(other, "invalid").otherwise("available")).drop("_path", "_expected")


def finite_rows(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, places) of the vectors of a dimension without a null or an entry that is not finite."""
    width = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    at = np.flatnonzero(width == dimension)
    x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension) if len(at) else np.zeros((0, dimension))
    good = np.isfinite(x).all(axis=1)
    return x[good], at[good]


def best_of(score: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest scores of each row, in order; ties by key. Only the rows whose last place is tied are sorted whole."""
    n = score.shape[1]
    if n <= k:
        return np.lexsort((np.broadcast_to(keys, score.shape), -score), axis=1)
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(score, at, axis=1).min(axis=1)
    for i in np.flatnonzero((score >= last[:, None]).sum(axis=1) > k):
        some = np.flatnonzero(score[i] >= last[i])
        at[i] = some[np.lexsort((keys[some], -score[i, some]))[:k]]
    order = np.lexsort((keys[at], -np.take_along_axis(score, at, axis=1)), axis=1)
    return np.take_along_axis(at, order, axis=1)


def top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(key, score, rank) of one query: inner products, best first, ties by key.

    Rows with a null key, and vectors that are null, of another dimension, or have a null or an entry that is not finite, don't count.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    scored = vectors.where(F.col(key).isNotNull() & (F.size(vector) == len(query)) & finite).select(F.col(key), dot(F.col(vector), q).alias("score"))
    best = scored.orderBy(F.col("score").desc(), F.col(key).asc()).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(key).asc())))


def top_k_batch(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_id: str, query: str, k: int, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): every query against all vectors, by matrix products.

    Queries are dealt to blocks of a bounded size; a block's vectors go to every task, which takes ``STEP`` of them at a time against each batch and returns
    its k best for each query, so k rows for each query and task are shuffled and not all scores. One scan serves ``BLOCK`` queries. ``digits`` rounds scores before they are compared. Rows with a
    null key and vectors that ``top_k`` leaves out don't count here either; a query of that kind gets no rows.
    """
    ship_package(vectors.sparkSession)
    own = queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("query"))
    n = own.count()
    blocks = -(-n // block) or 1
    dealt = own.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = None
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).orderBy("query_id").toArrow()
        part = _block(vectors, key, vector, rows, own.schema["query_id"].dataType.simpleString(), k, digits)
        parts = part if parts is None else parts.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key).asc())
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(vectors: DataFrame, key: str, vector: str, rows: pa.Table, id_type: str, k: int, digits: int | None) -> DataFrame:
    ids, column = np.array(rows["query_id"].to_pylist(), dtype=object), rows["query"].combine_chunks()
    sizes = sorted({len(v) for v in column.to_pylist() if v})
    mats = {}
    for d in sizes:
        q, at = finite_rows(column, d)
        mats |= {(d, i): (ids[at[i : i + STEP]], q[i : i + STEP]) for i in range(0, len(q), STEP)}
    held = vectors.sparkSession.sparkContext.broadcast(mats)
    key_type = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            rows = {d: finite_rows(batch.column(1), d) for d in {d for d, _ in held.value}}
            for (size, i), (_, q) in held.value.items():
                (x, at), d = rows[size], (size, i)
                if not len(at):
                    continue
                s = q @ x.T if digits is None else np.round(q @ x.T, digits)
                top = best_of(s, keys[at], k)
                s, who = np.take_along_axis(s, top, axis=1), keys[at][top]
                if d in best:
                    s, who = np.concatenate([best[d][0], s], axis=1), np.concatenate([best[d][1], who], axis=1)
                    order = np.lexsort((who, -s), axis=1)[:, :k]
                    s, who = np.take_along_axis(s, order, axis=1), np.take_along_axis(who, order, axis=1)
                best[d] = s, who
        for d, (s, who) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held.value[d][0], s.shape[1])), pa.array(who.ravel()), pa.array(s.ravel())], names=["query_id", key, "score"])

    return vectors.where(F.col(key).isNotNull()).select(key, vector).mapInArrow(run, f"query_id {id_type}, `{key}` {key_type}, score double")


def int8_table(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.withColumn(vector, quantize(l2_normalize(F.col(vector))))


def int8_top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """``top_k`` over INT8 vectors, compared after dequantizing."""
    return top_k(vectors.withColumn(vector, dequantize(F.col(vector))), key, vector, query, k)


def embed(chunks: DataFrame, text: Column, model: Callable[[list[str]], list[list[float]]] | Callable[[Column], Column], native: bool = False) -> DataFrame:
    """``chunks`` with ``vector``; a native model is a column function, any other one gets batches of texts."""
    if native:
        return chunks.withColumn("vector", model(text).cast("array<float>"))
    ship_package(chunks.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in model(batch.fillna("").tolist())])

    return chunks.withColumn("vector", run(text))


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["chunk_id", "model_id", "format"])


def scan_set(embeddings: DataFrame, chunks: DataFrame, model_id: str, dimension: int, kind: str = "fp32") -> DataFrame:
    """Active embeddings of active chunks for a model and dimension."""
    live = chunks.where(F.col("chunk_status") == "active").select("chunk_id")
    own = (F.col("status") == "active") & (F.col("model_id") == model_id) & (F.col("dimension") == dimension) & (F.col("format") == kind)
    return embeddings.where(own).join(live, "chunk_id", "left_semi")


def mark_stale(embeddings: DataFrame, model_id: str) -> DataFrame:
    return embeddings.withColumn("status", F.when(F.col("model_id") == model_id, "stale").otherwise(F.col("status")))


def capability(embedding_status: Column, reranker_status: Column) -> Column:
    ready = embedding_status == "available"
    return F.when(ready & (reranker_status == "available"), "hybrid_with_rerank").when(ready, "hybrid").otherwise("keyword_only")


def readiness(files: DataFrame) -> DataFrame:
    """(model_id, readiness) from rows (model_id, exists, expected_hash, actual_hash)."""
    intact = F.coalesce(F.col("expected_hash").isNull() | (F.col("expected_hash") == F.col("actual_hash")), F.lit(False))
    out = F.when(~F.bool_and("exists"), "missing").when(~F.bool_and(intact), "corrupt").otherwise("ready")
    return files.groupBy("model_id").agg(out.alias("readiness"))


def download_plan(readiness: Column, failed: Column) -> Column:
    """What to do with a model file: skip, retry, replace or download."""
    return F.when(readiness == "ready", "skip").when(failed, "retry").when(readiness == "corrupt", "replace").otherwise("download")
