"""PCA whitening of integer vectors by TSQR: R factors of partitions merge in a tree, and no covariance is formed.

Vectors become integers, so their sums are exact and so is each centred row before it is divided. Every task folds its centred rows into one R factor,
a QR of the factor so far and the next rows; factors of ``FAN`` tasks meet in one, level by level, until one is left. Its singular value decomposition gives
the right vectors and the spread along them, and those whiten every row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import materialize, scratch, small_batches

SCALE, COMPONENTS = 256, 4
#: Factors that meet in one task of a level.
FAN = 8
#: Dimensions up to which a factor, of their square, is held by a task and by the driver.
MOST_DIMENSIONS = 4_096
#: Integers up to which double precision is exact.
MOST = float(1 << 53)


def integers(vector: Column, scale: int = SCALE, most: float = MOST) -> Column:
    """floor(scale * entry) of every entry as longs; null for a vector that is null or has an entry that is null, not finite or beyond ``most``."""
    big = F.transform(vector, lambda c: c.cast("double") * scale)
    # NaN is greater than all numbers
    good = F.forall(big, lambda c: F.coalesce(F.abs(c) < most, F.lit(False)))
    return F.when(good, F.transform(big, lambda c: F.floor(c).cast("bigint")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length, as int64."""
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 0), dtype=np.int64)


def exact_sums(rows: DataFrame, vector: str) -> tuple[int, list[int]]:
    """(rows, sum of each dimension), exact at any size: tasks add in parts that fit 64 bits, their sums have 38 digits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            # halves of 32 bits can't overflow in a batch
            own = [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
            n, sums = n + len(x), own if sums is None else [a + b for a, b in zip(sums, own)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array(list(map(str, [n, *sums])))], names=["dim", "total"])

    parts = rows.select(vector).mapInArrow(run, "dim int, total string")
    got = dict(parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())  # a row for each dimension
    return (int(got.pop(-1)), [int(got[i]) for i in range(len(got))]) if got else (0, [])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, from the exact integers n * x - sums where they fit 64 bits, else from the whole part and the rest of the mean."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return (n * x - np.array(sums, dtype=np.int64)) / n
    whole = [s // n for s in sums]
    return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def tsqr(rows: DataFrame, vector: str, width: int, prepare: Callable[[np.ndarray], np.ndarray], fan: int = FAN) -> np.ndarray:
    """The R factor (width x width) of ``prepare``'s rows: QR by task, then levels of ``fan`` factors each.

    Only factors are shuffled; the driver gets the last one. A level's factors are dealt by the number of the task they come from, so a lost one is made again from its own inputs.
    """

    def fold(r: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(x if r is None else np.concatenate([r, x]), mode="r")
        return r if len(r) <= width else r[:width]

    def packed(group: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["part", "r"])

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r, wait, size = None, [], 0
        for batch in batches:
            if batch.num_rows:
                wait.append(prepare(matrix(batch.column(0))))
                size += batch.num_rows
            if size >= 4 * width:  # taller blocks cost less for each row
                r, wait, size = fold(r, np.concatenate(wait)), [], 0
        if wait:
            r = fold(r, np.concatenate(wait))
        if r is not None:
            yield packed(TaskContext.get().partitionId(), r)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group."""
        now, r = None, None
        for batch in batches:
            for group, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(blob, "<f8").reshape(-1, width)
                if group != now and r is not None:
                    yield packed(now, r)
                    r = None
                now, r = group, part if r is None else fold(r, part)
        if r is not None:
            yield packed(now, r)

    source = rows.select(vector)
    parts = source.rdd.getNumPartitions()
    level = source.mapInArrow(first, "part int, r binary")
    while parts > 1:
        parts = -(-parts // fan)
        dealt = level.select((F.col("part") / fan).cast("int").alias("part"), "r").repartition(parts, "part").sortWithinPartitions("part")
        level = dealt.mapInArrow(merge, "part int, r binary")
    got = [np.frombuffer(x.r, "<f8").reshape(-1, width) for x in level.collect()]  # one factor
    out = np.zeros((width, width))
    for r in got[:1]:
        out[: len(r)] = r
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null, empty or have an entry that is null, not finite or over 2^53 / ``scale`` are left out; so are those of another length than most have (of equally frequent
    lengths the greatest counts). The fit list has each distinct integer vector once; all rows are whitened, repeated rows and null keys too.
    ``whitened`` is null along a component in which the fit list has no spread (fewer distinct vectors than components, constant dimensions), ``explained`` is then 0 (null where there is no spread
    at all), and ``identity_error`` covers the other components, 0 if there are none. ``deviation`` is null where it is beyond 64 bits. Equal eigenvalues may give any basis of their space, the same for
    all rows. Other columns are not read; no rows give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kept = vectors.select(F.col(key).alias("key"), integers(F.col(vector), scale).alias("x")).where("x is not null and size(x) > 0")
    with scratch(spark):
        usual = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
        d = usual.d if usual else 1
        if d > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {d} dimensions: a factor has their square of entries, at most {MOST_DIMENSIONS} are taken")
        kept = kept.where(F.size("x") == d)
        fit = materialize(kept.select("x").distinct(), "fit")
        n, sums = exact_sums(fit, "x")
        axes, values, trace, error = np.zeros((0, d)), np.zeros(0), 0.0, 0.0
        k = min(components, d)
        if n:
            _, s, right = np.linalg.svd(tsqr(fit, "x", d, lambda x: centred(x, n, sums)))
            values, trace = s**2 / n, float(np.sum(s**2) / n)
            solid = int(np.sum(s[:k] > s[0] * d * np.finfo(float).eps * max(1.0, math.log2(n + 1)))) if s[0] > 0 else 0
            axes, values = right[:solid], values[:solid]
            if solid:
                along = lambda x: centred(x, n, sums) @ axes.T / np.sqrt(values)
                # a column of ones takes the mean out of the others' factor
                r = tsqr(fit, "x", solid + 1, lambda x: np.column_stack([np.ones(len(x)), along(x)]))[1:, 1:]
                error = float(np.abs(r.T @ r / n - np.eye(solid)).max())
    share = [float(values[i] / trace) if i < len(values) else (0.0 if trace else None) for i in range(k)]
    # deviations fit 64 bits, and squares the sum's, up to here
    safe = math.isqrt((1 << 63) // d) if d else 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch.column(1))
            if n * (int(np.abs(x).max()) + 1) < safe >> 1:
                far = ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
            else:
                far = [sum((n * v - t) ** 2 for v, t in zip(row, sums)) for row in x.tolist()]
                far = [f if f < 1 << 63 else None for f in far]
            out = np.full((m, k), np.nan)
            out[:, : len(axes)] = centred(x, n, sums) @ axes.T / np.sqrt(values)
            flat, at = out.ravel(), np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(far, pa.int64()).take(pa.array(at)),
                 pa.array(flat, mask=np.isnan(flat)), pa.array(share * m, pa.float64()), pa.array(np.full(m * k, error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = vectors.schema[key].dataType.simpleString()
    return kept.mapInArrow(run, f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
