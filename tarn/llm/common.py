"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import delete_folder, ship_package

#: Rows and bytes of one Arrow batch sent to Python; a batch always holds at least one row.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

_roots: dict[str, SparkSession] = {}
_local: dict[str, str] = {}
#: Folders that were written and not deleted yet, oldest first.
_written: list[str] = []


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, unless the session has lower bounds already; give executors the package."""
    ship_package(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(key)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_root(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``; where that is unset, a local one of a local session, and an error elsewhere.

    Executors of a cluster would each write to a local folder of their own, and later reads would miss those files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _local.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tarn-")
    root = f"{base.rstrip('/')}/tarn-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = spark
        atexit.register(remove, spark, root)
    return root


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``shared_root``; once the session is stopped only one of the driver's own file system can be."""
    delete_folder(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tarn_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    if path := getattr(df, "tarn_path", None):
        remove(df.sparkSession, path)
        if path in _written:
            _written.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete what is materialized inside, but for the tables that are put in the list; so an operator's own tables go with the stage that used them."""
    before, keep = len(_written), []
    try:
        yield keep
    finally:
        kept = {getattr(df, "tarn_path", None) for df in keep}
        for path in [p for p in _written[before:] if p not in kept]:
            remove(spark, path)
            _written.remove(path)


def unique_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        name = f"__tarn_{n}"
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no DataFrame needs any more; by itself it waits until the driver's memory is full."""
    for _ in range(2):  # what Python lets go the driver's memory has a moment later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def blobs(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have about ``most`` bytes together, at least one row each."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def map_text(df: DataFrame, keep: dict[str, Column], text: str, fields: str, fn: Callable[[pa.RecordBatch], list], most: int = 4 << 20) -> DataFrame:
    """Arrow map over ``keep`` (name to column) and a text: ``fn`` gets a batch with a column ``_text`` and gives one array for each of ``fields``.

    Only the columns that are asked for reach Python, so other columns of any name do no harm.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(*[c.alias(k) for k, c in keep.items()], F.col(f"`{text}`").cast("string").alias("_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{head}, {fields}" if keep else fields
    names = list(keep) + [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "_text", most):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *fn(part)], names=names)

    return rows.mapInArrow(run, schema)


def hex64(column: Column) -> Column:
    """16 lowercase hex digits of a long's 64 bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
