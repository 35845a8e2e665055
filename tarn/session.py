"""What a session needs to run the package's Python functions on any executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once for each application: the driver serves it as a zip file."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tarn-package-")) / "tarn.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def local(spark: SparkSession, rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> DataFrame:
    """A small table of the driver's, sent as Arrow: the plan knows its size."""
    own = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(columns)]
    return spark.createDataFrame(pa.table(own, names=[n for n, _ in columns]))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is a scan of fewer partitions, as of one small file; larger scans are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < n < cores else df


#: Rows, and bytes of their columns, that a row-by-row function holds as Python objects at a time.
PIECE_ROWS, PIECE_BYTES = 64, 2 << 20


def by_row(function: Callable[..., object], type_: str) -> Callable[..., Column]:
    """A column function that calls ``function`` with the values of each row. Batches are taken to pieces of few rows and bytes, so a task's memory does not grow with the size of a batch's texts."""
    kind = to_arrow_type(DataType.fromDDL(type_))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            n = len(columns[0])
            step = max(1, min(PIECE_ROWS, n * PIECE_BYTES // (sum(c.nbytes for c in columns) or 1)))
            for at in range(0, n, step):
                yield pa.array([function(*row) for row in zip(*(c.slice(at, step).to_pylist() for c in columns))], kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, type_)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder; once the session is stopped, one of the driver's own file system, and no other."""
    context = spark.sparkContext
    if context._jsc is None:
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(urlparse(path).path, ignore_errors=True)
        return
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A folder that all executors share, under ``spark.checkpoint.dir``; a local one where that is unset and the session is local."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tarn-work-")
        _folders[app] = f"{base.rstrip('/')}/tarn-core-{app}"
        # indexes and stores that nobody keeps go with the application
        atexit.register(delete_folder, spark, _folders[app])
    return _folders[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the work folder: what is read several times is made once."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
