"""Parquet tables with replace-on-success writes: a new version is written whole, then its mark is made.

There is no pointer that could be lost: the highest marked version counts, and appended parts are versions of their own.

Upserts are an anti-join of the old rows with the new ones, joined by a union. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.schema import MIGRATIONS, TABLES, empty


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose key no new row has; of new rows with one key any one stays."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


class Store:
    """A folder of tables on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda p: path(f"{self.root}/{p}")
        self._fs = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[int]:
        """Numbers of the whole versions, oldest first."""
        if not self._fs.exists(self._path(table)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(table))]
        return sorted(int(n.removesuffix(".whole")) for n in names if n.endswith(".whole"))

    def _part(self, table: str, n: int) -> str:
        return f"{self.root}/{table}/v{n}"

    def _base(self, table: str) -> tuple[list[int], int]:
        """(versions that make the table, the last one): the last replacement and what was appended since."""
        versions = self._versions(table)
        start = max((n for n in versions if not self._fs.exists(self._path(f"{table}/{n}.append"))), default=0)
        return [n for n in versions if n >= max(start, 1)], versions[-1] if versions else 0

    def read(self, table: str) -> DataFrame:
        parts, _ = self._base(table)
        return self.spark.read.schema(TABLES[table]).parquet(*[self._part(table, n) for n in parts]) if parts else empty(self.spark, table)

    def _write(self, table: str, df: DataFrame, append: bool) -> None:
        """The next version; it counts once its mark is made, after its rows are whole."""
        n = self._base(table)[1] + 1
        df.select(*[F.col(f.name).cast(f.dataType) for f in empty(self.spark, table).schema]).write.mode("overwrite").parquet(self._part(table, n))
        if append:
            self._fs.create(self._path(f"{table}/{n}.append"), True).close()
        else:
            self._fs.delete(self._path(f"{table}/{n}.append"), False)
        self._fs.create(self._path(f"{table}/{n}.whole"), True).close()

    def replace(self, table: str, df: DataFrame) -> None:
        """Readers see the old version until the new one is whole; that and the one before stay, so a reader that began can end."""
        before = self._base(table)[0]
        self._write(table, df, False)
        for n in [n for n in self._versions(table) if before and n < before[0]]:
            # the mark goes first, so a version is never half
            self._fs.delete(self._path(f"{table}/{n}.whole"), False)
            self._fs.delete(self._path(f"{table}/{n}.append"), False)
            self._fs.delete(self._path(f"{table}/v{n}"), True)

    def append(self, table: str, df: DataFrame) -> None:
        """Adds a part; what is there is not written again. ``shrink`` makes one of many."""
        self._write(table, df, True)

    def shrink(self, table: str, files: int = 1) -> None:
        """One replacement of few files in place of all parts."""
        self.replace(table, self.read(table).coalesce(files))

    def upsert(self, table: str, df: DataFrame, keys: list[str]) -> None:
        self.replace(table, upsert(self.read(table), df, keys))

    def migrate(self) -> list[int]:
        """Apply what the ledger lacks; gives the versions applied."""
        have = {r[0] for r in self.read("schema_version").select("version").collect()}  # three at most
        todo = [(v, n) for v, n in MIGRATIONS if v not in have]
        if todo:
            self.append("schema_version", self.spark.createDataFrame(todo, "version int, name string").withColumn("applied_at", F.current_timestamp()))
        return [v for v, _ in todo]

    def set(self, key: str, value) -> None:
        row = self.spark.createDataFrame([(key, json.dumps(value))], "key string, value string").withColumn("updated_at", F.current_timestamp())
        self.upsert("settings", row, ["key"])

    def get(self, key: str, default=None):
        row = self.read("settings").where(F.col("key") == key).select("value").first()
        return json.loads(row[0]) if row else default
