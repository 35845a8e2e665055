"""A folder as a data source: tasks list directories, for batches and for streams.

The driver looks at directories from the root on only until there are enough subtrees to deal out; each task then walks its own and gives its files in batches, so
no process holds the list of all files. A stream's offset is a time: a batch has the files that were written, moved in or changed after the last one's, as the file system's own change times
tell, and nothing is kept for each file. For folders that all executors see under one path.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tarn.session import ship_package

SCHEMA = "path string, display_path string, size_bytes bigint, modified_at timestamp, problem string"
ARROW = pa.schema([("path", pa.string()), ("display_path", pa.string()), ("size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("problem", pa.string())])
#: Subtrees that are dealt out unless the option ``splits`` says otherwise, entries that the driver looks at for it, and files of one batch.
SPLITS, PLAN_ENTRIES, ROWS = 256, 20_000, 10_000


@dataclass
class Subtrees(InputPartition):
    """Directories of one task, with all below them or alone, and the change times (in nanoseconds) that count: after ``since`` up to ``upto``."""

    places: list[tuple[str, bool]]
    since: int = -1
    upto: int = 1 << 63

    def __post_init__(self) -> None:
        self.value = self.places


@dataclass
class Walk:
    """How a folder is walked, from the source's options."""

    root: str
    skip: frozenset[str]
    hidden: bool
    follow_links: bool
    splits: int

    @staticmethod
    def of(options: dict[str, str]) -> Walk:
        own = {k.lower(): v for k, v in options.items()}
        flag = lambda k: own.get(k, "false").lower() == "true"
        root = own["path"].removeprefix("file://")
        return Walk(root.rstrip("/") or "/", frozenset(json.loads(own.get("skip", "[]"))), flag("hidden"), flag("followlinks"), int(own.get("splits", SPLITS)))

    def wanted(self, entry: os.DirEntry) -> bool:
        """Whether an entry is looked at at all; a link is if links are followed, and it stays below the root without leading back above itself."""
        if entry.name in self.skip or not self.hidden and entry.name.startswith("."):
            return False
        if not entry.is_symlink():
            return True
        if not self.follow_links:
            return False
        real, top = os.path.realpath(entry.path), os.path.realpath(self.root)
        return real.startswith(top.rstrip("/") + "/") and not (os.path.realpath(os.path.dirname(entry.path)) + "/").startswith(real + "/")

    def plan(self) -> list[list[tuple[str, bool]]]:
        """Places of each task: directories are opened level by level until there are enough below them, so a folder that holds most of the others is parted as well."""
        level, alone, seen = [self.root], [], 0
        while level and len(level) < self.splits and seen < PLAN_ENTRIES:
            below: list[str] = []
            for n, at in enumerate(level):
                own = []
                try:
                    with os.scandir(at) as entries:
                        for e in entries:
                            seen += 1
                            if seen >= PLAN_ENTRIES:
                                break
                            if self.wanted(e) and e.is_dir():
                                own.append(e.path)
                except OSError:
                    pass  # the task that lists it tells
                if seen >= PLAN_ENTRIES:
                    below += level[n:]
                    break
                alone.append(at)
                below += own
            level = below
        # subtrees are dealt in turn; directories that were opened are listed alone
        parts: list[list[tuple[str, bool]]] = [[] for _ in range(min(self.splits, len(level) + len(alone)))]
        for i, place in enumerate([(d, True) for d in level] + [(d, False) for d in alone]):
            parts[i % len(parts)].append(place)
        return parts

    def files(self, part: Subtrees) -> Iterator[tuple]:
        stack = list(part.places)
        while stack:
            at, deep = stack.pop()
            try:
                entries = os.scandir(at)
            except OSError as e:
                # a directory that can't be listed is told in the first batch that sees it
                if part.since < 0:
                    yield self.row(at, None, "permission_denied" if isinstance(e, PermissionError) else "failed")
                continue
            with entries:
                for e in entries:
                    try:
                        if not self.wanted(e):
                            continue
                        if e.is_dir():
                            if deep:
                                stack.append((e.path, True))
                        elif e.is_file():
                            status = e.stat()
                            if part.since < max(status.st_mtime_ns, status.st_ctime_ns) <= part.upto:
                                yield self.row(e.path, status, None)
                    except OSError as err:
                        if part.since < 0:
                            yield self.row(e.path, None, "permission_denied" if isinstance(err, PermissionError) else "failed")

    def row(self, path: str, status: os.stat_result | None, problem: str | None) -> tuple:
        try:
            path.encode()
        except UnicodeEncodeError:  # a name that is no text can't be read by it
            path, problem = os.fsencode(path).decode(errors="replace"), "failed"
        shown = path[len(self.root.rstrip("/")) + 1 :] if path != self.root else ""
        return path, shown, status.st_size if status else None, status.st_mtime_ns // 1_000 if status else None, problem

    def batches(self, part: Subtrees) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self.files(part):
            rows.append(row)
            if len(rows) == ROWS:
                yield to_batch(rows)
                rows = []
        if rows:
            yield to_batch(rows)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ARROW)], schema=ARROW)


class FolderReader(DataSourceReader):
    def __init__(self, walk: Walk):
        self.walk = walk

    def partitions(self) -> list[InputPartition]:
        return [Subtrees(p) for p in self.walk.plan()]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        yield from self.walk.batches(partition)


class FolderStream(DataSourceStreamReader):
    """``settle`` milliseconds keep files back that may still be written when a batch begins."""

    def __init__(self, walk: Walk, settle: int):
        self.walk, self.settle = walk, settle

    def initialOffset(self) -> dict:
        return {"upto": -1}

    def latestOffset(self) -> dict:
        return {"upto": time.time_ns() - self.settle * 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Subtrees(p, start["upto"], end["upto"]) for p in self.walk.plan()]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        yield from self.walk.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class FolderSource(DataSource):
    """Format ``folder``: a row for each file below ``path``, and one with ``problem`` for what can't be listed.

    Options: ``skip`` (names as a JSON list), ``hidden``, ``followLinks``, ``splits``, and ``settle`` for streams.
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(Walk.of(self.options))

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(Walk.of(self.options), int(self.options.get("settle", "0")))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and the package to its workers."""
    ship_package(spark)
    spark.dataSource.register(FolderSource)
