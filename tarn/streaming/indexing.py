"""Folder streams: new files are extracted, chunked and written in micro-batches; retries keep state by job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.functions.text import file_name
from tarn.operators.chunk import chunk_files
from tarn.operators.extract import extract, read_files
from tarn.operators.jobs import MAX_ATTEMPTS
from tarn.session import ship_package
from tarn.sources.files import ScanPolicy, listed_folder

def index_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, policy: ScanPolicy = ScanPolicy(), failures: str | None = None, settle: int = 0) -> StreamingQuery:
    """Chunks of every file of a folder that was written or changed since the last run. A restart goes on from the checkpoint;
    a batch writes its own folder, so one that is repeated replaces what it wrote. Files that fail and folders that can't be listed are rows
    (path, file_status, error_category, message) of ``failures``, by default a folder ``failed`` beside the checkpoint. The policy sees paths below the folder."""
    failed = failures or f"{checkpoint.rstrip('/')}-failed"

    def batch(df: DataFrame, n: int) -> None:
        read = read_files(df.where("problem is null"))
        done = extract(read.where("read_error is null"))
        category = F.col("extracted.error_category")
        rows = lambda d, c, m: d.select("path", F.lit("failed").alias("file_status"), c.alias("error_category"), m.alias("message"))
        none = F.lit(None).cast("string")
        bad = rows(done.where(category.isNotNull()), category, F.col("extracted.message")).unionByName(rows(read.where("read_error is not null"), F.col("read_error"), none)).unionByName(rows(df.where("problem is not null"), F.col("problem"), none))
        bad.write.mode("overwrite").parquet(f"{failed}/batch={n}")
        good = done.where(category.isNull())
        chunk_files(good, "path", F.col("extracted.segments"), file_name(F.col("path"))).write.mode("overwrite").parquet(f"{out}/batch={n}")

    found = listed_folder(spark, folder, policy, stream=True, settle=settle)
    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_states(log: DataFrame, job: str = "job_id", outcome: str = "outcome") -> DataFrame:
    """(job_id, failures, status) updates from a stream of job outcomes; the count of failures is the state."""
    ship_package(log.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, done = state.get if state.exists else (0, False)
        for b in batches:
            failures += int((b["outcome"] == "failed").sum())
            done = done or bool((b["outcome"] == "succeeded").any())
        state.update((failures, done))
        status = "succeeded" if done else "failed" if failures >= MAX_ATTEMPTS else "queued"
        yield pd.DataFrame({"job_id": [key[0]], "failures": [failures], "status": [status]})

    rows = log.select(F.col(job).cast("string").alias("job_id"), F.col(outcome).alias("outcome"))
    return rows.groupBy("job_id").applyInPandasWithState(step, "job_id string, failures long, status string", "failures long, done boolean", "update", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, at: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event counts by window and type under a watermark: an extension, for event logs."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
