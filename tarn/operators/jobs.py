"""The job queue: order, caps, retries and resource modes, replayed as window queries over a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.sources.schema import JOB_KINDS

MAX_ATTEMPTS = 3
# Capacity and default priority of each queue.
CAPACITY = {"scan": 10_000, "extract": 1_000, "chunk": 1_000, "keyword": 1_000, "embedding": 2_000, "maintenance": 200}
PRIORITY = {"scan": 2, "extract": 2, "chunk": 2, "keyword": 2, "embedding": 1, "maintenance": 0}


def lookup(values: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


# The catalog's type of each kind of job.
TYPES = {"scan": "scan", "extract": "extract", "chunk": "chunk", "keyword": "keyword_index", "embedding": "embedding", "maintenance": "delete_stale"}


def enqueue(jobs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The queue with new jobs (job_id, source_id, job_kind and perhaps priority) behind it; a job that is there already is not added again."""
    default = lookup(PRIORITY, F.col("job_kind"))
    priority = F.coalesce("priority", default) if "priority" in new.columns else default
    none = F.lit(None).cast("timestamp")
    rows = new.select("job_id", "source_id", "job_kind", F.lit("queued").alias("status"), priority.cast("int").alias("priority"), F.lit(0).alias("attempts"), now.alias("created_at"), none.alias("started_at"), none.alias("completed_at"))
    return jobs.unionByName(rows.join(jobs.select("job_id"), "job_id", "left_anti"))


def run_pending(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], limit: int, now: Column) -> DataFrame:
    """The queue after its next ``limit`` jobs were run: one DataFrame for each kind.

    A handler gets the jobs of its kind and gives (job_id, error) of those that it took; an error that is not null fails that job alone, and
    an exception fails the jobs of that kind alone. A job that the handler does not give back succeeded, as does a kind without a handler.
    """
    take = queued(jobs, limit).select("job_id", "job_kind", "source_id")
    done = None
    for kind in JOB_KINDS:
        own = take.where(F.col("job_kind") == kind)
        if kind in handlers:
            try:
                errors = handlers[kind](own).select("job_id", F.col("error").cast("string").alias("error"))
                rows = [(r.job_id, r.error) for r in errors.where("error is not null").collect()]  # ``limit`` at most
                failed = own.sparkSession.createDataFrame(rows, f"job_id {own.schema['job_id'].dataType.simpleString()}, error string")
                out = own.select("job_id").join(failed, "job_id", "left")
            except Exception as e:  # one kind must not stop the others
                out = own.select("job_id", F.lit(f"{type(e).__name__}: {e}"[:500]).alias("error"))
        else:
            out = own.select("job_id", F.lit(None).cast("string").alias("error"))
        done = out if done is None else done.unionByName(out)
    started = set_status(jobs, done, "running", now)
    succeeded = set_status(started, done.where("error is null"), "succeeded", now)
    return set_status(succeeded, done.where("error is not null"), "failed", now)


def queued(jobs: DataFrame, limit: int) -> DataFrame:
    """The next jobs: priority, then age, then id."""
    return jobs.where(F.col("status") == "queued").orderBy(F.col("priority").desc(), "created_at", "job_id").limit(limit)


def queue_order(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``place`` in their own kind's queue: the place among the jobs of its priority and hour, and the number of those ahead.

    Counts of (kind, priority, hour) are summed first, so no window holds more than one hour's jobs, and no task sorts a whole queue.
    """
    slot = ["job_kind", "priority", "hour"]
    timed = jobs.withColumn("hour", F.date_trunc("hour", "created_at"))
    sizes = timed.groupBy(*slot).agg(F.count("*").alias("size"))
    order = Window.partitionBy("job_kind").orderBy(F.col("priority").desc(), F.col("hour").asc())
    ahead = sizes.withColumn("ahead", F.sum("size").over(order) - F.col("size")).drop("size").withColumnsRenamed({c: f"_{c}" for c in slot})
    own = F.row_number().over(Window.partitionBy(*slot).orderBy("created_at", "job_id"))
    same = (F.col("job_kind") == F.col("_job_kind")) & F.col("priority").eqNullSafe(F.col("_priority")) & F.col("hour").eqNullSafe(F.col("_hour"))
    ranked = timed.withColumn("own", own).join(ahead, same)
    return ranked.withColumn("place", (F.col("own") + F.col("ahead")).cast("int")).drop("own", "ahead", "hour", *[f"_{c}" for c in slot])


def pop_order(jobs: DataFrame, user_active: bool = False) -> DataFrame:
    """``jobs`` with the ``turn`` in which one worker takes them; embedding waits while the user is active.

    Kinds are taken in their fixed order and each kind by its queue, so a job's turn is its place plus all jobs of earlier
    kinds: counts of six rows, and no sort of all jobs in one task.
    """
    kind = lookup({k: i for i, k in enumerate(JOB_KINDS)}, F.col("job_kind"))
    rows = jobs.where(F.col("job_kind") != "embedding") if user_active else jobs
    ranks = queue_order(rows).withColumn("queue", kind)
    sizes = ranks.groupBy("queue").agg(F.count("*").alias("size"))
    before = sizes.select("queue", (F.sum("size").over(Window.orderBy("queue")) - F.col("size")).alias("before"))
    return ranks.join(F.broadcast(before), "queue").withColumn("turn", F.col("before") + F.col("place")).drop("before", "queue")


def admitted(log: DataFrame, kind: str = "job_kind", delta: str = "delta", at: str = "at", key: str = "event_id") -> DataFrame:
    """A log of pushes (+1) and pops (-1) with the ``depth`` of each queue and whether a push met a full one."""
    # the depth at an hour's start and the sum within the hour: no task sorts a whole queue's log
    timed = log.withColumn("_hour", F.date_trunc("hour", at))
    starts = timed.groupBy(F.col(kind).alias("_kind"), F.col("_hour").alias("_start")).agg(F.sum(delta).alias("_sum"))
    before = starts.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_kind").orderBy("_start")) - F.col("_sum")).drop("_sum")
    order = Window.partitionBy(kind, "_hour").orderBy(at, key).rowsBetween(Window.unboundedPreceding, 0)
    rows = timed.withColumn("depth", F.sum(delta).over(order)).join(before, F.col(kind).eqNullSafe(F.col("_kind")) & F.col("_hour").eqNullSafe(F.col("_start")))
    rows = rows.withColumn("depth", F.col("depth") + F.col("_before")).drop("_kind", "_start", "_before", "_hour")
    return rows.withColumn("over_capacity", (F.col(delta) > 0) & (F.col("depth") > lookup(CAPACITY, F.col(kind))))


def retry_state(log: DataFrame, job: str, outcome: str, at: str, key: str) -> DataFrame:
    """(job, failures, status): failed after ``MAX_ATTEMPTS`` failures, done at a success, else queued again."""
    order = Window.partitionBy(job).orderBy(at, key)
    rows = log.withColumn("last", F.row_number().over(Window.partitionBy(job).orderBy(F.col(at).desc(), F.col(key).desc())))
    rows = rows.withColumn("failures", F.sum((F.col(outcome) == "failed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("done", F.max((F.col(outcome) == "succeeded").cast("int")).over(Window.partitionBy(job)))
    end = rows.where(F.col("last") == 1)
    status = F.when(F.col("done") == 1, "succeeded").when(F.col("failures") >= MAX_ATTEMPTS, "failed").otherwise("queued")
    return end.select(job, F.col("failures").cast("bigint").alias("failures"), status.alias("status"))


def mode_changes(log: DataFrame, mode: str, at: str, key: str, by: str) -> DataFrame:
    """Rows at which the mode of ``by`` is another than before; the first counts."""
    before = F.lag(mode).over(Window.partitionBy(by).orderBy(at, key))
    return log.withColumn("previous", before).where(~F.col("previous").eqNullSafe(F.col(mode)))


def set_status(jobs: DataFrame, ids: DataFrame, status: str, now: Column) -> DataFrame:
    """Jobs in ``ids`` take a status; a first start or end is stamped once."""
    hit = jobs.join(ids.select("job_id").distinct().withColumn("_hit", F.lit(True)), "job_id", "left")
    own = F.coalesce("_hit", F.lit(False))
    started, ended = status == "running", status in ("succeeded", "failed", "canceled")
    out = hit.withColumn("status", F.when(own, status).otherwise(F.col("status")))
    out = out.withColumn("started_at", F.when(own & F.lit(started), F.coalesce("started_at", now)).otherwise(F.col("started_at")))
    out = out.withColumn("completed_at", F.when(own & F.lit(ended), F.coalesce("completed_at", now)).otherwise(F.col("completed_at")))
    return out.withColumn("attempts", F.col("attempts") + (own & F.lit(started)).cast("int")).drop("_hit")


def recover(jobs: DataFrame) -> DataFrame:
    """After a restart, what was running is queued again."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def control(jobs: DataFrame, source_id: str, action: str) -> DataFrame:
    """pause, resume or cancel the waiting jobs of a source."""
    moves = {"pause": (("queued",), "paused"), "resume": (("paused",), "queued"), "cancel": (("queued", "paused"), "canceled")}
    old, new = moves[action]
    return jobs.withColumn("status", F.when((F.col("source_id") == source_id) & F.col("status").isin(*old), new).otherwise(F.col("status")))


def introspect(jobs: DataFrame) -> DataFrame:
    """(job_kind, pending, completed, failed, capacity, remaining)."""
    n = jobs.groupBy("job_kind").agg(F.count_if(F.col("status") == "queued").alias("pending"), F.count_if(F.col("status") == "succeeded").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    cap = lookup(CAPACITY, F.col("job_kind")).cast("bigint")
    return n.withColumn("capacity", cap).withColumn("remaining", F.greatest(cap - F.col("pending"), F.lit(0)))
