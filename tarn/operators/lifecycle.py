"""The catalog's life: what goes with what, a file's extraction from guard to job, and chunks, index and vectors replaced as one bundle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import deterministic_id, file_name
from tarn.operators.catalog import cascade, replace_chunks, replaced_stale
from tarn.operators.catalog import orphans as without_parent
from tarn.operators.chunk import chunk_files
from tarn.operators.extract import extract, read_files
from tarn.operators.keyword import KeywordIndex
from tarn.operators.vector import upsert_embeddings
from tarn.sources.files import ScanPolicy, guard, type_class
from tarn.sources.schema import VERSIONS
from tarn.sources.store import Store

#: (child, its key, parent, the parent's key), parents before their own children: all that refers to something.
LINKS = [
    ("files", "source_id", "sources", "source_id"), ("jobs", "source_id", "sources", "source_id"), ("extraction_records", "file_id", "files", "file_id"), ("cache_entries", "path", "files", "canonical_path"),
    ("chunks", "file_id", "files", "file_id"), ("embeddings", "chunk_id", "chunks", "chunk_id"), ("snippets", "chunk_id", "chunks", "chunk_id"),
]


def drop(store: Store, table: str, gone: DataFrame, key: str, index: KeywordIndex | None = None) -> None:
    """Rows of a table, all that refers to them, and their chunks' postings.

    Children are written before their parents: a run that is broken off leaves parents without children, and no child without its parent; it can be run again.
    """
    names = [table]
    for child, _, parent, _ in LINKS:
        if parent in names and child not in names:
            names.append(child)
    before = {n: store.read(n) for n in names}
    left = cascade(before, [link for link in LINKS if link[2] in names], table, gone, key)
    if index is not None and "chunks" in names:
        index.delete(before["chunks"].join(left["chunks"].select("chunk_id"), "chunk_id", "left_anti").select(F.col("chunk_id").alias(index.key)))
    for n in reversed(names):
        store.replace(n, left[n])


def remove_source(store: Store, source_id: str, index: KeywordIndex | None = None) -> None:
    drop(store, "sources", store.read("sources").where(F.col("source_id") == source_id), "source_id", index)


def remove_chunks(store: Store, which: str, index: KeywordIndex | None = None) -> None:
    """The chunks of a cleanup, with their vectors, snippets and postings: those that were replaced, or those of temporary sources."""
    chunks = store.read("chunks")
    if which == "replaced":
        gone = replaced_stale(chunks)
    else:
        own = store.read("sources").where("source_type = 'temporary'").select("source_id")
        gone = chunks.join(store.read("files").join(own, "source_id", "left_semi").select("file_id"), "file_id", "left_semi")
    drop(store, "chunks", gone.select("chunk_id"), "chunk_id", index)


def orphans(store: Store) -> DataFrame:
    """(child, parent, n): rows that refer to nothing, for every link."""
    parts = [without_parent(store.read(c), ck, store.read(p), pk).agg(F.count("*").alias("n")).select(F.lit(c).alias("child"), F.lit(p).alias("parent"), "n") for c, ck, p, pk in LINKS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def files_by_id(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids.select("file_id").distinct(), "file_id", "left_semi")


def files_by_path(files: DataFrame, places: DataFrame) -> DataFrame:
    """Files of (source_id, canonical_path), which tell a file."""
    return files.join(places.select("source_id", "canonical_path").distinct(), ["source_id", "canonical_path"], "left_semi")


def set_status(files: DataFrame, new: DataFrame) -> DataFrame:
    """``files`` with the ``file_status`` that ``new`` (file_id, file_status) has; nothing else changes, and unknown ids add nothing."""
    one = new.groupBy("file_id").agg(F.max("file_status").alias("_new"))
    return files.join(one, "file_id", "left").withColumn("file_status", F.coalesce("_new", "file_status")).select(*files.columns)


def scan_report(changes: DataFrame, problems: DataFrame, started: Column, ended: Column, canceled: Column | None = None) -> DataFrame:
    """A row for each source: seen, new, unchanged, stale, restored, missing, unsupported, permission_denied, failed, queued, duration_ms, canceled.

    ``changes`` is that of ``detect_changes``; ``problems`` (source_id, path, problem) has what the scan could not list or read. A canceled scan marks nothing missing.
    """
    stop = F.lit(False) if canceled is None else canceled
    n = lambda *v: F.count_if(F.col("outcome").isin(*v))
    found = changes.groupBy("source_id").agg(
        n("new", "modified", "unchanged", "touched", "restored").alias("seen"), n("new").alias("new"), n("unchanged", "touched").alias("unchanged"), n("modified").alias("stale"), n("restored").alias("restored"),
        F.when(stop, F.lit(0).cast("bigint")).otherwise(n("missing")).alias("missing"), F.count_if(F.col("outcome").isin("new", "modified") & (type_class(F.col("path")) == "unsupported")).alias("unsupported"), F.count_if("enqueue").alias("queued"),
    )
    bad = problems.groupBy("source_id").agg(F.count_if(F.col("problem") == "permission_denied").alias("permission_denied"), F.count_if(F.col("problem") != "permission_denied").alias("failed"))
    both = found.join(bad, "source_id", "full_outer")
    counts = ["seen", "new", "unchanged", "stale", "restored", "missing", "unsupported", "permission_denied", "failed", "queued"]
    zero = F.lit(0).cast("bigint")
    took = (F.unix_millis(ended) - F.unix_millis(started)).alias("duration_ms")
    return both.select("source_id", *[F.coalesce(c, zero).alias(c) for c in counts], took, stop.alias("canceled"))


def extract_files(store: Store, files: DataFrame, roots: list[str], policy: ScanPolicy = ScanPolicy(), now: Column | None = None) -> dict[str, int]:
    """Extraction of catalogued files: guarded, only where the cache has nothing fresh, cached, recorded, and a chunk job queued for each; gives counts of what happened.

    ``files`` has file_id, source_id, canonical_path, content_hash and size_bytes, and may have ``content``. Fresh files are queued without a look at their contents. A path that is refused or
    can't be read, and an extractor that fails, is a record of status failed with its category; the file gets its status, and no job.
    """
    at = F.current_timestamp() if now is None else now
    cache = store.read("cache_entries").where((F.col("namespace") == "extraction") & (F.col("version") == VERSIONS["normalization"]))
    fresh = files.join(cache.select(F.col("path").alias("canonical_path"), "content_hash"), ["canonical_path", "content_hash"], "left_semi")
    todo = files.join(fresh.select("file_id"), "file_id", "left_anti").withColumn("refused", guard(F.col("canonical_path"), roots, policy, F.col("size_bytes")))
    good = todo.where("refused is null")
    read = good.withColumn("read_error", F.lit(None).cast("string")) if "content" in files.columns else read_files(good, "canonical_path")
    done = extract(read.where("read_error is null"), "canonical_path")
    category = F.col("extracted.error_category")
    keep = ["file_id", "source_id", "canonical_path", "content_hash"]
    rows = done.select(*keep, F.col("extracted.extractor_name").alias("extractor_name"), category.alias("error"), F.to_json("extracted.segments").alias("payload"))
    none = F.lit(None).cast("string")
    rows = rows.unionByName(read.where("read_error is not null").select(*keep, none.alias("extractor_name"), F.col("read_error").alias("error"), none.alias("payload")))
    rows = rows.unionByName(todo.where("refused is not null").select(*keep, none.alias("extractor_name"), F.col("refused").alias("error"), none.alias("payload")))
    # written once, as the cache, before it is read for everything else
    work = f"{store.root}/extracting"
    rows.write.mode("overwrite").parquet(work)
    rows = store.spark.read.schema(rows.schema).parquet(work)
    ok = rows.where("error is null")
    store.upsert("cache_entries", ok.select(F.lit("extraction").alias("namespace"), F.col("canonical_path").alias("path"), "content_hash", F.lit(VERSIONS["normalization"]).alias("version"), F.encode("payload", "UTF-8").alias("payload"), at.alias("created_at")), ["namespace", "path"])
    records = rows.select(deterministic_id("ext_", F.col("file_id"), F.col("content_hash")).alias("extraction_id"), "file_id", F.coalesce("extractor_name", F.lit("none")).alias("extractor_name"), F.lit("1").alias("extractor_version"), F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), at.alias("completed_at"))
    store.upsert("extraction_records", records, ["extraction_id"])
    status = F.when(F.col("error") == "permission_denied", "permission_denied").when(F.col("error") == "unsupported_type", "unsupported").otherwise("failed")
    store.replace("files", set_status(store.read("files"), rows.where("error is not null").select("file_id", status.alias("file_status"))))
    queued = fresh.select("file_id", "source_id").unionByName(ok.select("file_id", "source_id"))
    empty = F.lit(None).cast("timestamp")
    jobs = queued.select(deterministic_id("job_", F.lit("chunk"), F.col("file_id")).alias("job_id"), "source_id", "file_id", F.lit("chunk").alias("job_kind"), F.lit("queued").alias("status"), F.lit(0).alias("priority"), F.lit(0).alias("attempts"), at.alias("created_at"), empty.alias("started_at"), empty.alias("completed_at"))
    store.upsert("jobs", jobs, ["job_id"])
    n_ok, n_bad = rows.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
    return {"fresh": fresh.count(), "extracted": n_ok, "failed": n_bad}


def publish(store: Store, extracted: DataFrame, index: KeywordIndex | None = None, embed: Callable[[Column], Column] | None = None, model_id: str = "mock") -> None:
    """A file's new chunks in place of its old ones, with both kinds of postings and vectors, as one bundle.

    ``extracted`` has file_id, extraction_id, path and segments. The chunk table, which says what is active, is replaced last: until then, and after a run that was broken
    off, readers find the old chunks, whose postings and vectors are still there; the same call again ends what was begun.
    """
    made = chunk_files(extracted, "file_id", F.col("segments"), file_name(F.col("path"))).join(extracted.select("file_id", "extraction_id").distinct(), "file_id")
    own = made.withColumn("chunk_status", F.lit("active")).withColumn("chunk_id", deterministic_id("chunk_", F.col("extraction_id"), F.col("chunk_ordinal").cast("string")))
    new = own.select(*[F.col(c) for c in store.read("chunks").columns])
    old = store.read("chunks")
    if index is not None:
        index.add(new.select(F.col("chunk_id").alias(index.key), "title", "heading_path", "normalized_text"), {c: F.col(c) for c in ("title", "heading_path", "normalized_text")})
    if embed is not None:
        vectors = new.select("chunk_id", F.lit(model_id).alias("model_id"), F.lit("fp32").alias("format"), embed(F.col("normalized_text")).cast("array<float>").alias("vector"), F.lit("active").alias("status"))
        store.replace("embeddings", upsert_embeddings(store.read("embeddings"), vectors.withColumn("dimension", F.size("vector")).select(*store.read("embeddings").columns)))
    store.replace("chunks", replace_chunks(old, new))
    if index is not None:
        stale = store.read("chunks").where("chunk_status <> 'active'").join(extracted.select("file_id").distinct(), "file_id", "left_semi")
        index.delete(stale.select(F.col("chunk_id").alias(index.key)))


def probe(store: Store, table: str = "cache_entries") -> str:
    """Whether a table that can be rebuilt can be read: ok, absent, or rebuilt after its files were put aside."""
    path = store._path(table)
    if not store._fs.exists(path):
        return "absent"
    try:
        store.read(table).write.format("noop").mode("overwrite").save()
        return "ok"
    except Exception:  # whatever is wrong with the files, an empty table is right for what can be made again
        aside = store._path(f"{table}.corrupt-backup")
        store._fs.delete(aside, True)
        store._fs.rename(path, aside)
        return "rebuilt"


class RerankCache:
    """Scores of (query, chunk text, model) in a store's table ``rerank_scores``: a pair that was scored is not scored again until it expires, or its text or the text builder changes."""

    BUILDER = "rerank-text-v1"

    def __init__(self, store: Store, model_id: str, score: Callable[[Column, Column], Column], days: int = 30):
        self.store, self.model_id, self.score_of, self.days = store, model_id, score, days
        self.scored = 0

    @staticmethod
    def text(title: Column, heading: Column, body: Column, most: int = 2_000) -> Column:
        """What a reranker reads: title, section and the chunk's text, cut to ``most`` characters."""
        return F.left(F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nSection: "), F.coalesce(heading, F.lit("")), F.lit("\nText:\n"), F.coalesce(body, F.lit(""))), F.lit(most))

    def ranked(self, results: DataFrame, now: Column | None = None) -> DataFrame:
        """``results`` (query_id, query, chunk_id, title, heading_path, text, rank) with ``rerank_score`` and a new rank, best first, ties by the old rank."""
        at = F.current_timestamp() if now is None else now
        body = self.text(F.col("title"), F.col("heading_path"), F.col("text"))
        key = F.sha2(F.concat_ws("\x1f", F.sha2(F.trim("query"), 256), "chunk_id", F.sha2(body, 256), F.lit(self.model_id), F.lit(self.BUILDER)), 256)
        keyed = results.withColumn("cache_key", key).withColumn("_body", body)
        known = self.store.read("rerank_scores").where(F.col("expires_at") > at).select("cache_key", "score")
        missing = keyed.join(known, "cache_key", "left_anti").dropDuplicates(["cache_key"])
        new = missing.select("cache_key", F.col("chunk_id").cast("string").alias("chunk_id"), F.lit(self.model_id).alias("model_id"), self.score_of(F.col("query"), F.col("_body")).cast("double").alias("score"), at.alias("created_at"), (at + F.expr(f"interval {self.days} days")).alias("expires_at"))
        before = self.store.read("rerank_scores").count()
        self.store.append("rerank_scores", new)
        stored = self.store.read("rerank_scores")
        self.scored = stored.count() - before
        scores = stored.where(F.col("expires_at") > at).groupBy("cache_key").agg(F.max_by("score", "created_at").alias("rerank_score"))
        order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank", "chunk_id")
        return keyed.join(scores, "cache_key").drop("cache_key", "_body").withColumn("rank", F.row_number().over(order))

    def clean(self, now: Column | None = None) -> None:
        """Expired scores, and those of other text builders' chunks that are gone, leave."""
        at = F.current_timestamp() if now is None else now
        live = self.store.read("chunks").where("chunk_status = 'active'").select("chunk_id")
        self.store.replace("rerank_scores", self.store.read("rerank_scores").where(F.col("expires_at") > at).join(live, "chunk_id", "left_semi"))


__all__ = ["LINKS", "RerankCache", "drop", "extract_files", "files_by_id", "files_by_path", "orphans", "probe", "publish", "remove_chunks", "remove_source", "scan_report", "set_status"]
