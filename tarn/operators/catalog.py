"""The catalog: change detection between snapshots, replacement, cleanup, cascades, events, history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.sources.files import fingerprint_changed
from tarn.sources.store import upsert


def detect_changes(snapshot: DataFrame, catalog: DataFrame, force_hash: bool = False) -> DataFrame:
    """(source_id, path, outcome, new_status, enqueue) of every file that is in either.

    ``snapshot`` has source_id, path, size_bytes, modified_at, content_hash; ``catalog`` also file_status, ever_indexed.
    Outcomes: new, touched, unchanged, modified, restored, missing, gone.
    """
    s, c = snapshot.alias("s"), catalog.alias("c")
    both = s.join(c, (F.col("s.source_id") == F.col("c.source_id")) & (F.col("s.path") == F.col("c.path")), "full_outer")
    status, ever = F.col("c.file_status"), F.coalesce(F.col("c.ever_indexed"), F.lit(False))
    lost = status.isin("missing", "deleted")
    moved = fingerprint_changed(F.col("c.size_bytes"), F.col("c.modified_at"), F.col("s.size_bytes"), F.col("s.modified_at"))
    differs = ~F.col("s.content_hash").eqNullSafe(F.col("c.content_hash"))
    seen = (moved | F.lit(force_hash)) & differs
    outcome = (
        F.when(F.col("c.path").isNull(), "new")
        .when(F.col("s.path").isNull(), F.when(lost, "gone").otherwise("missing"))
        .when(seen, "modified")
        .when(lost, "restored")
        .when(moved | F.lit(force_hash), "unchanged")
        .otherwise("touched")
    )
    back = F.when(ever, "indexed").otherwise("discovered")
    rows = both.select(F.coalesce("s.source_id", "c.source_id").alias("source_id"), F.coalesce("s.path", "c.path").alias("path"), outcome.alias("outcome"), status.alias("old"), back.alias("back"))
    o = F.col("outcome")
    new = (
        F.when(o == "new", "discovered")
        .when(o == "modified", F.when(F.col("old").isin("indexed", "stale"), "stale").otherwise("discovered"))
        .when(o == "restored", F.col("back"))
        .when(o == "missing", "missing")
        .otherwise(F.col("old"))
    )
    return rows.select("source_id", "path", "outcome", new.alias("new_status"), o.isin("new", "modified").alias("enqueue"))


def scan_summary(changes: DataFrame) -> DataFrame:
    """(source_id, seen, new, modified, unchanged, restored, missing, queued)."""
    n = lambda *v: F.count_if(F.col("outcome").isin(*v))
    return changes.groupBy("source_id").agg(n("new", "modified", "unchanged", "touched", "restored").alias("seen"), n("new").alias("new"), n("modified").alias("modified"), n("unchanged", "touched").alias("unchanged"), n("restored").alias("restored"), n("missing").alias("missing"), F.count_if("enqueue").alias("queued"))


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks after a file's new extraction: its earlier chunks become stale, others stay as they are."""
    latest = new.select("file_id", F.col("extraction_id").alias("_new")).distinct()
    joined = old.join(latest, "file_id", "left")
    status = F.when(F.col("_new").isNotNull() & (F.col("_new") != F.col("extraction_id")), "stale").otherwise(F.col("chunk_status"))
    kept = joined.withColumn("chunk_status", status).drop("_new").join(new.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(new)


def latest_extraction(records: DataFrame) -> DataFrame:
    """(file_id, extraction_id) of each file's last success."""
    return records.where(F.col("status") == "succeeded").groupBy("file_id").agg(F.max_by("extraction_id", F.struct("completed_at", "extraction_id")).alias("extraction_id"))


def active_chunks(chunks: DataFrame, locations: DataFrame) -> DataFrame:
    return chunks.where(F.col("chunk_status") == "active").join(locations, "chunk_id", "left")


def to_extract(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the extraction cache has not got in this content."""
    return files.join(cache.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def replaced_stale(chunks: DataFrame) -> DataFrame:
    """Stale and deleted chunks whose file has an active one: what a cleanup may remove."""
    live = chunks.where(F.col("chunk_status") == "active").select("file_id")
    return chunks.where(F.col("chunk_status").isin("stale", "deleted")).join(live, "file_id", "left_semi")


def expire(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows that are still valid; those without an end stay."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) >= now))


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """What is left of ``tables`` after the rows of ``root`` in ``gone`` go, and with them all that refers to them.

    ``links`` lists (child, child key, parent, parent key), parents before their own children.
    """
    lost = {root: tables[root].join(gone.select(key), key, "left_semi")}
    left = {**tables, root: tables[root].join(gone.select(key), key, "left_anti")}
    for child, child_key, parent, parent_key in links:
        if parent not in lost:
            continue
        keys = lost[parent].select(F.col(parent_key).alias(child_key)).distinct()
        lost[child] = tables[child].join(keys, child_key, "left_semi")
        left[child] = left[child].join(keys, child_key, "left_anti")
    return left


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Children without a parent; null keys refer to nothing and are no orphans."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def observe(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert that keeps an old value where the new one is null."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return o.join(n, cond, "full_outer").select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in old.columns])


def by_suffix(files: DataFrame, tail: str, path: str = "path") -> DataFrame:
    """The first file, by path, whose path ends so."""
    return files.where(F.col(path).endswith(tail)).orderBy(path).limit(1)


def search_history(searches: DataFrame, text: str, filters: str, at: str, limit: int = 20) -> DataFrame:
    """The last distinct searches, newest first; blank ones don't count."""
    rows = searches.where(F.trim(text) != "").groupBy(text, filters).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("times"))
    return rows.orderBy(F.col("last_at").desc(), text, filters).limit(limit)


def recent(events: DataFrame, at: str, key: str, n: int) -> DataFrame:
    return events.orderBy(F.col(at).desc(), F.col(key).desc()).limit(n)


@dataclass(frozen=True)
class Cleanup:
    """What a cleanup touches and asks for."""

    classes: tuple[str, ...]
    rebuild: bool

    @property
    def confirmation(self) -> bool:
        return self.rebuild

    @property
    def safe(self) -> bool:
        return "persistent_catalog" not in self.classes


# The cleanup actions.
CLEANUPS = {
    "clear_expired_search_cache": Cleanup(("ephemeral_cache",), False),
    "clear_snippet_cache": Cleanup(("ephemeral_cache",), False),
    "clear_temporary_extraction": Cleanup(("ephemeral_cache",), False),
    "remove_replaced_stale_indexes": Cleanup(("rebuildable_index",), True),
    "delete_keyword_index": Cleanup(("rebuildable_index",), True),
    "delete_vector_index": Cleanup(("rebuildable_index",), True),
    "remove_temporary_source_indexes": Cleanup(("rebuildable_index",), True),
    "reset_catalog": Cleanup(("persistent_catalog", "rebuildable_index", "ephemeral_cache", "operational_log"), True),
}


class UnsafeCleanup(ValueError):
    """An ordinary cleanup would touch what cannot be rebuilt."""


def clean(store, action: str, now: Column | None = None, confirmed: bool = False, index=None) -> None:
    """Run a cleanup on a store's tables, and on an index of its chunks."""
    from tarn.operators import lifecycle  # it builds on this module

    plan = CLEANUPS[action]
    if not plan.safe and not confirmed:
        raise UnsafeCleanup(action)
    if action == "clear_expired_search_cache":
        store.replace("search_queries", expire(store.read("search_queries"), now if now is not None else F.current_timestamp()))
    elif action == "clear_snippet_cache":
        store.replace("snippets", store.read("snippets").limit(0))
    elif action == "clear_temporary_extraction":
        store.replace("cache_entries", store.read("cache_entries").where(F.col("namespace") != "extraction_temporary"))
    elif action == "remove_replaced_stale_indexes":
        lifecycle.remove_chunks(store, "replaced", index)
    elif action == "delete_vector_index":
        store.replace("embeddings", store.read("embeddings").limit(0))
    elif action == "delete_keyword_index":
        store.replace("chunks", store.read("chunks").withColumn("chunk_status", F.when(F.col("chunk_status") == "active", "stale").otherwise(F.col("chunk_status"))))
    elif action == "remove_temporary_source_indexes":
        lifecycle.remove_chunks(store, "temporary", index)
    else:
        for table in ("sources", "files", "extraction_records", "chunks", "embeddings", "jobs", "search_queries", "snippets", "rerank_scores", "app_events", "cache_entries"):
            store.replace(table, store.read(table).limit(0))


def numbered(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The payload cache with new entries (namespace, path, content_hash, version, payload, created_at) in place of those of their files."""
    return upsert(cache, new, ["namespace", "path"])


def cache_fresh(cache: DataFrame, files: DataFrame, namespace: str, version: str) -> DataFrame:
    """(path, payload) of the files whose entry is of their present content and of this version."""
    own = cache.where((F.col("namespace") == namespace) & (F.col("version") == version))
    return own.join(files.select("path", "content_hash"), ["path", "content_hash"], "left_semi").select("path", "payload")


def cache_remove(cache: DataFrame, gone: DataFrame) -> DataFrame:
    return cache.join(gone.select("path"), "path", "left_anti")


def cache_cleaned(cache: DataFrame, files: DataFrame, versions: dict[str, str], now: Column) -> DataFrame:
    """The cache without entries that expired, whose file is gone, or of another version than their namespace's."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in versions.items() for x in kv]), F.col("namespace"))
    return expire(cache, now).join(files.select("path"), "path", "left_semi").where(F.col("version") == F.coalesce(known, F.col("version")))


def listed_sources(sources: DataFrame, active: bool = False) -> DataFrame:
    """Sources that were not removed, newest first; or the active ones alone."""
    rows = sources.where(F.col("source_status") == "active") if active else sources.where(F.col("source_status") != "removed")
    return rows.orderBy(F.col("created_at").desc(), "source_id")


def set_source_status(sources: DataFrame, ids: list[str], status: str) -> DataFrame:
    return sources.withColumn("source_status", F.when(F.col("source_id").isin(ids), status).otherwise(F.col("source_status")))


def touch_scanned(sources: DataFrame, ids: list[str], now: Column) -> DataFrame:
    return sources.withColumn("last_scanned_at", F.when(F.col("source_id").isin(ids), now).otherwise(F.col("last_scanned_at")))


def clean_snippets(store) -> None:
    clean(store, "clear_snippet_cache")


def clean_search_cache(store) -> None:
    clean(store, "clear_expired_search_cache")


def reset(store) -> None:
    """Everything goes; the caller has asked."""
    clean(store, "reset_catalog", confirmed=True)


def app_info() -> dict[str, str]:
    import pyspark

    return {"app": "tarn", "spark": pyspark.__version__}


def platform_info() -> dict[str, str]:
    import platform

    return {"os": platform.system().lower(), "arch": platform.machine(), "python": platform.python_version()}


# What a diagnostics bundle has and has not.
INCLUDED = ("App version", "Platform summary", "Folder status counts", "Search preparation status", "Model readiness", "Redacted logs")
EXCLUDED = ("Documents", "Search words", "Raw folder paths")


def bundle_preview(folder_names: bool = False) -> str:
    """What a user is shown before diagnostics are shared."""
    own = [f"  ✓ {x}" for x in INCLUDED] + ["  ✓ Folder names (opted in)"] * folder_names
    return "\n".join(["Included:", *own, "", "Not included:", *(f"  × {x}" for x in EXCLUDED)])
