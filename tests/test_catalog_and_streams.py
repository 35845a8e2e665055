import pytest
from pyspark.sql import functions as F

from tarn.operators import catalog, filters, fusion, jobs, metrics, vector
from tarn.plans.search import SearchEngine
from tarn.sources.store import Store
from tarn.streaming.indexing import event_windows, index_folder, retry_states
from tests.conftest import SF


def test_changes(spark):
    cat = spark.createDataFrame([("s", "a", 1, "h", "indexed", True), ("s", "b", 1, "h", "indexed", True), ("s", "c", 1, "h", "missing", True), ("s", "d", 1, "h", "missing", False), ("s", "e", 1, "h", "discovered", False), ("s", "f", 1, "h", "deleted", True)], "source_id string, path string, size_bytes long, content_hash string, file_status string, ever_indexed boolean").withColumn("modified_at", F.lit("2024-01-01").cast("timestamp"))
    snap = spark.createDataFrame([("s", "a", 1, "h"), ("s", "b", 2, "x"), ("s", "c", 1, "h"), ("s", "d", 1, "h"), ("s", "n", 1, "h")], "source_id string, path string, size_bytes long, content_hash string").withColumn("modified_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.path: (r.outcome, r.new_status) for r in catalog.detect_changes(snap, cat).collect()}
    assert got == {"a": ("touched", "indexed"), "b": ("modified", "stale"), "c": ("restored", "indexed"), "d": ("restored", "discovered"), "e": ("missing", "missing"), "f": ("gone", "deleted"), "n": ("new", "discovered")}


def test_cleanup(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [("q1", "a", "", "2024-01-01", "2024-01-02"), ("q2", "b", "", "2024-01-01", None)]
    store.replace("search_queries", spark.createDataFrame(rows, "query_id string, query_text string, filters string, created_at string, expires_at string"))
    catalog.clean(store, "clear_expired_search_cache", F.lit("2024-02-01").cast("timestamp"))
    assert [r.query_id for r in store.read("search_queries").collect()] == ["q2"]
    with pytest.raises(catalog.UnsafeCleanup):
        catalog.clean(store, "reset_catalog")
    catalog.clean(store, "reset_catalog", confirmed=True)
    assert store.read("search_queries").count() == 0


def test_rrf(spark):
    kw = spark.createDataFrame([(0, "a", 1), (0, "c", 2)], "query_id int, id string, rank int")
    vec = spark.createDataFrame([(0, "b", 1), (0, "a", 2)], "query_id int, id string, rank int")
    got = [(r.id, r["rank"]) for r in fusion.rrf(kw, vec, "id", 10).orderBy("rank").collect()]
    assert got == [("a", 1), ("b", 2), ("c", 3)]


def test_top_k_batch_blocks(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0")
    a = vector.top_k_batch(e, "vec_id", "embedding", q, "vec_id", "embedding", 5).orderBy("query_id", "rank").collect()
    b = vector.top_k_batch(e, "vec_id", "embedding", q, "vec_id", "embedding", 5, block=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in a] == [(r.query_id, r.vec_id) for r in b] and len(a) == 5 * q.count()


def test_filters():
    f = filters.Filter("kind", "notes")
    active = filters.ActiveFilters().add(f).add(f).add(filters.Filter("status", "ready"))
    assert len(active.items) == 2 and len(active.remove(0).items) == 1 and not active.cleared().items
    assert not filters.Privacy("strict").keeps_snippets() and filters.Privacy().keeps_recent_searches()
    assert filters.Scope("/a").with_subfolders(False).folder == "/a" and filters.Scope("/a").cleared().folder is None


def test_engine_degrades_and_limits(spark):
    files = spark.createDataFrame([("f1", "s", "/c/a.md", "indexed", "alpha beta\nsecond"), ("f2", "s", "/c/b.md", "stale", "alpha"), ("f3", "s", "/d/c.md", "indexed", "gamma")], "file_id string, source_id string, path string, file_status string, text string").withColumn("modified_at", F.current_timestamp())
    chunks = files.select(F.concat(F.lit("c"), "file_id").alias("chunk_id"), "file_id", F.lit(None).cast("string").alias("heading_path"), F.lit("").alias("title"), F.col("text").alias("normalized_text"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("active").alias("chunk_status"))
    engine = SearchEngine(chunks, files)
    q = spark.createDataFrame([(0, "alpha"), (1, "")], "query_id long, query string")
    rows = engine.search(q, "auto", 5).orderBy("rank").collect()
    assert engine.capability == "keyword_only" and {r.file_id for r in rows} == {"f1", "f2"}
    assert {r.file_id: r.trust_state for r in rows} == {"f1": "ready", "f2": "needs_update"}
    assert next(r for r in rows if r.file_id == "f1").snippet == "alpha beta"
    only = engine.search(q, "exact", 5, filters.ActiveFilters().add(filters.Filter("status", "ready")), filters.Scope("/c")).collect()
    assert [r.file_id for r in only] == ["f1"]


def test_filters_come_before_the_cut(spark):
    """A filtered search fills its limit from all fused candidates."""
    rows = [(f"f{i:02d}", "s", f"/{'a' if i < 10 else 'b'}/{i:02d}.md", "indexed", "alpha " * (12 - i // 2)) for i in range(20)]
    files = spark.createDataFrame(rows, "file_id string, source_id string, path string, file_status string, text string").withColumn("modified_at", F.current_timestamp())
    chunks = files.select(F.col("file_id").alias("chunk_id"), "file_id", F.lit(None).cast("string").alias("heading_path"), F.lit("").alias("title"), F.col("text").alias("normalized_text"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("active").alias("chunk_status"))
    got = SearchEngine(chunks, files).search(spark.createDataFrame([(0, "alpha")], "query_id long, query string"), "exact", 5, scope=filters.Scope("/b")).collect()
    assert len(got) == 5 and all(r.path.startswith("/b/") for r in got) and sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]


def test_index_segments(spark, tmp_path):
    from tarn.operators.keyword import KeywordIndex

    index = KeywordIndex(spark, str(tmp_path / "i"), "id", 4)
    df = lambda rows: spark.createDataFrame(rows, "id long, text string")
    found = lambda q: sorted(r.id for r in index.search(spark.createDataFrame([(0, q)], "query_id long, query string")).collect())
    index.add(df([(1, "alpha beta"), (2, "alpha gamma"), (3, None)]), {"text": F.col("text")})
    assert found("alpha") == [1, 2] and found("alpha-gamma") == [2] and found("none") == []
    index.add(df([(2, "delta"), (4, "alpha")]), {"text": F.col("text")})
    assert found("alpha") == [1, 4] and found("delta") == [2]
    index.delete(df([(1, "")]))
    assert found("alpha") == [4]
    # a segment without its mark is not there
    (tmp_path / "i" / "9").mkdir()
    assert found("alpha") == [4]
    index.compact()
    assert found("alpha") == [4] and found("delta") == [2] and index.live("words").count() == 3


def test_percentiles(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 25)], "g string, v double")
    r = metrics.percentiles(df, "v", ["g"]).first()
    assert (r.p50, r.p90, r.p99) == (13.0, 22.0, 24.0)


def test_jobs_in_memory(spark):
    j = spark.createDataFrame([(1, "scan", "queued", 0), (2, "embedding", "queued", 9), (3, "extract", "queued", 5), (4, "scan", "queued", 1)], "job_id long, job_kind string, status string, priority int").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert [r.job_id for r in jobs.pop_order(j, True).orderBy("turn").collect()] == [4, 1, 3]
    assert [r.job_id for r in jobs.pop_order(j).orderBy("turn").collect()] == [4, 1, 3, 2]


def test_index_folder_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# A\nalpha")
    (folder / "skip.tmp").write_text("x")
    (folder / "bad.md").write_bytes(b"\xff\xfe")
    (folder / "node_modules").mkdir()
    (folder / "node_modules" / "d.md").write_text("# no")
    for name, n in (("", 2), ("b.md", 4)):
        if name:
            (folder / name).write_text("# B\nbeta")
        index_folder(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"), failures=str(tmp_path / "failed")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
    failed = spark.read.parquet(str(tmp_path / "failed"))
    assert {(r.path.split("/")[-1], r.file_status, r.error_category) for r in failed.collect()} == {("bad.md", "failed", "encoding_error"), ("skip.tmp", "failed", "unsupported_type")}


def test_retry_stream(spark, tmp_path):
    rows = [("j1", "failed")] * 3 + [("j2", "failed"), ("j2", "succeeded"), ("j3", "failed")]
    spark.createDataFrame(rows, "job_id string, outcome string").coalesce(1).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema("job_id string, outcome string").parquet(str(tmp_path / "log"))
    q = retry_states(log).writeStream.outputMode("update").format("memory").queryName("retries").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.job_id: (r.failures, r.status) for r in spark.table("retries").collect()} == {"j1": (3, "failed"), "j2": (1, "succeeded"), "j3": (1, "queued")}


def test_event_windows(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    assert event_windows(e, "ts").agg(F.sum("n")).first()[0] == e.count()
