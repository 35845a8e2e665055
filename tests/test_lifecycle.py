"""Nothing is left behind: cascades over all tables and postings, bundles, extraction runs, scan reports, cache probes and rerank scores."""

import pytest
from pyspark.sql import functions as F

from tarn.functions.vectors import mock_embedding
from tarn.operators import catalog, lifecycle
from tarn.operators.keyword import KeywordIndex
from tarn.sources.schema import TABLES
from tarn.sources.store import Store

NOW = "2024-06-01 00:00:00"


def at(text=NOW):
    return F.lit(text).cast("timestamp")


def put(store, table, rows, names):
    df = store.spark.createDataFrame(rows, names)
    schema = store.spark.createDataFrame([], TABLES[table]).schema
    store.append(table, df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))


@pytest.fixture
def full(spark, tmp_path):
    """Three sources of two files of two chunks each, with something of each kind for all of them, and postings."""
    store, n = Store(spark, str(tmp_path / "s")), range(12)
    put(store, "sources", [(f"s{i}", "temporary" if i == 2 else "folder") for i in range(3)], "source_id string, source_type string")
    put(store, "files", [(f"f{i}", f"s{i // 2}", f"/r/{i}.md", "indexed") for i in range(6)], "file_id string, source_id string, canonical_path string, file_status string")
    put(store, "jobs", [(f"j{i}", f"s{i % 3}") for i in range(6)] + [("free", None)], "job_id string, source_id string")
    put(store, "extraction_records", [(f"e{i}", f"f{i}", "succeeded") for i in range(6)], "extraction_id string, file_id string, status string")
    put(store, "cache_entries", [("extraction", f"/r/{i}.md", "h") for i in range(6)], "namespace string, path string, content_hash string")
    put(store, "chunks", [(f"c{i}", f"f{i // 2}", "e", "stale" if i in (0, 4) else "active", f"word{i} all") for i in n], "chunk_id string, file_id string, extraction_id string, chunk_status string, normalized_text string")
    put(store, "embeddings", [(f"c{i}", "m") for i in n], "chunk_id string, model_id string")
    put(store, "snippets", [(f"c{i}", "q") for i in n], "chunk_id string, query_id string")
    index = KeywordIndex(spark, str(tmp_path / "i"))
    index.add(store.read("chunks"), {"text": F.col("normalized_text")})
    return store, index


def found(index, word):
    q = index.spark.createDataFrame([(0, word)], "query_id long, query string")
    return {r.chunk_id for r in index.search(q).collect()}


def clean(store):
    return all(r.n == 0 for r in lifecycle.orphans(store).collect())


def test_a_source_takes_all_with_it(full):
    store, index = full
    lifecycle.remove_source(store, "s0", index)
    assert clean(store) and found(index, "all") == {f"c{i}" for i in range(4, 12)} and not found(index, "word1")
    assert {t: store.read(t).count() for t in ("sources", "files", "jobs", "extraction_records", "cache_entries", "chunks", "embeddings", "snippets")} == {"sources": 2, "files": 4, "jobs": 5, "extraction_records": 4, "cache_entries": 4, "chunks": 8, "embeddings": 8, "snippets": 8}


@pytest.mark.parametrize("action, left", [("remove_replaced_stale_indexes", {f"c{i}" for i in range(12)} - {"c0", "c4"}), ("remove_temporary_source_indexes", {f"c{i}" for i in range(8)})])
def test_cleanups_leave_no_vectors_or_postings(full, action, left):
    store, index = full
    catalog.clean(store, action, index=index)
    assert clean(store) and found(index, "all") == left == {r.chunk_id for r in store.read("embeddings").collect()} == {r.chunk_id for r in store.read("snippets").collect()}


def segments(spark, file_id, extraction, *texts):
    rows = [(file_id, extraction, "n.md", [("other", t, i, i, "lines", None, "exact") for i, t in enumerate(texts, 1)])]
    return spark.createDataFrame(rows, "file_id string, extraction_id string, path string, segments array<struct<kind:string, text:string, line_start:int, line_end:int, location_kind:string, heading_path:string, location_quality:string>>")


def test_a_bundle_replaces_chunks_postings_and_vectors(spark, tmp_path):
    store, index = Store(spark, str(tmp_path / "s")), KeywordIndex(spark, str(tmp_path / "i"))
    lifecycle.publish(store, segments(spark, "f1", "e1", "alpha beta"), index, mock_embedding)
    lifecycle.publish(store, segments(spark, "f2", "e2", "alpha gamma"), index, mock_embedding)
    first = found(index, "beta")
    lifecycle.publish(store, segments(spark, "f1", "e3", "alpha delta"), index, mock_embedding)
    active = {r.chunk_id for r in store.read("chunks").where("chunk_status = 'active'").collect()}
    assert first and not found(index, "beta") and found(index, "delta") < active and found(index, "alpha") == active
    assert {r.chunk_id for r in store.read("embeddings").collect()} >= active
    # the same once more changes nothing
    lifecycle.publish(store, segments(spark, "f1", "e3", "alpha delta"), index, mock_embedding)
    assert {r.chunk_id for r in store.read("chunks").where("chunk_status = 'active'").collect()} == active == found(index, "alpha")


def test_extraction_is_guarded_cached_recorded_and_queued(spark, tmp_path):
    store, root = Store(spark, str(tmp_path / "s")), tmp_path / "r"
    root.mkdir()
    for name, body in (("a.md", b"# A\nx"), ("b.md", b"b"), ("bad.md", b"\xff\xfe"), ("c.xyz", b"c")):
        (root / name).write_bytes(body)
    paths = ["a.md", "b.md", "bad.md", "c.xyz", "gone.md", ".h.md", "../out.md"]
    files = [(f"f{i}", "s", f"{root}/{p}", f"h{i}", 5, "discovered") for i, p in enumerate(paths)]
    names = "file_id string, source_id string, canonical_path string, content_hash string, size_bytes long, file_status string"
    put(store, "files", files, names)
    df = spark.createDataFrame(files, names)
    assert lifecycle.extract_files(store, df.where("file_id <> 'f1'"), [str(root)], now=at()) == {"fresh": 0, "extracted": 1, "failed": 5}
    assert lifecycle.extract_files(store, df.where("file_id in ('f0', 'f1')"), [str(root)], now=at()) == {"fresh": 1, "extracted": 1, "failed": 0}
    assert {r.file_id for r in store.read("jobs").where("job_kind = 'chunk' and status = 'queued'").collect()} == {"f0", "f1"} and store.read("jobs").count() == 2
    status = {r.file_id: r.file_status for r in store.read("files").collect()}
    assert status == {"f0": "discovered", "f1": "discovered", "f2": "failed", "f3": "unsupported", "f4": "failed", "f5": "failed", "f6": "failed"}
    assert {(r.file_id, r.status) for r in store.read("extraction_records").collect()} == {(f"f{i}", "succeeded" if i < 2 else "failed") for i in range(7)}
    # another content is no longer fresh
    assert lifecycle.extract_files(store, df.where("file_id = 'f0'").withColumn("content_hash", F.lit("new")), [str(root)], now=at())["extracted"] == 1
    assert store.read("cache_entries").count() == 2


def test_lookups_and_status(spark):
    files = spark.createDataFrame([("f1", "s1", "/a", "indexed"), ("f2", "s2", "/a", "indexed"), ("f3", "s1", "/b", "stale")], "file_id string, source_id string, canonical_path string, file_status string")
    assert [r.file_id for r in lifecycle.files_by_id(files, spark.createDataFrame([("f2",), ("f2",), ("f9",)], "file_id string")).collect()] == ["f2"]
    assert [r.file_id for r in lifecycle.files_by_path(files, spark.createDataFrame([("s1", "/a")], "source_id string, canonical_path string")).collect()] == ["f1"]
    out = lifecycle.set_status(files, spark.createDataFrame([("f1", "missing"), ("f9", "missing")], "file_id string, file_status string"))
    assert out.columns == files.columns and {(r.file_id, r.file_status) for r in out.collect()} == {("f1", "missing"), ("f2", "indexed"), ("f3", "stale")}


def test_scan_report_counts_problems(spark):
    changes = spark.createDataFrame([("s", "/a.md", "new", True), ("s", "/b.xyz", "new", True), ("s", "/c.md", "missing", False), ("s", "/d.md", "restored", False)], "source_id string, path string, outcome string, enqueue boolean")
    bad = spark.createDataFrame([("s", "/x", "permission_denied"), ("t", "/y", "failed")], "source_id string, path string, problem string")
    rows = {r.source_id: r for r in lifecycle.scan_report(changes, bad, at(), at("2024-06-01 00:00:02.5")).collect()}
    assert rows["s"][1:] == (3, 2, 0, 0, 1, 1, 1, 1, 0, 2, 2_500, False) and rows["t"][1:] == (0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 2_500, False)
    assert lifecycle.scan_report(changes, bad, at(), at(), F.lit(True)).where("missing > 0 or not canceled").count() == 0


def test_probe_puts_broken_files_aside(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert lifecycle.probe(store) == "absent"
    put(store, "cache_entries", [("n", "/a", "h")], "namespace string, path string, content_hash string")
    assert lifecycle.probe(store) == "ok"
    for f in (tmp_path / "s" / "cache_entries").rglob("*.parquet"):
        f.write_bytes(b"no parquet")
        for crc in f.parent.glob(f".{f.name}.crc"):
            crc.unlink()
    assert lifecycle.probe(store) == "rebuilt" and store.read("cache_entries").count() == 0 and lifecycle.probe(store) == "absent"


def test_rerank_scores_are_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    cache = lifecycle.RerankCache(store, "m1", lambda q, t: F.length(t), days=10)
    rows = [(1, "q", f"c{i}", "T", "H", "x" * (i % 4), i) for i in range(1, 9)] + [(2, "q ", "c1", "T", "H", "x", 1)]
    df = spark.createDataFrame(rows, "query_id long, query string, chunk_id string, title string, heading_path string, text string, rank int")
    first = sorted(map(tuple, cache.ranked(df, at()).collect()))
    # the second query is the first one, spelt with a blank
    assert cache.scored == 8 and [r[2] for r in sorted(first, key=lambda r: (r[0], r[6]))][:3] == ["c3", "c7", "c2"]
    assert sorted(map(tuple, cache.ranked(df, at()).collect())) == first and cache.scored == 0
    cache.ranked(df.withColumn("text", F.when(F.col("chunk_id") == "c5", "other").otherwise(F.col("text"))), at())
    assert cache.scored == 1
    other = lifecycle.RerankCache(store, "m2", lambda q, t: F.length(t))
    assert other.ranked(df, at()).count() == 9 and other.scored == 8
    assert cache.ranked(df, at("2024-06-20 00:00:00")).count() == 9 and cache.scored == 8
    cache.clean(at("2024-06-20 00:00:00"))
    assert store.read("rerank_scores").count() == 0  # no chunk is active
