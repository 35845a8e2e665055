"""Cases of review findings that failed once."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as e
from pyspark.sql import functions as F
from tarn.functions.nfkc import unstable
from tarn.functions.text import trigrams, upper_one
from tarn.operators import blocks, identifiers, keyword
from tarn.plans.workflows import by_language
from tarn.session import PIECE_BYTES, PIECE_ROWS, by_row

from .oracle import same_rows


def test_simple_upper_case():
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    con = duckdb.connect()
    con.register("points", pa.table({"c": chars}))
    assert all(upper_one(c) == u for c, u in con.execute("SELECT c, upper(c) FROM points").fetchall())


def test_plugin_on_odd_texts(spark, tmp_path):
    texts = ["ung össau b and more", "", None, "ﬁne ŉ ᾳ", "plain"]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts)}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    same_rows(spark, con, e.queries()["x12_plugin"], e.oracle_sql()["x12_plugin"], str(tmp_path))


def test_postings_of_asked_tokens_alone(spark):
    docs = spark.createDataFrame([(1, "a license b license"), (2, "nothing"), (3, None), (4, "licens icense")], "id int, t string")
    fields = {"text": F.col("t")}
    got = {tuple(r) for r in keyword.postings(docs, "id", fields, among=["license"]).collect()}
    assert got == {(1, 4, "text", 1, "license"), (1, 4, "text", 3, "license")}
    asked = spark.createDataFrame([(0, "icense")], "query_id int, query string")
    terms = keyword.phrases(asked, "query_id", "query", trigrams)
    assert sorted(keyword.literals(terms)) == ["cen", "ens", "ice", "nse"]
    assert [r.id for r in docs.where(keyword._holds(terms, fields, trigrams)).orderBy("id").collect()] == [1, 4]
    assert {r.id: r.dl for r in keyword.lengths(docs, "id", fields, trigrams).collect()} == {r.id: r.n for r in docs.select("id", F.size(trigrams(F.coalesce("t", F.lit("")))).alias("n")).collect()}


def test_class_of_unstable_characters_is_short():
    assert unstable().count("-") < 60


def test_identifiers_of_documents(spark):
    docs = spark.createDataFrame([(1, "Set refresh_token, refresh_token; v0.19.0"), (2, "plain words"), (3, None)], "id int, t string")
    assert sorted(r.token for r in identifiers.wholes(docs, F.col("t")).collect()) == ["refresh_token", "v0.19.0"]
    some = identifiers.graph_postings(docs, "id", F.col("t"), ["refresh_token"]).where("length > 1").collect()
    assert [(r.id, r.pos, r.dl, r.token) for r in some] == [(1, 1, 8, "refresh_token"), (1, 3, 8, "refresh_token")]


def test_trigrams_of_texts(spark):
    texts = ["", "a", "ab", "abc", "", "x", "日本語テキスト", "ab", "\U0001f600b\U0001f600b", "aaaa"]
    codes = blocks.trigram_codes(pa.array(texts))
    assert blocks.trigram_texts(codes).to_pylist() == [t[i : i + 3] for t in texts for i in range(len(t) - 2)]
    assert not len(blocks.trigram_codes(pa.array(["a", "b", "c"]))) and not len(blocks.trigram_codes(pa.array([], pa.string())))


def test_index_of_trigrams_totals_and_matches(spark, tmp_path):
    rows = [(1, "İst Abc abc", "two abc"), (2, "", None), (3, "no", "xyzabc"), (4, "refresh token here", "token refresh")]
    docs = spark.createDataFrame(rows, "chunk_id int, a string, b string")
    fields = {"a": F.col("a"), "b": F.col("b")}
    index = keyword.KeywordIndex(spark, str(tmp_path / "index"))
    index.add(docs, fields)
    want = {(r.chunk_id, r.token) for r in keyword.postings(docs, "chunk_id", fields, trigrams).collect()}
    got = [(r.chunk_id, r.token) for r in index.postings("grams").collect()]
    assert set(got) == want and len(got) == sum(r.dl for r in keyword.lengths(docs, "chunk_id", fields, trigrams).collect())
    asked = spark.createDataFrame([(7, "refresh-token"), (8, "abc"), (9, "refresh missing"), (10, "token refresh")], "query_id int, query string")
    terms = keyword.phrases(asked, "query_id", "query")

    def same():
        for kind in ("words", "grams"):
            posts = index.postings(kind)
            assert tuple(index.totals(kind).first()) == tuple(posts.agg(F.count("*"), F.count_distinct("token"), F.count_distinct("chunk_id")).first())
        return {tuple(r) for r in index.matches(terms).collect()}

    assert same() == {(7, 4), (8, 1), (10, 4)}
    index.delete(docs.where("chunk_id = 1"))
    assert same() == {(7, 4), (10, 4)}


def test_rows_are_taken_in_pieces(spark):
    run = by_row(lambda t: len(t) if t else None, "int").func
    texts = [None, *("x" * (i % 9) for i in range(299))]
    parts = list(run(iter([(pa.array(texts),)])))
    assert max(map(len, parts)) <= PIECE_ROWS and sum((p.to_pylist() for p in parts), []) == [len(t) if t else None for t in texts]
    assert [len(p) for p in run(iter([(pa.array(["y" * PIECE_BYTES] * 3),)]))] == [1, 1, 1]


def test_no_text_in_a_window_of_a_language(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}", None if i == 3 else "en" if i % 2 else "de") for i in range(9)], "doc_id bigint, text string, lang string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    ranked = by_language(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert {r.doc_id: (r.text, r.rank) for r in ranked.collect()} == {i: (f"text {i}", 1 + sum(j != 3 and j % 2 == i % 2 for j in range(i))) for i in range(9) if i != 3}
    seen, todo = 0, [ranked._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window":
            seen += 1
            assert "text" not in node.output().mkString(",")
    assert seen == 1


def test_tasks_write_their_own_blocks(spark, tmp_path, monkeypatch):
    """An index whose tasks write their blocks has a file for each task and bucket, and the results of one whose blocks are shuffled."""
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(i, " ".join(words[(i * k) % 5] for k in range(1, 9 + i % 4))) for i in range(90)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(0, "alpha"), (1, "beta gamma"), (2, "alpha-beta"), (3, "nowhere")], "query_id long, query string")
    found, totals = [], []
    for name, least in (("shuffled", 1 << 40), ("own", 0)):
        monkeypatch.setattr(keyword, "OWN_BYTES", least)
        index = keyword.KeywordIndex(spark, str(tmp_path / name))
        index.add(docs, {"text": F.col("text")})
        found.append(index.search(asked, 20).orderBy("query_id", "rank").collect())
        totals.append(index.totals("words").first())
    assert found[0] == found[1] and len(found[0]) >= 40 and totals[0] == totals[1]
    assert len(list((tmp_path / "own" / "1" / "words" / "bucket=0").glob("*.parquet"))) == 3
    assert len(list((tmp_path / "shuffled" / "1" / "words" / "bucket=0").glob("*.parquet"))) == 1


def test_results_meet_files_without_a_shuffle_of_texts(spark):
    """Few candidates are sent to the chunks and files, whatever Spark takes these tables' sizes for."""
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        plan = e.queries()["h4_h9_search_results"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert plan.count("BroadcastHashJoin") >= 2


def odd_documents(tmp_path) -> duckdb.DuckDBPyConnection:
    """Documents with and without text, of every extension."""
    texts = ["One line.", "", None, " \t\n", "Two\nlines. \n", "w " * 900]
    rows = [{"doc_id": 6 * i + k, "text": t, "lang": "en", "source": "s", "n_chars": len(t or "")} for i, t in enumerate(texts) for k in range(6)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    return con


def test_no_chunks_of_files_without_text(spark, tmp_path):
    con = odd_documents(tmp_path)
    same_rows(spark, con, e.queries()["c1_c3_packed_chunks"], e.oracle_sql()["c1_c3_packed_chunks"], str(tmp_path))


def test_routing_of_files_without_text(spark, tmp_path):
    con = odd_documents(tmp_path)
    same_rows(spark, con, e.queries()["x8_x9_extract_routing"], e.oracle_sql()["x8_x9_extract_routing"], str(tmp_path))
