"""Every operator on nulls, empty texts, repeated rows, empty tables and extra columns of clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import bpe, chaining, decontam, hostbayes, langid, licenses, linededup, rules, simhash, tokencount

OPERATORS = {
    "bpe": lambda d, b, y: bpe.round_trip(d),
    "tokencount": lambda d, b, y: tokencount.token_counts(d),
    "licenses": lambda d, b, y: licenses.scan_licenses(d),
    "linededup": lambda d, b, y: linededup.remove_boilerplate(d),
    "chaining": lambda d, b, y: chaining.shared_passages(d),
    "rules": lambda d, b, y: rules.quality(d, y),
    "decontam": lambda d, b, y: decontam.contaminated(d, b),
    "hostbayes": lambda d, b, y: hostbayes.site_quality(d, y, F.col("source"), F.col("lang")),
    "simhash": lambda d, b, y: simhash.near_duplicates(d),
    "langid": lambda d, b, y: langid.identify(d),
}
ROW_FOR_ROW = {"bpe", "tokencount", "linededup", "rules", "hostbayes", "simhash", "langid"}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "the cat and the dog. " * 30, "en", "s1", 630), (1, "the cat and the dog. " * 30, "en", "s1", 630), (2, None, None, None, None), (3, "", "de", "s2", 0), (None, "der hund", "de", None, 8), (None, None, None, None, None), (4, " \n\t \n", "en", "s1", 5), (5, "x" * 200_000, "en", "s3", 200_000), (6, "w " * 50_000, None, "s3", 100_000)]


def tables(spark, rows, clash):
    docs = spark.createDataFrame(rows, COLUMNS)
    if clash:
        for c in ("th", "h1", "key", "fp", "a", "b", "doc", "pos", "line", "p", "n", "s", "host", "path", "body", "words", "family", "paragraph", "score", "held_out", "kept", "site", "item_id", "_text", "_id", "component_id", "n_tokens", "lang_pred", "__tarn_drop", "__tarn_own", "__tarn_id", "__tarn_th", "__tarn_parts", "__tarn_pred", "__tarn_kept", "host_posterior", "p0", "n0", "chain", "edge", "pair"):
            docs = docs.withColumn(c, F.lit("clash"))
    bench = spark.createDataFrame([(1, "the cat and the dog. the cat"), (2, None), (2, None), (None, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    return docs, bench, labels


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(spark, name):
    run = OPERATORS[name]
    plain = run(*tables(spark, ROWS, False)).collect()
    if name in ROW_FOR_ROW:
        assert len(plain) == len(ROWS)
    docs, bench, labels = tables(spark, ROWS, True)
    clash = run(docs, bench, labels).select(*run(*tables(spark, [], False)).columns).collect()
    assert sorted(map(repr, clash)) == sorted(map(repr, plain))
    for none in (tables(spark, [], False), (tables(spark, [], False)[0], bench.limit(0), labels.limit(0))):
        assert run(*none).count() == 0
    only = run(docs, bench.limit(0), labels.limit(0)).count()
    assert only == (len(ROWS) if name in ROW_FOR_ROW else 0 if name == "decontam" else len(plain))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, tmp_path, name, stage):
    tables(spark, [], False)[1].write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows, clash in ((ROWS, False), ([], False), (ROWS, True)):
        docs = tables(spark, rows, clash)[0]
        out = stage(spark, docs, str(tmp_path))
        got = out.count()
        if name != "bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert got <= len(rows)


def test_texts_of_one_id_are_told_apart(spark):
    """Null and repeated ids: each component keeps one row, and only the text that holds an item goes."""
    item = "one two three four five six seven"
    rows = [(None, f"clean words of a text {i} " * 5, "en", "s", 0) for i in range(3)] + [(1, "a b c d " * 9, "en", "s", 0), (1, "e f g h i " * 9, "en", "s", 0), (1, f"x {item} y", "en", "s", 0), (None, item, "en", "s", 0), (2, "a b c d " * 9, "en", "s", 0)]
    docs = spark.createDataFrame(rows + rows, COLUMNS)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontam.without_contaminated(docs, bench).collect()
    assert sorted(r.text for r in kept) == sorted(2 * [t for _, t, *_ in rows if item not in t])
    one = simhash.one_of_each(docs)
    n = simhash.grouped(docs).select("root").distinct().count()
    assert one.columns == docs.columns and one.count() == n and not one.where("doc_id = 2").count()
