import random
import sys
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.functions.nfkc import nfkc
from tarn.operators import identifiers as ids


def test_nfkc_of_all_code_points(spark):
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    points = spark.createDataFrame(pa.table({"id": codes, "own": [chr(c) for c in codes]}))
    # a code point alone, and between a base letter and a mark
    rows = points.select("id", nfkc(F.col("own")).alias("alone"), nfkc(F.concat(F.lit("e"), "own", F.lit("\u0301\u1161"))).alias("among")).toPandas()
    for code, alone, among in rows.itertuples(index=False):
        assert alone == unicodedata.normalize("NFKC", chr(code)) and among == unicodedata.normalize("NFKC", f"e{chr(code)}\u0301\u1161"), hex(code)


def test_nfkc_of_texts(spark):
    draw = random.Random(7)
    signs = "aẹ́̈ＡＢ１ｶﾞ①ﬁ½각각… zZ\n가"
    texts = [None, "", "plain", "x" * 100_000 + "ﬁ", *("".join(draw.choices(signs, k=draw.randint(1, 30))) for _ in range(2_000))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", nfkc(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]


TEXTS = {
    1: "Set refresh_token first; CVE-2026-0001 was fixed in v0.19.0.",
    2: "set refresh token first",
    3: "ＡＢＣ－１２３ and ITストラテジスト試験",
    4: "refresh_token refresh_token, client_secret",
    5: "",
    6: None,
    7: "refresh_token_old",
    8: "... - _ !",
}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id int, t string")


def test_graph(spark):
    got = {r.id: [tuple(p) for p in r.g] for r in frame(spark, TEXTS).select("id", ids.graph(F.col("t")).alias("g")).collect()}
    assert got[1][:4] == [("set", None, None), ("refresh", "refresh_token", 2), ("token", None, None), ("first", None, None)]
    assert ("cve", "cve-2026-0001", 3) in got[1] and got[1][-3:] == [("v0", "v0.19.0", 3), ("19", None, None), ("0", None, None)]
    assert got[3] == [("abc", "abc-123", 2), ("123", None, None), ("and", None, None), ("it", "itストラテジスト試験", 2), ("ストラテジスト試験", None, None)]
    assert got[5] == got[6] == got[8] == []


@pytest.mark.parametrize(
    "query, exact, want",
    [
        ("refresh_token", True, {1: 1, 4: 2}),
        ("refresh_token", False, {1: 1, 2: 1, 4: 2, 7: 1}),
        ("refresh token", True, {1: 1, 2: 1, 4: 2, 7: 1}),
        ("Refresh_Token first", True, {1: 1}),
        ("token first", True, {1: 1, 2: 1}),
        ("set refresh_token first", False, {1: 1, 2: 1}),
        ("0001 was fixed in v0.19.0", True, {1: 1}),
        ("token refresh_token client_secret", True, {4: 1}),
        ("abc-123", True, {3: 1}),
        ("ＩＴストラテジスト試験", True, {3: 1}),
        ("!", True, {}),
    ],
)
def test_phrases(spark, query, exact, want):
    queries = spark.createDataFrame([(0, query), (1, None), (2, "")], "query_id int, query string")
    rows = ids.phrase_hits(frame(spark, TEXTS), queries, "id", F.col("t"), exact=exact).collect()
    assert {r.id: r.hits for r in rows} == want and all(r.query_id == 0 for r in rows)
