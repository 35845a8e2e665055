"""Groups, chips and chunks by budget on small cases and random texts, beside their queries' SQL."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import budget, grouping

HITS = "query_id long, chunk_id long, parent_chunk_id long, file_id long, line_start int, line_end int, rank int"


def grouped(spark, rows, **named):
    return [tuple(r) for r in grouping.nearby(spark.createDataFrame(rows, HITS), **named).orderBy("query_id", "group_rank").collect()]


def test_neighbours_merge_and_parents_fold(spark):
    rows = [
        (1, 10, 5, 7, 1, 4, 3), (1, 11, 5, 7, 6, 9, 2), (1, 12, 5, 7, 30, 40, 6),  # two near ones and one far away
        (1, 5, 0, 7, 1, 50, 1), (1, 0, None, 7, 1, 90, 4),  # their section and its document
        (1, 20, 15, 8, 2, 3, 5), (1, 20, 15, 8, 2, 3, 9),  # the same chunk twice
        (2, 10, 5, 7, 1, 4, 1),
    ]
    assert grouped(spark, rows) == [(1, 1, 7, 1, 9, 11, 1, 3), (1, 2, 8, 2, 3, 20, 5, 0), (1, 3, 7, 30, 40, 12, 6, 0), (2, 1, 7, 1, 4, 10, 1, 0)]
    assert grouped(spark, rows, gap=50)[0] == (1, 1, 7, 1, 40, 11, 1, 4)
    # without folding the section holds them all
    assert grouped(spark, rows, levels=0)[0] == (1, 1, 7, 1, 90, 5, 1, 4)
    assert grouped(spark, []) == []


def test_overlapping_and_nested_intervals(spark):
    rows = [(1, 1, None, 1, 1, 100, 9), (1, 2, None, 1, 5, 6, 8), (1, 3, None, 1, 103, 104, 7), (1, 4, None, 1, 109, 110, 6)]
    assert grouped(spark, rows) == [(1, 1, 1, 109, 110, 4, 6, 0), (1, 2, 1, 1, 104, 3, 7, 2)]


def test_chips_narrow_and_differ(spark):
    rows = [(1, i, "en" if i <= 6 else "de", "a" if i <= 6 else "b" if i <= 8 else None, "x") for i in range(1, 11)]
    rows += [(2, i, "en", "a", "x") for i in range(1, 4)] + [(3, i, "en", f"s{i}", "x") for i in range(1, 6)] + [(4, i, "fr" if i > 200 else "en", str(i % 2), "x") for i in range(1, 301)]
    df = spark.createDataFrame(rows, "query_id long, rank int, lang string, source string, kind string")
    got = sorted(tuple(r) for r in grouping.chips(df, ["lang", "source", "kind"]).collect())
    # all results have the kind, so it narrows nothing; the source says the same as the language; three results need no chips
    assert got == [(1, 1, "lang", "en", 6, 6), (1, 2, "lang", "de", 4, 4), (3, 1, "source", "s1", 1, 1), (3, 2, "source", "s2", 1, 1), (3, 3, "source", "s3", 1, 1), (4, 1, "lang", "en", 200, 200), (4, 2, "lang", "fr", 100, 100)]
    assert grouping.chips(df.limit(0), ["lang"]).count() == 0


@pytest.mark.parametrize("mode", list(budget.MODES))
def test_token_chunks_cover_and_keep_the_budget(spark, mode):
    r = random.Random(3)
    own = budget.MODES[mode]
    word = lambda: "".join(r.choice("abcdeé日1") for _ in range(r.randrange(1, 8)))
    texts = ["", None, "  \n ", "one", "--- !", "x " * 5_000, ("long line " * 40 + "\n\n") * 30, "".join(word() + r.choice([" ", " ", ", ", "\n", "\n\n", " \n \n"]) for _ in range(4_000))]
    rows = budget.token_chunks(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", mode).collect()
    for i, text in enumerate(texts):
        parts = sorted((x.ordinal, x.token_start, x.token_end, x.content) for x in rows if x.id == i)
        if not text:
            assert not parts
            continue
        n = len(budget.TOKEN.findall(text))
        assert parts[0][1] == 0 and parts[-1][2] == n and text.startswith(parts[0][3]) and text.endswith(parts[-1][3])
        for (_, s, e, content), after in zip(parts, [*parts[1:], None]):
            assert e - s <= own.most and content in text and len(budget.TOKEN.findall(content)) == e - s
            assert after is None or after[1] == e - own.overlap and e > s + own.target // 2
    # paragraphs are kept together where they can be
    para = [x.content for x in rows if x.id == 6]
    assert all(p.endswith("\n\n") or p == para[-1] for p in para)


def test_csv_groups(spark):
    r = random.Random(8)
    cell = lambda: "".join(r.choice(['a', 'b', '"', ",", "\n", "é", " "]) for _ in range(r.randrange(30)))
    tables = []
    for n in (0, 1, 5, 200):
        out = io.StringIO()
        rows = [["id", "t,x", "no\nte"], *([str(i), cell(), cell()] for i in range(n))]
        csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
        tables.append((out.getvalue(), rows))
    found = budget.csv_groups(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(tables)] + [(90, None), (91, ""), (92, 'a\n"open\nx'), (93, "a\n" + "b" * 5_000 + "\nc")], "id long, t string"), "id", "t").collect()
    for i, (text, rows) in enumerate(tables):
        own = sorted((x for x in found if x.id == i), key=lambda x: x.ordinal)
        got = []
        for x in own:
            part = list(csv.reader(io.StringIO(x.content)))
            assert part[0] == rows[0] and x.chunk_kind == "table"
            assert len(part) - 1 == (x.row_end - x.row_start + 1 if len(rows) > 1 else 0)
            assert len(x.content.encode()) <= 1_200 or x.row_start == x.row_end
            lines = text.split("\n")[x.line_start - 1 : x.line_end]
            assert x.content.endswith("\n".join(lines))
            got += part[1:]
        assert got == rows[1:] and [x.ordinal for x in own] == list(range(len(own)))
    assert [(x.row_start, x.row_end, x.content) for x in found if x.id == 92] == [(1, 1, 'a\n"open\nx')]
    assert [(x.row_start, x.row_end) for x in found if x.id == 93] == [(1, 1), (2, 2)] and not [x for x in found if x.id in (90, 91)]
    assert budget.record_ends(b'a,"b\n""c"\nd').tolist() == [10, 11] and np.array_equal(budget.record_ends(b"a\r\nb\r\n"), [3, 6])


def test_no_window_of_a_whole_query(spark):
    """A query's places are numbered in parts of its order, with the same numbers as by one sort."""
    rng = random.Random(18)
    hits = [(q, c, None, c // 5, c % 5 * 50, c % 5 * 50 + 1, r) for q in (1, 2) for r, c in enumerate(rng.sample(range(400), 300), 1)]
    df = spark.createDataFrame(hits, HITS)
    got = grouping.numbered(df, F.floor(F.col("rank") / 7), ["rank"], "place")
    assert [r.place for r in got.orderBy("query_id", "rank").collect()] == [*range(1, 301)] * 2
    groups = grouping.nearby(df)
    assert [r.rank for r in groups.orderBy("query_id", "group_rank").collect()] == [r.group_rank for r in groups.orderBy("query_id", "group_rank").collect()] == [*range(1, 301)] * 2
    todo = [groups._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window":
            # but for the counts of the parts
            assert "_part" in node.partitionSpec().mkString(",") or "_n" in node.output().mkString(",")
