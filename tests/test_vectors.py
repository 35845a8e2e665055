"""Vector search against a plain scan: nulls, ties, other dimensions; cells of pivots give the same rows and read less where vectors are in groups."""

import numpy as np
import pytest

from tarn.operators import vector
from tarn.operators.pivots import PivotIndex

NAN = float("nan")
ODD = [(None, [1.0, 0.0, 0.0]), (901, [NAN, 1.0, 1.0]), (902, [None, 1.0, 1.0]), (903, None), (904, []), (905, [1.0, 2.0]), (906, [float("inf"), 0.0, 0.0]), (907, [float("-inf"), 0.0, 0.0])]


def frame(spark, rows, names="id long, v array<float>"):
    return spark.createDataFrame(rows, names)


def plain(rows, asked, k):
    out = []
    for i, q in asked:
        if i is None or q is None or not all(x is not None and np.isfinite(x) for x in q):
            continue
        good = [(key, v) for key, v in rows if key is not None and v is not None and len(v) == len(q) > 0 and all(x is not None and np.isfinite(x) for x in v)]
        best = sorted((-round(float(np.dot(np.float32(v).astype(float), np.float32(q).astype(float))), 6), key) for key, v in good)[:k]
        out += [(i, key, -s, n) for n, (s, key) in enumerate(best, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r.id, round(r.score, 6) + 0.0, r["rank"]) for r in df.collect())


def test_odd_rows_do_not_count(spark):
    rows = [(i, [float(i % 3), 1.0, -1.0]) for i in range(30)] + ODD
    asked = [(1, [1.0, 0.5, 0.0]), (2, [NAN, 0.0, 0.0]), (3, None), (4, [1.0, None, 1.0]), (5, [2.0, 1.0]), (6, [])]
    df, q = frame(spark, rows).repartition(4), frame(spark, asked, "query_id long, q array<float>")
    want = plain(rows, asked, 7)
    assert rows_of(vector.top_k_batch(df, "id", "v", q, "query_id", "q", 7, digits=6)) == want
    one = [(1, r.id, round(r.score, 6), r["rank"]) for r in vector.top_k(df, "id", "v", asked[0][1], 7).collect()]
    assert one == [w for w in want if w[0] == 1]
    assert vector.top_k_batch(df, "id", "v", q.limit(0), "query_id", "q", 7).count() == 0
    assert vector.top_k_batch(df.limit(0), "id", "v", q, "query_id", "q", 7).count() == 0


def test_best_of_keeps_ties_in_order():
    rng = np.random.default_rng(2)
    for k in (1, 3, 10, 50):
        s, keys = rng.integers(0, 4, size=(6, 20)).astype(float), rng.permutation(20)
        want = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :k]
        assert (vector.best_of(s, keys, k) == want).all()


@pytest.mark.parametrize("spread, most", [(0.01, 0.3), (1.0, 1.0)])
def test_cells_give_the_rows_of_a_full_scan(spark, tmp_path, spread, most):
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(20, 3)) * 4
    rows = [(i, [float(x) for x in heads[i % 20] + spread * rng.normal(size=3)]) for i in range(1_500)]
    rows += [(2_000 + i, rows[3][1]) for i in range(700)] + ODD  # a third of all vectors are one
    asked = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(30)] + [(100, rows[3][1]), (101, [0.0, 0.0, 0.0]), (102, [NAN, 0.0, 0.0]), (103, None), (104, [1.0])]
    index = PivotIndex(spark, str(tmp_path / "p"), "id")
    index.build(frame(spark, rows).repartition(5), "v", 3, pivots=24)
    got = rows_of(index.search(frame(spark, asked, "query_id long, q array<float>"), "query_id", "q", 8, digits=6))
    assert got == plain([r for r in rows if r[1] is not None and len(r[1]) == 3], asked[:32], 8)
    assert index.reads["all"] == 2_200 * 32 and index.reads["compared"] <= most * index.reads["all"]


def test_cells_of_nothing(spark, tmp_path):
    index = PivotIndex(spark, str(tmp_path / "p"), "id")
    index.build(frame(spark, ODD), "v", 3)
    assert index.search(frame(spark, [(1, [1.0, 0.0, 0.0])], "query_id long, q array<float>"), "query_id", "q", 3).count() == 0
    index.build(frame(spark, []), "v", 3)
    assert index.search(frame(spark, [], "query_id long, q array<float>"), "query_id", "q", 3).count() == 0
