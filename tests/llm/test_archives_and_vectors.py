"""WARC round trips against a plain parser, whitening against numpy, dual-tree clusters against a plain scan."""

import glob
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import dualtree, queries, warc, whitening
from tests.conftest import SF

MARK = warc.SEPARATOR
PAYLOADS = ["", None, "short", "x" * 99, "y" * 100, "y" * 100, "ü" * 150, "WARC/1.0\r\n" * 40, f"a{MARK}b" * 30, "\r\nWARC/1.1\r\n" * 20, "\r\n" * 200, "\r\n\r\n" + "z" * 120 + "\r\n\r\n", "日本語" * 500, "😀\r\n" * 300, "Content-Length: 3\r\n\r\nabc" * 20]


def plain_records(path):
    """(headers, block) of every record by the lengths that they name, as a reader of one stream does."""
    for f in sorted(glob.glob(f"{path}/*.gz")):
        data, at = gzip.open(f).read(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = data[at:end].decode().split("\r\n")
            assert head[0] == "WARC/1.1"
            fields = dict(h.split(": ", 1) for h in head[1:])
            size = int(fields["Content-Length"])
            yield fields, data[end + 4 : end + 4 + size]
            at = end + 4 + size
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)


def brute_records(rows):
    first = {}
    for key, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100 and key is not None:
            first[b] = min(first.get(b, key), key)
    out = []
    for key, _, html in rows:
        b = (html or "").encode()
        to = first.get(b, key)
        out.append((key, len(b), hashlib.sha256(b).hexdigest(), "response" if to == key else "revisit", None if to == key else to, True))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [7, 64, 1_000, 64 << 10])
def test_round_trip(spark, size):
    rows = [(i * 7 % 31, f"http://a.example/{i}?q=ü&r=\r\n1", p) for i, p in enumerate(PAYLOADS + PAYLOADS[4:])] + [(None, None, "n" * 300), (None, None, "y" * 100), (3, None, "y" * 100), (3, None, "y" * 100), (500, None, "日本語" * 500), (500, None, "日本語" * 500)]
    rows += [(0, None, "q" * 5_000), (0, None, "q" * 5_000)]
    got = warc.round_trip(pages_of(spark, rows), size=size)
    assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")) for r in got.collect()], key=repr) == brute_records(rows)
    assert size > 1_000 or got.agg(F.max("n_chunks")).first()[0] > 4


def test_archives_are_whole_records(spark, tmp_path):
    rows = [(i, f"http://a.example/{i}", p) for i, p in enumerate(PAYLOADS)]
    warc.write_archives(pages_of(spark, rows), str(tmp_path / "w"), size=50)
    found, ids = {}, []
    for fields, block in plain_records(tmp_path / "w"):
        ids.append(fields["WARC-Record-ID"])
        assert MARK.encode() not in b"\r\n\r\n" + block
        origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
        found.setdefault(origin, {})[int(fields.get("WARC-Segment-Number", 1))] = (fields, block)
    assert len(ids) == len(set(ids)) and len(found) == len(rows)
    for origin, parts in found.items():
        whole = b"".join(parts[i][1] for i in range(1, len(parts) + 1))
        fields = parts[1][0]
        payload = whole.split(b"\r\n\r\n", 1)[1]
        key = int(re.search(r"k(\d+):", origin)[1])
        if fields["WARC-Type"] == "response":
            assert payload.decode() == (PAYLOADS[key] or "") and fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
            if len(parts) > 1:
                assert int(parts[len(parts)][0]["WARC-Segment-Total-Length"]) == len(whole)
                assert parts[1][0]["Running-Payload-Digest"] == "sha256:" + hashlib.sha256(parts[1][1].split(b"\r\n\r\n", 1)[1]).hexdigest()
        else:
            assert payload == b"" and fields["WARC-Refers-To"] in found


def test_random_cuts():
    rng = random.Random(5)
    for _ in range(300):
        body = "".join(rng.choice(["WARC/1.", "\r\n", "\r", "\n", "é", "日", "x", "WARC"]) for _ in range(rng.randrange(60))).encode()
        ends = warc.cuts(body, rng.randrange(4, 20))
        assert ends[-1] == len(body) and ends == sorted(set(ends)) or ends == [0]
        at = 0
        for e in ends:
            body[at:e].decode()
            assert MARK.encode() not in b"\r\n\r\n" + body[at:e]
            at = e


def test_damage_is_told(spark, tmp_path):
    warc.write_archives(pages_of(spark, [(1, "u", "w" * 1_000), (2, "u", "v" * 40)], 1), str(tmp_path / "w"), size=100)
    [f] = [f for f in glob.glob(str(tmp_path / "w/*.gz")) if gzip.open(f).read()]
    data = gzip.open(f).read().replace(b"w" * 100, b"w" * 99 + b"!", 1).replace(b"v" * 40, b"v" * 39 + b"!")
    with gzip.open(f, "wb") as out:
        out.write(data)
    for crc in glob.glob(str(tmp_path / "w/.*.crc")):
        open(crc, "wb").close()
        import os

        os.remove(crc)
    assert not warc.read_records(spark, str(tmp_path / "w")).where("intact").count()


def test_chunks_without_rows_and_with_clashing_names(spark):
    for c in ("record_id", "value", "digest", "key", "n", "salt", "first"):
        rows = pages_of(spark, [(1, "u", "a" * 200), (2, "u", "a" * 200)]).withColumn(c, F.lit("clash"))
        assert {(r.page_id, r.refers_to) for r in warc.round_trip(rows).collect()} == {(1, None), (2, 1)}
    assert warc.round_trip(pages_of(spark, [])).count() == 0
    text = spark.createDataFrame([("a b/ü:+%", "u", "t" * 200), ("b", None, "t" * 200), ("", None, "t" * 200)], "k string, u string, body string")
    assert {(r.k, r.refers_to) for r in warc.round_trip(text, "k", "u", "body").collect()} == {("", None), ("a b/ü:+%", ""), ("b", "")}


def integers_of(rows):
    return [(k, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for k, v in rows]


def vectors_of(spark, rows, parts=5):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)


def brute_whiten(rows, components=4):
    rows = integers_of(rows)
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = ((n * fit - s) / n).astype(float)
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for k, x in rows:
        d = (n * np.array(x, dtype=object) - s)
        out[k] = (int((d**2).sum()), (d / n).astype(float) @ axes[:, :components] / np.sqrt(np.maximum(values[:components], 1e-300)))
    return n, out, values / values.sum()


def check_whitening(rows, got, components=4):
    n, want, share = brute_whiten(rows, components)
    signs = {}
    assert len(got) == len(rows) * components
    for r in got:
        far, w = want[r.vec_id]
        assert (r.n, r.deviation) == (n, far) and abs(r.explained / share[r.component - 1] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
        if abs(w[r.component - 1]) > 1e-3:
            sign = signs.setdefault(r.component, np.sign(r.whitened * w[r.component - 1]))
            assert abs(r.whitened * sign - w[r.component - 1]) < 1e-6 * max(1, abs(w[r.component - 1]))


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(700, 12)) * np.linspace(3, 0.2, 12) + 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(1_000 + i, rows[7][1]) for i in range(300)]  # one vector is a third of all rows
    bad = [(2_000, None), (2_001, [float("nan")] * 12), (2_002, [1.0] * 11 + [float("inf")]), (2_003, [None] + [1.0] * 11), (2_004, []), (2_005, [1.0] * 5)]
    got = whitening.whiten(vectors_of(spark, rows + bad)).collect()
    check_whitening(rows, got)
    again = whitening.whiten(vectors_of(spark, rows + bad, 40)).collect()
    check_whitening(rows, again)


def test_whitening_query_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, queries.op12_whitening(spark, SF).collect())


def test_tree_of_factors(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-99, 99, size=(500, 6))
    df = spark.createDataFrame([([int(v) for v in row],) for row in x], "x array<long>").repartition(37)
    r = whitening.tsqr(df, "x", 6, lambda m: m.astype(float), fan=3)
    assert np.allclose(r.T @ r, x.T @ x, rtol=1e-12)
    assert whitening.exact_sums(df, "x") == (500, x.sum(axis=0).tolist())


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0 and whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(vectors_of(spark, [(1, [0.5, 1.0]), (None, [0.5, 1.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, 0.0)] * 4
    line = whitening.whiten(vectors_of(spark, [(i, [float(i), 2.0, float(-i)]) for i in range(5)]).withColumn("x", F.lit(1)).withColumn("component", F.lit(2))).collect()
    assert {r.component for r in line} == {1, 2, 3} and all((r.whitened is None) == (r.component > 1) and abs(r.explained - (r.component == 1)) < 1e-12 for r in line)
    big = whitening.whiten(vectors_of(spark, [(1, [1e12, 1.0]), (2, [-1e12, 5.0]), (3, [0.0, 0.0])])).collect()
    assert all(r.deviation is None or r.vec_id == 3 for r in big) and len(big) == 6


def brute_cluster(rows, k, rounds, width):
    kept = [(key, x) for key, x in integers_of([r for r in rows if r[1] is not None and len(r[1]) == width and all(c is not None and np.isfinite(c) for c in r[1])])]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    m = [list(x) for _, x in order[:k]]

    def near(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in m]
        return min(range(len(m)), key=lambda i: (d[i], i)), min(d)

    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(near(x)[0], []).append(x)
        for c, xs in own.items():
            m[c] = [sum(v) // len(xs) for v in zip(*xs)]
    found = [(key, *near(x)) for key, x in kept]
    total, by = sum(f[2] for f in found), {}
    for _, c, d in found:
        by[c] = by.get(c, 0) + d
    return sorted([(key, c, d, by[c], total, hashlib.sha256(",".join(map(str, m[c])).encode()).hexdigest()) for key, c, d in found], key=repr)


@pytest.mark.parametrize("spread, size", [(1.0, 4_096), (0.02, 100), (0.0, 64)])
def test_clusters_against_a_plain_scan(spark, monkeypatch, spread, size):
    """Loose, tight and equal vectors, small and large blocks; one vector is a third of all rows, and ties are many on a grid."""
    monkeypatch.setattr(dualtree, "BLOCK", size)
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(9, 6))
    rows = [(i, [float(c) for c in heads[i % 9] + spread * rng.normal(size=6)]) for i in range(400)]
    rows += [(1_000 + i, rows[5][1]) for i in range(250)] + [(2_000 + i, [float(c) / 64 for c in rng.integers(0, 3, 6)]) for i in range(100)]
    rows += [(None, rows[0][1]), (None, rows[1][1]), (7, rows[3][1]), (3_000, None), (3_001, [1.0]), (3_002, [float("nan")] * 6), (3_003, [None] * 6), (3_004, [])]
    df = vectors_of(spark, rows).withColumn("x", F.lit("clash")).withColumn("cluster", F.lit("clash")).withColumn("keys", F.lit(0))
    got = dualtree.cluster(df, dimensions=6, k=12, rounds=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_cluster(rows, 12, 4, 6)


def test_few_vectors(spark):
    assert dualtree.cluster(vectors_of(spark, [])).count() == 0
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 9.0])]
    assert sorted(map(tuple, dualtree.cluster(vectors_of(spark, rows), dimensions=2).collect()), key=repr) == brute_cluster(rows, 40, 5, 2)


def test_cover_tree():
    rng = np.random.default_rng(2)
    for x, leaf in ((rng.integers(-50, 50, size=(300, 4)), 8), (rng.integers(0, 3, size=(300, 2)), 1), (np.zeros((20, 3), dtype=np.int64), 1), (np.zeros((40, 3), dtype=np.int64), 8)):
        t = dualtree.cover_tree(x, leaf)
        assert sorted(t.order.tolist()) == list(range(len(x)))
        z = x[t.order]
        for i in range(len(t.center)):
            d = np.sqrt(((z[t.start[i] : t.end[i]] - z[t.center[i]]) ** 2).sum(axis=1))
            assert abs(d.max() - t.radius[i]) < 1e-9
            kids = range(t.child[i], t.child[i] + t.children[i])
            if kids:
                # nested, covering and apart
                assert sum(t.end[j] - t.start[j] for j in kids) == t.end[i] - t.start[i] and all(t.radius[j] <= t.radius[i] / 2 + 1e-9 for j in kids)
                heads = z[t.center[list(kids)]]
                assert (heads == z[t.center[i]]).all(axis=1).any()
                gaps = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(axis=2))[np.triu_indices(len(heads), 1)]
                assert (gaps > t.radius[i] / 2).all() or t.radius[i] == 0
            elif leaf == 1:
                assert t.end[i] - t.start[i] == 1


def test_pairs_are_pruned():
    """Tight groups are counted as whole nodes: far fewer distances than vectors times centroids."""
    rng = np.random.default_rng(4)
    heads = rng.integers(-20_000, 20_000, size=(40, 16))
    x = np.concatenate([h + rng.integers(-20, 20, size=(100, 16)) for h in heads])
    tree, means = dualtree.cover_tree(x), dualtree.cover_tree(heads, 1)
    whole, points, _, pairs = dualtree.assign(x[tree.order], tree, heads[means.order], means)
    assert pairs < 0.05 * len(x) * len(heads) and not len(points) and sum(len(n) for n, _ in whole) < 200
