import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import chaining, components, decontam, linededup, simhash
from tarn.llm.oracles import ORACLES
from tarn.llm.queries import queries
from tests.conftest import SF
from tests.oracle import connect, same_rows


def test_oracles(spark):
    con = connect(SF)
    for name, sql in ORACLES.items():
        same_rows(spark, con, queries()[name], sql, SF)


def brute_fingerprint(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, bits=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark):
    rows = queries()["op9_simhash"](spark, SF).collect()
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [brute_fingerprint(t) for _, t in docs]
    roots, low = brute_components(prints), {}
    for (i, _), r in zip(docs, roots):
        low[r] = min(low.get(r, i), i)
    want = {i: (f"{p:016x}", low[r]) for (i, _), p, r in zip(docs, prints, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want and len(rows) == len(docs)


def test_fold_of_many_blocks():
    r = np.random.default_rng(1)
    lists = [r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 254, 255, 256, 1000, 2)]
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h)) for h in lists]
    assert simhash.fold(lists).tolist() == want


def test_trees_find_every_link():
    """Uniform fingerprints, dense clusters, and clusters that differ in one half alone: components equal brute force."""
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(300)]
    base += [base[i % 40] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for i in range(300)]
    base += [base[0] & ~0xFFFFFFFF | r.getrandbits(32) for _ in range(150)]
    base += [base[1] ^ sum(1 << r.randrange(64) for _ in range(2)) & 0xFFFFFFFFFFFFFFFF for _ in range(150)]
    x = np.unique(np.array(base, dtype=np.uint64))
    old, simhash.LEAF = simhash.LEAF, 256
    try:
        counts = [np.bincount((x >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16) for i in range(4)]
        dealer = simhash.Dealer(counts, 8)
        dealer.fit_below(x)
        assert dealer.below
        shard, rows, home = dealer.shards(x)
        assert np.bincount(rows[home]).tolist() == [4] * len(x)
        pairs = []
        for s in np.unique(shard):
            v, h = x[rows[shard == s]], home[shard == s]
            pairs.append(simhash.search(v[h], v[~h], simhash.BLOCKS[(s >> 32) % 4]))
    finally:
        simhash.LEAF = old
    a, b = (np.searchsorted(x, np.concatenate([p[i] for p in pairs])) for i in (0, 1))
    assert simhash.join_labels(len(x), a, b).tolist() == [min(i for i, q in enumerate(roots) if q == r) for roots in [brute_components([int(v) for v in x])] for r in roots]


def test_shards_of_ten_million():
    """Four copies of each fingerprint and no shard far over its target, with one hot block value too."""
    x = np.random.default_rng(12).integers(0, 1 << 63, 10_000_000, dtype=np.uint64) * np.uint64(2)
    x[:400_000] = x[:400_000] >> np.uint64(16) << np.uint64(16) | np.uint64(77)
    dealer = simhash.Dealer([np.bincount((x >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16) for i in range(4)])
    dealer.fit_below(x[::40])
    shard, rows, home = dealer.shards(x)
    assert home.sum() == 4 * len(x) and np.unique(shard[home], return_counts=True)[1].max() <= 4 * simhash.SHARD
    # beside the hot value all have four copies, and those of the hot one are bounded by its few levels
    assert len(rows) - 4 * len(x) < 10 * 400_000 and (np.bincount(rows)[400_000:] > 4).mean() < 1e-4


def test_components_of_long_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3), (7, 8)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_line_spread_near_the_threshold(spark):
    """Lines on 8 to 300 sites: what the sketch cannot decide is counted exactly."""
    rows = [(s * 1000 + n, f"on {n}\nown {s} {n}", f"site{s}") for n in (8, 9, 10, 11, 60, 99, 100, 101, 300) for s in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least, lg_k in ((10, 12), (100, 5)):
        got = linededup.remove_boilerplate(df, min_sites=least, lg_k=lg_k).where("_removed > 0").groupBy((F.col("doc_id") % 1000).alias("n")).agg(F.count("*").alias("c")).collect()
        assert {r.n: r.c for r in got} == {n: n - 1 for n in (8, 9, 10, 11, 60, 99, 100, 101, 300) if n >= least}


def test_removed_lines_keep_their_first_copy(spark):
    rows = [(i, f"head {i}\nshared\n\nshared\ntail", f"s{i}") for i in range(12)]
    got = {r.doc_id: r for r in linededup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]._kept_text == "head 0\nshared\n\ntail" and got[3]._kept_text == "head 3\n" and got[3]._removed == 3 and got[3]._lines == 5


def test_contained_items(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((5, 6, 12, 30, 45, 90, 300, 4, 1))]
    docs = []
    for i, t in items:
        w = t.split()
        edited = w.copy()
        if len(w) > 40:
            edited[len(w) // 2] = "other"
        filler = [word() for _ in range(4000)]
        for j, own in enumerate((w, edited, w[: len(w) * 2 // 3])):
            docs.append((10 * i + j, " ".join(filler[:1500] + own + filler[1500:])))
    docs += [(500, None), (501, ""), (502, "a b"), (503, items[3][1].upper() + "\t\n" + items[4][1]), (503, items[3][1].upper() + "\t\n" + items[4][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    want = brute_contained(docs, items)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()} == want and (503, 3) in want and (50, 5) in want
    assert (70, 7) in want and (80, 8) in want
    kept = {r.doc_id for r in decontam.without_contaminated(d, b).collect()}
    assert kept == {x for x, _ in docs} - {x for x, _ in want}


def test_short_items_against_sql(spark, tmp_path):
    """Items of one to four words follow the same rule as all others: reported and removed, as SQL has it."""
    import duckdb

    r = random.Random(4)
    docs = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.randrange(40)))) for i in range(60)] + [(60, "a\tB\n c"), (61, None), (61, "j i h g"), (61, "j i h g")]
    items = [(i, " ".join(r.choice("ABcdefghij") for _ in range(i % 5 + 1 + i // 15))) for i in range(30)] + [(30, ""), (31, None), (0, "a b")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    same_rows(spark, con, queries()["op7_decontamination"], ORACLES["op7_decontamination"], str(tmp_path))
    d, b = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    bad = {x.doc_id for x in decontam.contaminated(d, b).collect()}
    assert {x.doc_id for x in decontam.without_contaminated(d, b).where("doc_id < 61").collect()} == set(range(61)) - bad


def brute_contained(docs, items):
    def grams(text, n):
        w = (text or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    out = set()
    for i, q in items:
        n = min(5, len((q or "").split()))
        own = grams(q, n)
        out |= {(x, i) for x, t in docs if own and len(own & grams(t, n)) >= 0.8 * len(own)}
    return out


def test_repetitive_scattered_and_short_items(spark):
    """Items with few distinct shingles, items spread over long documents in pieces, items near the threshold: no pair is lost."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items, docs = [], []
    for n, cycle in ((600, 6), (300, 12), (1000, 8), (40, 3), (60, 60), (200, 200), (12, 12), (3, 3), (2, 2)):
        for _ in range(12):
            own = [word() for _ in range(cycle)]
            own = [own[i % cycle] for i in range(n)]
            i = len(items)
            items.append((i, " ".join(own)))
            filler = [word() for _ in range(3000)]
            cut = sorted(r.sample(range(1, n), min(3, n - 1)))
            pieces = [own[a:b] for a, b in zip([0, *cut], [*cut, n])]
            docs += [(10 * i, " ".join(filler[:900] + own + filler[900:])), (10 * i + 1, " ".join(filler[:500] + sum((p + filler[k * 600 : k * 600 + 500] for k, p in enumerate(pieces)), []))),
                     (10 * i + 2, " ".join(filler[:70] + own[: n * 5 // 6] + filler[70:99])), (10 * i + 3, " ".join(own[:cycle + 4]))]
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_contained(docs, items)
    assert got == want and len(want) > 200


def test_shared_passages(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    passage, other = text(80), text(70)
    fuzzy = passage[:40] + ["new", "words"] + passage[42:]
    moved = text(30) + other + text(20) + passage + text(10)
    docs = {1: text(50) + passage + text(60), 2: text(10) + fuzzy + text(20), 3: moved, 4: text(200), 5: other + text(40), 6: text(100) + passage[:30]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()] + [(7, None), (8, ""), (9, "a b"), (10, " ".join(docs[4])), (4, " ".join(docs[4]))], "doc_id long, text string")
    rows = chaining.shared_passages(df).collect()
    pairs = {frozenset((x.doc_id, x.other_id)) for x in rows}
    linked = {i for p in pairs for i in p}
    assert {1, 2, 3, 5, 4, 10} == linked and frozenset((3, 5)) in pairs and frozenset((4, 10)) in pairs
    assert frozenset((1, 2)) in pairs or frozenset((2, 3)) in pairs
    for x in rows:
        assert x.similarity >= 0.8 and x.passage_end - x.passage_start >= 50 and x.end - x.start >= 20
    best = max((x for x in rows if {x.doc_id, x.other_id} == {3, 5}), key=lambda x: x.n_equal)
    assert best.n_equal >= 65


def test_chain_scores_against_brute_force():
    r = random.Random(4)
    for _ in range(60):
        segs = np.array(sorted((r.randrange(200), r.randrange(200), r.randrange(5, 30)) for _ in range(r.randint(1, 12))))

        def brute():
            best = [0.0] * len(segs)
            for i, (x, y, n) in enumerate(segs.tolist()):
                gains = [0.0]
                for j in range(len(segs)):
                    u, v, m = segs[j].tolist()
                    reach = max(m - chaining.K + 1, 1)
                    if j < i and u + reach <= x and v + reach <= y:
                        gains.append(best[j] - chaining.GAP_COST * ((x - u - reach) + (y - v - reach)))
                best[i] = n + max(gains)
            return max(best)

        def score(chain):
            total = 0.0
            for k, (x, y, n) in enumerate(chain.tolist()):
                total += n
                if k:
                    u, v, m = chain[k - 1].tolist()
                    reach = max(m - chaining.K + 1, 1)
                    total -= chaining.GAP_COST * ((x - u - reach) + (y - v - reach))
            return total

        got = chaining.chains(segs)
        assert abs(score(got[0]) - brute()) < 1e-9 and sum(len(c) for c in got) == len(segs)


def test_common():
    assert chaining.common(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 4])) == 2 and chaining.common(np.array([]), np.array([1])) == 0


def test_two_passages_of_one_pair(spark):
    """Exact passages with other words between them are found at any gap, on one diagonal or not."""
    r = random.Random(21)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    docs, places = [], {}
    for k, (n, gap, more) in enumerate([(60, 10, 0), (60, 35, 0), (60, 50, 3), (60, 75, 0), (60, 100, 9), (200, 150, 0), (200, 300, 5)]):
        one, two = text(n), text(n)
        for j in (0, 1):
            docs.append((2 * k + j, " ".join(text(30) + one + text(gap + j * more) + two + text(30))))
            places[2 * k + j] = set(range(30, 30 + n)) | set(range(30 + n + gap + j * more, 30 + 2 * n + gap + j * more))
    rows = chaining.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for k in range(len(docs) // 2):
        own = [x for x in rows if x.doc_id // 2 == k]
        assert own and all(x.other_id // 2 == k and x.similarity >= 0.8 for x in own)
        assert places[own[0].doc_id] <= {i for x in own for i in range(x.start, x.end)}
        assert places[own[0].other_id] <= {i for x in own for i in range(x.other_start, x.other_end)}


def test_windows_against_brute_force():
    r = random.Random(22)
    for _ in range(200):
        x = y = 0
        found = []
        for _ in range(r.randint(1, 12)):
            n = r.randint(1, 40)
            found.append((x, y, n, 0))
            x, y = x + n + r.randint(1, 25), y + n + r.randint(0, 25)
        want = set()
        for i in range(len(found)):
            for j in range(i, len(found)):
                u, v = found[i][:2]
                dx, dy = found[j][0] + found[j][2] - u, found[j][1] + found[j][2] - v
                if sum(f[2] for f in found[i : j + 1]) >= 0.8 * max(dx, dy) - 1e-6 and dx >= chaining.MIN_CHAIN:
                    want |= set(range(u, u + dx))
        got = chaining.windows(np.array(found))
        assert {k for g in got for k in range(g[0], g[1])} == want
        assert all(g[4] >= 0.8 * max(g[1] - g[0], g[3] - g[2]) - 1e-6 for g in got)


def test_passages_that_are_quoted_in_part_before(spark):
    """Two documents share a passage; others hold parts of it, whatever the order of the documents' hashes."""
    r = random.Random(23)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    docs = []
    for k in range(24):
        p = text(60)
        parts = [p[:45]] if k % 3 == 0 else [p[i : i + 17] for i in (0, 15, 30, 43)] if k % 3 == 1 else [p[:40], p[20:], p[:38], p[22:]]
        docs += [(100 * k + j, " ".join(text(40) + own + text(40))) for j, own in enumerate([p, p, *parts])]
    rows = chaining.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for k in range(24):
        whole = [x for x in rows if {x.doc_id, x.other_id} == {100 * k, 100 * k + 1}]
        assert any(x.passage_start <= 40 and x.passage_end >= 100 and x.n_equal >= 50 for x in whole), k


def test_links_do_not_depend_on_batches(spark):
    """Links go to the two documents before, wherever batches, partitions, buckets and ranges are cut; the texts are alike around their seeds, so the documents' order counts."""
    rows = [" ".join(f"p{j}" for j in range(12)) + f" own{i}" for i in range(9)]
    df = spark.createDataFrame([(i * 2**59 - 2**62, t) for i, t in enumerate(rows)], "doc long, text string")
    want = {(i, i - k) for i in range(9) for k in (1, 2) if i >= k}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    hot = chaining.HOT_SAMPLE, chaining.HOT_SHARE
    try:
        for n, parts, buckets, ranges in (("1", 1, 1, 1), ("3", 1, 5, 1), ("1000", 4, 2, 1), ("1000", 3, 2, 7), ("2", 1, 1, 40)):
            chaining.HOT_SAMPLE, chaining.HOT_SHARE = 1, 20
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = {(a.doc // 2**59 + 8, a.other // 2**59 + 8) for a in chaining.anchors(df.repartition(parts), "text", buckets, ranges).collect()}
            assert got == want, (n, parts, buckets, ranges)
    finally:
        chaining.HOT_SAMPLE, chaining.HOT_SHARE = hot
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_packed_seeds():
    r = np.random.default_rng(5)
    for top in (100, 70_000):
        counts = r.integers(1, 6, 9)
        seed, at = r.integers(0, 1 << 40, counts.sum(), dtype=np.uint64), r.integers(-top, top, counts.sum())
        docs = r.integers(-(1 << 62), 1 << 62, 9)
        near = r.integers(0, 256, counts.sum())
        got = chaining.unpack(chaining.pack(docs, counts, seed, at, near))
        assert all(np.array_equal(a, b) for a, b in zip(got, (seed, np.repeat(docs, counts), at, near), strict=True))


def test_what_stands_around():
    """The least pair of words of a window, as a plain loop finds it."""
    r = np.random.default_rng(6)
    for n in (5, 6, 40, 41, 43, 300):
        words = r.integers(0, 1 << 63, n, dtype=np.uint64)
        pairs = (chaining.rolled(words, 2) >> np.uint64(32)).astype(np.uint32)
        want = [min(pairs[max(0, i - chaining.AROUND) : i + chaining.AROUND + 1], default=~np.uint32(0)) for i in range(n)]
        assert (chaining.around(words) == (np.array(want, dtype=np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(24))).all()


def quoted(r, quotes, rate=0.12, pairs=30, words=60, piece=14):
    """Documents: pairs that share a fuzzy passage, and for each of them others that quote pieces of it."""
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    docs = []
    for k in range(pairs):
        own = text(words)
        changed = set(r.sample(range(words), round(rate * words)))
        other = [w[::-1] + "x" if i in changed else w for i, w in enumerate(own)]
        pieces = [own[i : i + piece] for i in (r.randrange(words - piece) for _ in range(quotes))]
        docs += [(1_000 * k + j, " ".join(text(r.randint(20, 60)) + p + text(r.randint(20, 60)))) for j, p in enumerate((own, other, *pieces))]
    return docs


@pytest.mark.parametrize("quotes", [0, 6, 12, 50])
def test_fuzzy_passages_that_others_quote(spark, quotes):
    """A pair of documents is found although others hold pieces of its passage; with fifty of them to a passage nine in ten are asked for."""
    rows = chaining.shared_passages(spark.createDataFrame(quoted(random.Random(31), quotes), "doc_id long, text string")).collect()
    got = {x.doc_id // 1_000 for x in rows if {x.doc_id % 1_000, x.other_id % 1_000} == {0, 1}}
    assert len(got) >= (29 if quotes <= 12 else 28)


def test_packed_anchors():
    r = np.random.default_rng(7)
    for top in (100, 70_000):
        doc, other = np.repeat([-5, 3, 3, 9], [2, 1, 4, 1]), np.repeat([1, 2, 4, 4], [2, 1, 4, 1])
        x, y = (r.integers(0, top, 8) for _ in range(2))
        assert all(np.array_equal(a, b) for a, b in zip(chaining.unpack_anchors(chaining.pack_anchors(doc, other, x, y)), (doc, other, x, y)))


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row]
        prev = row[1:]
        out = [0]
        for j, y in enumerate(b):
            out.append(prev[j] + 1 if x == y else max(out[j], prev[j + 1]))
        row = out
    return row[-1]


def test_common_against_brute_force():
    r = np.random.default_rng(6)
    for _ in range(60):
        a, b = (r.integers(0, 6, r.integers(0, 90)) for _ in range(2))
        assert chaining.common(a, b) == brute_lcs(a.tolist(), b.tolist())


def test_long_gaps_and_long_ends_count():
    """A gap of 170 words with every fourth changed, and a match that goes on far beyond its seeds."""
    a = np.arange(370)
    b = a.copy()
    b[100:270:4] = -1
    segs = np.array([[0, 0, 100], [270, 270, 100]])
    found, more = chaining.measure_chain(a, b, segs, (0, 370), (0, 370), 64, False, False)
    assert not more and found[0][4] == 370 - 43 and found[0][:2] == (0, 370)
    assert chaining.measure_chain(a[200:], a[200:], np.array([[0, 0, 20]]), (0, 20), (0, 20), 64, True, True)[1]


def test_passages_against_brute_force(spark):
    """Random corpora of fuzzy passages: what an exhaustive alignment finds is found, whatever the partitions."""
    r = random.Random(25)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    docs, truth = [], []
    for k in range(150):
        own = text(r.choice((60, 75, 100, 200)))
        other, rate = [], r.choice((0.0, 0.05, 0.1, 0.15))
        for w in own:
            u = r.random()
            other += [w] if u >= rate else [] if u < rate / 4 else [w, "new"] if u < rate / 2 else [w[::-1] + "x"]
        truth.append(brute_lcs(own, other) / max(len(own), len(other)))
        docs += [(2 * k + j, " ".join(text(r.randint(0, 60)) + p + text(r.randint(0, 60)))) for j, p in enumerate((own, other))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    results = [{tuple(x) for x in chaining.shared_passages(df.repartition(n)).collect()} for n in (1, 4, 16)]
    assert results[0] == results[1] == results[2]
    want = {k for k, s in enumerate(truth) if s >= 0.82}
    got = {x[0] // 2 for x in results[0]}
    assert len(want) > 100 and len(want & got) >= 0.97 * len(want) and all(x[0] // 2 == x[1] // 2 for x in results[0])


def test_fuzzy_passages_with_short_runs(spark):
    """Words substituted at a fixed step, which leaves runs of 5 to 9 equal words: every passage is found, none by luck."""
    r = random.Random(24)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    docs = []
    for k in range(100):
        own, step = text((55, 60, 80, 120)[k % 4]), (6, 7, 8, 10)[k // 4 % 4]
        other = [w if i % step != step - 1 else w[::-1] + "x" for i, w in enumerate(own)]
        docs += [(2 * k + j, " ".join(text(30) + p + text(30))) for j, p in enumerate((own, other))]
    rows = chaining.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id // 2 for x in rows} == set(range(100)) and all(x.doc_id // 2 == x.other_id // 2 for x in rows)
