"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the power of two of their number of distinct shingles. An item's sketch is its bottom-k MinHash, its
k shingles that come first in a fixed random order, in which shingles that many items share come last; a document is probed with all its shingles.
An item of n shingles may miss up to ``slack`` of them at ``MIN_CONTAINMENT``, so k is the slack and a number of matches that grows with
the partition: a document that holds the item has at least so many shingles of the sketch, wherever they
stand in it. The search therefore loses no pair, and items that repeat themselves or lie scattered in a document are like any other.
The sketches of all items fill a Bloom filter of bounded size; only documents with a hit
go on, and join the items' sketches in a shuffle. Every candidate is then held
against whole texts: shingles as strings, counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import blobs, map_text, materialize, small_batches, unique_names

WIDTH, MIN_CONTAINMENT = 5, 0.8
#: Matches that are asked for beyond the slack: one for each so many shingles of the partition's smallest items.
SHARE = 8
#: Bits of the Bloom filter: 16 for each sketch entry, between these powers of two.
BLOOM_BITS = (22, 29)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(blob: bytes | None) -> list[bytes]:
    """Words between ASCII white space, lower-cased in A-Z."""
    return blob.lower().split() if blob else []


def _flat(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash for each word of all texts in order, number of words of each text)."""
    digest = xxhash.xxh64_intdigest
    lists = [words(t) for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter((digest(w) for x in lists for w in x), np.uint64, int(sizes.sum())), sizes


def shingles(flat: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``width`` words of each text, in order."""
    if len(flat) < width:
        return flat[:0], np.zeros(0, dtype=np.int64)
    h = np.full(len(flat) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = h * STEP + flat[i : len(flat) - width + 1 + i]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    own = doc[: len(h)] == doc[width - 1 :]
    return _mix(h[own]), doc[: len(h)][own]


def item_shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, distinct shingle, width): texts of under WIDTH words are one shingle, the whole sequence."""
    flat, sizes = _flat(texts)
    who, hashes, widths = [], [], []
    for width in range(1, WIDTH + 1):
        h, doc = shingles(flat, sizes, width)
        own = sizes[doc] == width if width < WIDTH else np.full(len(doc), True)
        pairs = np.unique(np.stack([doc[own].astype(np.uint64), h[own]]), axis=1)
        who.append(pairs[0].astype(np.int64))
        hashes.append(pairs[1])
        widths.append(np.full(pairs.shape[1], width))
    return np.concatenate(who), np.concatenate(hashes), np.concatenate(widths)


def level(n: int) -> int:
    """Size partition of items with n distinct shingles: the power of two below."""
    return max(n, 1).bit_length() - 1


def sketch_size(n: int, least: float) -> tuple[int, int]:
    """(entries of the sketch, matches that a document with ``least`` of the n shingles has at least)."""
    slack = int(np.floor((1 - least) * n + 1e-6))
    k = min(n, slack + max(1, (1 << level(n)) // SHARE))
    return k, max(k - slack, 1)


def _bits(key: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - log)
    return (key >> shift).astype(np.int64), ((key * STEP) >> shift).astype(np.int64)


def probe_keys(texts: list[bytes | None], widths: list[int], bloom: np.ndarray, log: int) -> list[np.ndarray]:
    """For each text its distinct shingles that the filter lets pass."""
    flat, sizes = _flat(texts)
    hits: list[list[np.ndarray]] = [[] for _ in texts]
    for width in widths:
        h, doc = shingles(flat, sizes, width)
        one, two = _bits(h, log)
        maybe = np.flatnonzero(bloom[one >> 3] >> (one & 7) & 1)
        two = two[maybe]
        maybe = maybe[(bloom[two >> 3] >> (two & 7) & 1).astype(bool)]
        # texts come in order, so a text's hits are together
        cuts = np.flatnonzero(np.diff(doc[maybe], prepend=-1, append=-1))
        for s, e in zip(cuts[:-1], cuts[1:]):
            hits[doc[maybe[s]]].append(h[maybe[s:e]])
    return [np.unique(np.concatenate(x)) if x else flat[:0] for x in hits]


def _grams(blob: bytes | None, width: int) -> set[tuple[bytes, ...]]:
    w = words(blob)
    return set(zip(*[w[i:] for i in range(width)])) if len(w) >= width else set()


def _bloom(keys: DataFrame, log: int) -> np.ndarray:
    """Filter over all keys: one bit array of bounded size from each of few tasks, merged one by one on the driver."""

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (log - 3), dtype=np.uint8)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy().view(np.uint64), log):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (log - 3), dtype=np.uint8)
    for row in keys.select("key").coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(row[0], dtype=np.uint8)
    return out


def sketches(tests: DataFrame, least: float) -> DataFrame:
    """(ih, key, width, need) of the items' sketches; ``tests`` has ih and item."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, hashes, widths = item_shingles(blobs(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(hashes.view(np.int64)), pa.array(widths.astype(np.int32))], names=["ih", "key", "width"])

    rows = materialize(tests.select("ih", "item").mapInArrow(split, "ih bigint, key bigint, width int"), "item-shingles")
    spread = rows.groupBy("key").agg(F.count("*").alias("shared"))

    def bottom(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items are sorted by shingle order and whole; the last one of a batch is carried over."""
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(rows[0], prepend=~rows[0, :1], append=~rows[0, -1:]))
            keep, need = [], []
            for s, e in zip(cuts[:-1], cuts[1:]):
                k, m = sketch_size(int(e - s), least)
                keep.append(np.arange(s, s + k))
                need.append(np.full(k, m))
            at = np.concatenate(keep)
            return pa.RecordBatch.from_arrays([pa.array(rows[0, at]), pa.array(rows[1, at]), pa.array(rows[2, at].astype(np.int32)), pa.array(np.concatenate(need))], names=["ih", "key", "width", "need"])

        for batch in batches:
            new = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            if not new.shape[1]:
                continue
            rows = np.concatenate([*held, new], axis=1)
            last = rows[0] == rows[0, -1]
            if not last.all():
                yield done(rows[:, ~last])
            held = [rows[:, last]]
        if held:
            yield done(held[0])

    ordered = rows.join(spread, "key").repartition("ih").sortWithinPartitions("ih", "shared", "key").select("ih", "key", "width")
    return ordered.mapInArrow(bottom, "ih bigint, key bigint, width int, need bigint")


def pairs_of(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = MIN_CONTAINMENT) -> DataFrame:
    """(doc_id, th, item_id, n_shared, n_item, item_words): verified pairs; th tells apart texts of one id."""
    spark = docs.sparkSession
    small_batches(spark)
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("item")).where("item is not null").distinct().withColumn("ih", F.xxhash64("item"))
    tests = materialize(tests, "items")
    keys = materialize(sketches(tests.select("ih", "item").dropDuplicates(["ih"]), least), "item-keys")
    doc_type, id_type = docs.schema[doc_id].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()
    widths = sorted(r[0] for r in keys.select("width").distinct().collect())  # WIDTH at most
    fields = f"doc_id {doc_type}, th bigint, item_id {id_type}, n_shared bigint, n_item bigint, item_words bigint"
    if not widths:
        return spark.createDataFrame([], fields)
    log = min(BLOOM_BITS[1], max(BLOOM_BITS[0], int(np.ceil(np.log2(16 * keys.count())))))
    bloom = spark.sparkContext.broadcast(_bloom(keys, log))

    def probe(part: pa.RecordBatch) -> list:
        found = probe_keys(blobs(part.column(part.num_columns - 1)), widths, bloom.value, log)
        return [pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), part.column(part.num_columns - 1)]

    hits = map_text(docs, {"doc_id": F.col(doc_id), "th": F.xxhash64(F.col(text).cast("string"))}, text, "keys array<bigint>, body string", probe)
    hits = materialize(hits.where(F.size("keys") > 0).dropDuplicates(["doc_id", "th"]), "hits")
    met = hits.select("doc_id", "th", F.explode("keys").alias("key")).join(keys.select("key", "ih", "need"), "key")
    pairs = met.groupBy("doc_id", "th", "ih").agg(F.count("*").alias("n"), F.first("need").alias("need")).where(F.col("n") >= F.col("need")).select("doc_id", "th", "ih")
    named = pairs.join(tests, "ih")
    both = named.select("doc_id", "th", "item_id", "item").join(
        hits.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "body"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))
    )

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams = None, {}
        for batch in batches:
            shared, size, length = [], [], []
            for body, item in zip(blobs(batch.column(3)), blobs(batch.column(2))):
                if body != last:
                    last, grams = body, {}
                n = len(words(item))
                width = min(n, WIDTH)
                if width not in grams:
                    grams[width] = _grams(body, width)
                wanted = _grams(item, width)
                size.append(len(wanted))
                shared.append(len(wanted & grams[width]))
                length.append(n)
            counts = [pa.array(v, pa.int64()) for v in (shared, size, length)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(1), *counts], names=["doc_id", "th", "item_id", "n_shared", "n_item", "item_words"])

    out = both.select("doc_id", "item_id", "item", "body", F.col("_th").alias("th")).mapInArrow(verify, fields)
    return out.where(F.col("n_shared") >= least * F.col("n_item"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **named) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of pairs where a document holds 0.8 (``least``) of an item's distinct shingles or more.

    Shingles are ``WIDTH`` words; an item of fewer words is one shingle, its whole sequence. Null, empty and wordless items and documents match
    nothing; long texts are read whole. Repeated rows of a document or an item give one pair. Null ids are kept as they are. The search has no ties.
    """
    out = pairs_of(docs, items, doc_id, text, **named).drop("th", "item_words")
    return out.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6)).distinct()


def without_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **named) -> DataFrame:
    """``docs`` less the documents that ``contaminated`` reports, whatever the items' length; other texts of the same id stay.

    An item of one or two common words therefore removes all documents that say them: such items should not be in a benchmark.
    """
    one, two = unique_names(docs, "id", "th")
    bad = pairs_of(docs, items, doc_id, text, **named).select(F.col("doc_id").alias(one), F.col("th").alias(two)).distinct()
    mine = F.col(f"`{doc_id}`").eqNullSafe(F.col(one)) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(two))
    return docs.join(bad, mine, "left_anti")
