"""SimHash near-duplicates, linked through vantage-point trees.

Two fingerprints within three bits agree in one of their four 16-bit blocks. So there are four trees, one for each block: a node
splits fingerprints by the Hamming distance of that block to a vantage point. Partners of a tree agree in its block, so by the
triangle inequality with radius zero both lie on the same side, and every fingerprint is in exactly one shard of each
tree, however many levels there are. Where a block no longer tells fingerprints apart the node uses all 64 bits with radius three, and a fingerprint
visits the other side, too, if a partner can be there. The upper levels are fitted on the numbers of fingerprints that have each
value of a block, 65,536 at most for each tree, and deal the fingerprints to shards; a fingerprint goes to its home shard and to
every shard that its radius overlaps. Each shard is searched by the same recursion and gives a spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import blobs, hex64, map_text, materialize, small_batches, unique_names
from tarn.llm.components import components

MAX_BITS = 3
#: Fingerprints that one shard should hold, and those on which the levels below a block's single value are fitted.
SHARD, SAMPLE = 8_192, 262_144
BLOCKS = tuple(np.uint64(0xFFFF << 16 * i) for i in range(4))
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
LANES = np.uint64(0x0101010101010101)
#: Comparisons at which a shard's recursion stops.
LEAF = 1 << 18


def shingle_hashes(blob: bytes | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a text, lower-cased in A-Z."""
    words = blob.lower().split() if blob else []
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    grams = zip(*[words[i:] for i in range(width)])
    return np.fromiter((digest(b" ".join(g), seed) for g in grams), np.uint64, len(words) - width + 1)


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array: a bit is set if over half of its hashes set it."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    # blocks of 255 rows at most, so that eight counters fit in the bytes of one word
    n_blocks = -(-sizes[full] // 255)
    first = np.cumsum(n_blocks) - n_blocks
    offset = np.cumsum(sizes[full]) - sizes[full]
    starts = np.repeat(offset, n_blocks) + 255 * (np.arange(n_blocks.sum()) - np.repeat(first, n_blocks))
    half = sizes[full][:, None]
    bits = np.zeros(len(full), dtype=np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(j)) & LANES, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for k in range(8):
            bits |= (2 * counts[:, k : k + 1] > half)[:, 0].astype(np.uint64) << np.uint64(8 * k + j)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, fp) of every row; th tells apart texts of one id, null and wordless texts have fingerprint 0."""

    def run(part: pa.RecordBatch) -> list:
        fp = fold([shingle_hashes(x) for x in blobs(part.column(part.num_columns - 1))])
        return [pa.array(fp.view(np.int64))]

    return map_text(docs, {"doc_id": F.col(doc_id), "th": F.xxhash64(F.col(text).cast("string"))}, text, "fp bigint", run, most=2 << 20)


# --- vantage-point trees --------------------------------------------------------------------


def _split(points: np.ndarray, block: np.uint64, weights: np.ndarray | None = None):
    """(mask, vantage, mu, radius) that splits the points well, or None if nothing tells them apart."""
    for mask, radius in ((block, 0), (ALL, MAX_BITS)):
        for vantage in (points[0], points[len(points) // 2]):
            near = np.cumsum(np.bincount(np.bitwise_count((points ^ vantage) & mask), weights, minlength=65))
            m = int(np.argmin(np.abs(near - near[-1] / 2)))
            if min(near[m], near[-1] - near[m]) * 8 >= near[-1]:
                return mask, vantage, m, radius
    return None


def _sides(x: np.ndarray, node) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home side (True: inside), and whether the radius reaches inside and outside."""
    mask, vantage, mu, radius = node
    d = np.bitwise_count((x ^ vantage) & mask).astype(np.int16)
    return d <= mu, d <= mu + radius, d > mu - radius


def grow(points: np.ndarray, weights: np.ndarray, block: np.uint64, shard: int = SHARD):
    """Upper levels of a tree over points of some weight each: nested (node, inside, outside); None is a shard."""
    node = _split(points, block, weights) if len(points) > 1 and weights.sum() > shard else None
    if node is None:
        return None
    home = _sides(points, node)[0]
    return node, grow(points[home], weights[home], block, shard), grow(points[~home], weights[~home], block, shard)


def deal(x: np.ndarray, tree, path: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes, whether the shard is their home) for every shard that is reached."""
    todo = [(tree, path, np.arange(len(x)), np.ones(len(x), dtype=bool))]
    while todo:
        tree, path, rows, home = todo.pop()
        if not len(rows):
            continue
        if tree is None:
            yield path, rows, home
            continue
        inside, reach_in, reach_out = _sides(x[rows], tree[0])
        todo.append((tree[1], 2 * path, rows[reach_in], (home & inside)[reach_in]))
        todo.append((tree[2], 2 * path + 1, rows[reach_out], (home & ~inside)[reach_out]))


class Dealer:
    """Shards of fingerprints: for each block a table from its value to a leaf, and trees below the leaves that hold too many.

    ``counts[i][v]`` is the number of fingerprints whose block i has the value v.
    """

    def __init__(self, counts: list[np.ndarray], shard: int = SHARD):
        self.shard, self.leaf, self.heavy, self.below = shard, [], [], {}
        values = np.arange(1 << 16, dtype=np.uint64)
        for i, block in enumerate(BLOCKS):
            own = np.flatnonzero(counts[i])
            leaf, size = np.zeros(1 << 16, dtype=np.int64), []
            if len(own):
                points = values[own] << np.uint64(16 * i)
                for n, (_, rows, _) in enumerate(deal(points, self._block_tree(points, counts[i][own].astype(float), block))):
                    leaf[own[rows]] = n
                    size.append(int(counts[i][own[rows]].sum()))
            self.leaf.append(leaf)
            self.heavy.append({n: w for n, w in enumerate(size) if w > 4 * shard})

    def _block_tree(self, points: np.ndarray, weights: np.ndarray, block: np.uint64):
        """As ``grow``, on the block alone: down to single values where these hold much."""
        if len(points) < 2 or weights.sum() <= self.shard:
            return None
        options = []
        for vantage in (points[np.argmax(weights)], points[0], points[len(points) // 2]):
            near = np.cumsum(np.bincount(np.bitwise_count((points ^ vantage) & block), weights, minlength=17))
            inner = np.where((near > 0) & (near < near[-1]), np.abs(near - near[-1] / 2), np.inf)
            options.append((float(inner.min()), int(np.argmin(inner)), vantage))
        _, mu, vantage = min(options, key=lambda o: o[0])
        node = (block, vantage, mu, 0)
        home = _sides(points, node)[0]
        return node, self._block_tree(points[home], weights[home], block), self._block_tree(points[~home], weights[~home], block)

    def leaves(self, x: np.ndarray, i: int) -> np.ndarray:
        return self.leaf[i][(x >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64)]

    def fit_below(self, sample: np.ndarray) -> None:
        """Trees over all bits for the leaves that hold too many, from a sample of their fingerprints."""
        for i, block in enumerate(BLOCKS):
            own = self.leaves(sample, i)
            for n, weight in self.heavy[i].items():
                points = sample[own == n]
                if len(points) >= 16:
                    self.below[i, n] = grow(points, np.full(len(points), weight / len(points)), block, max(3 * self.shard, 16 * weight / len(points)))

    def shards(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, index, whether it is home) of every shard that each fingerprint goes to."""
        out = []
        for i in range(len(BLOCKS)):
            leaf = self.leaves(x, i)
            base = (leaf * len(BLOCKS) + i) << 32
            deep = np.isin(leaf, [n for j, n in self.below if j == i])
            flat = np.flatnonzero(~deep)
            out.append((base[flat], flat, np.full(len(flat), True)))
            for n in np.unique(leaf[deep]).tolist():
                rows = np.flatnonzero(leaf == n)
                for path, own, home in deal(x[rows], self.below[i, n]):
                    out.append((base[rows[own]] + path, rows[own], home))
        return tuple(np.concatenate(c) for c in zip(*out))


def join_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def search(points: np.ndarray, visitors: np.ndarray, block: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Links of distance three at most between points and points or visitors, thinned to a spanning set."""
    x = np.concatenate([points, visitors])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def thin() -> None:
        nonlocal held
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = join_labels(len(used), back[: len(a)], back[len(a) :])
        moved = np.flatnonzero(label != np.arange(len(used)))
        found[:] = [(used[moved], used[label[moved]])]
        held = len(moved)

    todo = [(np.arange(len(points)), np.arange(len(points), len(x)))]
    while todo:
        own, away = todo.pop()
        if not len(own):
            continue
        everyone = np.concatenate([own, away])
        node = _split(x[own], block) if len(own) * len(everyone) > LEAF else None
        if node is None:
            step = max(1, LEAF // len(everyone))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                i, j = np.nonzero(np.bitwise_count(x[rows][:, None] ^ x[everyone][None, :]) <= MAX_BITS)
                a, b = rows[i], everyone[j]
                keep = a != b
                if keep.any():
                    found.append((a[keep], b[keep]))
                    held += int(keep.sum())
                    if held > 1 << 20:
                        thin()
            continue
        home, in_own, out_own = _sides(x[own], node)
        _, in_away, out_away = _sides(x[away], node)
        todo.append((own[home], np.concatenate([own[~home & in_own], away[in_away]])))
        todo.append((own[~home], np.concatenate([own[home & out_own], away[out_away]])))
    if not found:
        return x[:0], x[:0]
    thin()
    return x[found[0][0]], x[found[0][1]]


def links(prints: DataFrame) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: enough links of three bits at most to join what such links join."""
    spark = prints.sparkSession
    small_batches(spark)
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("value")) for i in range(len(BLOCKS))])).alias("v")
    table = prints.select(values).groupBy("v.block", "v.value").agg(F.count("*").alias("n")).toArrow()  # 4 x 65,536 rows at most
    block, value, n = (table[c].to_numpy() for c in ("block", "value", "n"))
    dealer = Dealer([np.bincount(value[block == i], n[block == i], minlength=1 << 16).astype(np.int64) for i in range(len(BLOCKS))])
    if heavy := sum(sum(h.values()) for h in dealer.heavy):
        few = prints.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, -(-heavy // SAMPLE)))) == 0)
        dealer.fit_below(few.select("fp").toArrow()["fp"].to_numpy().view(np.uint64))
    held = spark.sparkContext.broadcast(dealer)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            if len(x):
                shard, rows, home = held.value.shards(x)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(x[rows].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, so one shard at a time is held."""

        def done(shard, parts):
            fp, home = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            a, b = search(fp[home], fp[~home], BLOCKS[(shard >> 32) % len(BLOCKS)])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        now, parts = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            fp, home = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if shard[s] != now:
                    if parts:
                        yield done(now, parts)
                    now, parts = shard[s], []
                parts.append((fp[s:e].copy(), home[s:e].copy()))
        if parts:
            yield done(now, parts)

    dealt = prints.select("fp").mapInArrow(send, "shard bigint, fp bigint, home boolean")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(gather, "a bigint, b bigint")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, fp, root, component_id) of every row; root is the component's smallest fingerprint."""
    rows = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    roots = components(links(prints), "a", "b")
    joined = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(joined.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows
    each give a row; long texts are read whole. A bit set in exactly half of the hashes is 0. Null ids never name a component: its id is the smallest id that is not null, or
    null if there is none. Other columns are not read. No rows give no rows.
    """
    return grouped(docs, doc_id, text).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row for each component: that of the smallest id (null ids last), then of the smallest text hash.

    Texts are shuffled once; only those of rows that repeat both id and text are compared again.
    """
    own_id, own_th, n = unique_names(docs, "id", "th", "n")
    rows = grouped(docs, doc_id, text)
    times = rows.groupBy("root", "doc_id", "th").agg(F.count("*").alias("times"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "times")).alias("first")
    keep = times.groupBy("root").agg(best).select(F.col("first.doc_id").alias(own_id), F.col("first.th").alias(own_th), F.col("first.times").alias(n))
    mine = F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(own_th))
    kept = docs.join(keep, mine)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once, more = kept.where(F.col(n) == 1).select(*columns), kept.where(F.col(n) > 1)
    return once.union(more.dropDuplicates([own_id, own_th]).select(*columns))
