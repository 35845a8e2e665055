"""Lloyd's clustering of integer vectors with two trees.

Vectors are dealt to blocks, and each block's cover tree is built once and written with it. In every round the centroids, which are few, make a tree of
their own that goes to all tasks; node pairs are then taken apart together. A pair goes when its least possible distance is over the greatest that some centroid
has for all vectors of the node, a node with one centroid left is counted as a whole by its sums, and only vectors of leaves with several are compared, in integers.
So clusters, ties and sums are those of a plain scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import materialize, scratch, small_batches
from tarn.llm.whitening import integers, matrix

SCALE, DIMENSIONS = 256, 64
CENTROIDS, ROUNDS, SEED = 40, 5, "2"
#: Vectors of one block, and of one leaf of its tree.
BLOCK, LEAF = 4_096, 24
#: Entries of all centroids, which the driver holds and sends to every task.
MOST_ENTRIES = 1 << 22
#: Integers up to which squared distances of MOST_WIDTH dimensions fit 64 bits.
MOST, MOST_WIDTH = float(1 << 27), 128
#: Pairs whose distances are computed at a time.
STEP = 1 << 15


@dataclass
class Tree:
    """A cover tree: nodes in breadth-first order, so that a node's children are next to each other, over points that are put in order of the nodes.

    Node i has the points of places ``start[i]`` up to ``end[i]``, all within ``radius[i]`` of the point at ``center[i]``, and the children ``child[i]`` up to ``child[i] + children[i]``.
    """

    order: np.ndarray
    center: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray
    radius: np.ndarray

    def pack(self) -> list[bytes]:
        return [a.tobytes() for a in (self.order, self.center, self.start, self.end, self.child, self.children)] + [self.radius.tobytes()]

    @staticmethod
    def unpack(parts: list[bytes]) -> Tree:
        return Tree(*(np.frombuffer(b, "<i4") for b in parts[:-1]), np.frombuffer(parts[-1], "<f8"))


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """Children's centres are points of their parent, its own centre among them; each covers half of the parent's radius and they are farther than that from each other.

    ``leaf`` points or fewer are not divided, and equal points only where a leaf has one.
    """
    n = len(x)
    z = x.astype(np.float64)
    far = lambda at, c: np.sqrt(((z[at] - z[c]) ** 2).sum(axis=1))
    order = np.arange(n)
    # (centre, place of the first point, points' distances to the centre); points are the slice of order
    level = [(0, 0, far(order, 0))]
    center, start, end, child, children, radius = [], [], [], [], [], []
    ahead = 1
    while level:
        below = []
        for c, s, d in level:
            e, r = s + len(d), float(d.max())
            own = []
            if len(d) > leaf and (r > 0 or leaf == 1):
                left, dist, at = order[s:e].copy(), d, c
                while len(left):
                    near = dist <= r / 2
                    if r == 0:  # equal points, one for each leaf
                        near = np.arange(len(left)) == 0
                        at = left[0]
                    own.append((at, left[near], dist[near] if r else np.zeros(1)))
                    left = left[~near]
                    if len(left):
                        at = left[0]
                        dist = far(left, at)
            center.append(c), start.append(s), end.append(e), radius.append(r), child.append(ahead), children.append(len(own))
            ahead += len(own)
            for at, points, dist in own:
                order[s : s + len(points)] = points
                below.append((at, s, dist))
                s += len(points)
        level = below
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    ints = [np.asarray(a, dtype="<i4") for a in (order, place[center], start, end, child, children)]
    return Tree(*ints, np.asarray(radius))


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): for each row its values from first up to first + count."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(row))


def squared(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, in integers."""
    out = np.empty(len(i), dtype=np.int64)
    for k in range(0, len(i), STEP):
        d = a[i[k : k + STEP]] - b[j[k : k + STEP]]
        out[k : k + STEP] = np.einsum("ij,ij->i", d, d)
    return out


def assign(x: np.ndarray, tree: Tree, m: np.ndarray, means: Tree) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, int]:
    """([(nodes, centroid places)], point places, centroid places, pairs whose distance was computed): nodes whose points all have one nearest centroid, and the other points one by one.

    x and m are in the order of their trees. Of equally near centroids the one with the smallest number counts.
    """
    q, c, bound = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.full(1, np.inf)
    whole, points, nearest, pairs = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    while len(q):
        # q is sorted; bound is that of each pair's node
        d = np.sqrt(squared(x, tree.center[q], m, means.center[c]).astype(np.float64))
        pairs += len(q)
        first = np.flatnonzero(np.diff(q, prepend=-1))
        run = np.cumsum(np.diff(q, prepend=-1) != 0) - 1
        best = np.minimum(np.minimum.reduceat(d + tree.radius[q], first), bound[first])[run]
        stay = d - tree.radius[q] - means.radius[c] <= best * (1 + 1e-9) + 1e-9
        q, c, bound = q[stay], c[stay], best[stay]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        count = np.diff(np.append(first, len(q)))
        run = np.repeat(np.arange(len(first)), count)
        single = means.children[c] == 0
        done = (count == 1) & single[first]
        whole.append((q[first[done]], means.start[c[first[done]]].astype(np.int64)))
        wide = np.maximum.reduceat(np.where(single, -1.0, means.radius[c]), first)
        leaf = tree.children[q[first]] == 0
        # the wider side is taken apart: a node's centroids, or else the node, or else its points
        apart = ~done & (wide >= 0) & ((wide >= tree.radius[q[first]]) | leaf)
        bare, down = ~done & ~apart & leaf, ~done & ~apart & ~leaf
        at = np.flatnonzero(bare[run])
        if len(at):
            row, place = spread(tree.start[q[at]].astype(np.int64), (tree.end - tree.start)[q[at]].astype(np.int64))
            mean = means.start[c[at]].astype(np.int64)[row]
            gap = squared(x, place, m, mean)
            pairs += len(row)
            order = np.lexsort((means.order[mean], gap, place))
            place, mean = place[order], mean[order]
            top = np.flatnonzero(np.diff(place, prepend=-1))
            points.append(place[top]), nearest.append(mean[top])
        new = []
        at = np.flatnonzero(down[run])
        if len(at):
            row, below = spread(tree.child[q[at]].astype(np.int64), tree.children[q[at]].astype(np.int64))
            new.append((below, c[at][row], bound[at][row]))
        at = np.flatnonzero(apart[run])
        if len(at):
            row, below = spread(np.where(single[at], c[at], means.child[c[at]]).astype(np.int64), np.where(single[at], 1, means.children[c[at]]).astype(np.int64))
            new.append((q[at][row], below, bound[at][row]))
        if not new:
            break
        q, c, bound = (np.concatenate(v) for v in zip(*new))
        order = np.argsort(q, kind="stable")
        q, c, bound = q[order], c[order], bound[order]
    return whole, np.concatenate(points), np.concatenate(nearest), pairs


def blocks_of(kept: DataFrame, kind: str, size: int = BLOCK) -> DataFrame:
    """(keys, x, tree): blocks of vectors with their cover trees; keys and vectors are in the tree's order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(keys: pa.Array, x: np.ndarray) -> pa.RecordBatch:
            tree = cover_tree(x)
            own = keys.take(pa.array(tree.order))
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([x[tree.order].astype("<i4").tobytes()], pa.binary()), pa.array([tree.pack()], pa.list_(pa.binary()))],
                names=["keys", "x", "tree"],
            )

        keys, xs, n = [], [], 0
        for batch in batches:
            for s in range(0, batch.num_rows, size):
                part = batch.slice(s, size)
                if n + part.num_rows > size:
                    yield done(pa.concat_arrays(keys), np.concatenate(xs))
                    keys, xs, n = [], [], 0
                keys.append(part.column(0))
                xs.append(matrix(part.column(1)))
                n += part.num_rows
        if n:
            yield done(pa.concat_arrays(keys), np.concatenate(xs))

    return kept.mapInArrow(run, f"keys array<{kind}>, x binary, tree array<binary>")


def read_block(batch: pa.RecordBatch, i: int, width: int) -> tuple[np.ndarray, Tree]:
    return np.frombuffer(batch.column(1)[i].as_py(), "<i4").reshape(-1, width).astype(np.int64), Tree.unpack(batch.column(2)[i].as_py())


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the mean of their vectors; those without one stay."""
    k, width = centroids.shape
    means = cover_tree(centroids, 1)
    held = blocks.sparkSession.sparkContext.broadcast((means, centroids[means.order]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, m = held.value
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                x, tree = read_block(batch, i, width)
                whole, points, nearest, _ = assign(x, tree, m, means)
                upto = np.concatenate([np.zeros((1, width), dtype=np.int64), np.cumsum(x, axis=0)])
                for nodes, mean in whole:
                    np.add.at(counts, means.order[mean], tree.end[nodes] - tree.start[nodes])
                    np.add.at(sums, means.order[mean], upto[tree.end[nodes]] - upto[tree.start[nodes]])
                np.add.at(counts, means.order[nearest], 1)
                np.add.at(sums, means.order[nearest], x[points])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = blocks.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    dims = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "total")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = centroids.copy()
    for c, dim, n, total in dims.collect():  # a row for each entry of a centroid, which were sent to all tasks
        out[c, dim] = total // n
    return out


def nearest(blocks: DataFrame, centroids: np.ndarray, key: str, kind: str) -> DataFrame:
    """(key, cluster, distance) of every vector."""
    width = centroids.shape[1]
    means = cover_tree(centroids, 1)
    held = blocks.sparkSession.sparkContext.broadcast((means, centroids[means.order]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, m = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                x, tree = read_block(batch, i, width)
                whole, points, near, _ = assign(x, tree, m, means)
                at = np.empty(len(x), dtype=np.int64)
                for nodes, mean in whole:
                    row, place = spread(tree.start[nodes].astype(np.int64), (tree.end - tree.start)[nodes].astype(np.int64))
                    at[place] = mean[row]
                at[points] = near
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(means.order[at].astype(np.int32)), pa.array(squared(x, np.arange(len(x)), m, at))], names=[key, "cluster", "distance"])

    return blocks.mapInArrow(run, f"`{key}` {kind}, cluster int, distance bigint")


def seeds(kept: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors with the ``k`` smallest hashes of seed and key, null keys last; of one key the smaller vector comes first."""
    rows = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256).alias("h"), "x")
    return [r.x for r in rows.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, scale: int = SCALE) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256): a row for each vector of ``dimensions`` entries.

    Entries become floor(scale * entry). Vectors that are null, of another length, or have an entry that is null, not finite or over 2^27 / ``scale``
    (whose squared distances do not fit a long) are left out. Fewer than ``k`` vectors give as many centroids; equal vectors may give equal
    centroids, of which the first gets the vectors and the others stay empty. Rows that repeat a key count each, as do rows with a null key. Other columns are not
    read; no rows give no rows. ``k`` times ``dimensions`` is at most ``MOST_ENTRIES``.
    """
    if dimensions > MOST_WIDTH or k * dimensions > MOST_ENTRIES:
        raise ValueError(f"{k} centroids of {dimensions} dimensions: at most {MOST_WIDTH} dimensions and {MOST_ENTRIES} entries are taken")
    spark = vectors.sparkSession
    small_batches(spark)
    kind = vectors.schema[key].dataType.simpleString()
    kept = vectors.select(F.col(key).alias("key"), integers(F.col(vector), scale, MOST).alias("x")).where(F.size("x") == dimensions)
    with scratch(spark) as keep:
        centroids = np.array(seeds(kept, k, seed), dtype=np.int64).reshape(-1, dimensions)
        if not len(centroids):
            return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        blocks = materialize(blocks_of(kept, kind), "blocks")
        for _ in range(rounds):
            centroids = moved(blocks, centroids)
        found = materialize(nearest(blocks, centroids, key, kind), "nearest")
        keep.append(found)
    parts = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # as many rows as there are centroids
    inertia = parts.agg(F.sum("cluster_inertia").alias("inertia"))
    names = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())], "cluster int, centroid string")
    told = parts.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(inertia)).select("cluster", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(told), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

