r"""Centroid clustering by kd-tree filtering, in whole numbers.

Components become ``floor(SCALE * x)``. Every partition builds kd-trees over blocks of at most ``BLOCK`` of its vectors
once; a node holds its count, its componentwise sums and its box. A round walks each tree from the root with the set of
centroids that may still be nearest: of a node's candidates the one nearest to the box's middle is compared with every
other, and a candidate that is strictly farther at each point of the box is pruned. A node with one candidate left goes to
it whole, by count and sums; what reaches a leaf is resolved by exact distances, ties to the smaller number. A tie at any
point of the box keeps a candidate, so the result is that of comparing every vector with every centroid.

Trees are a written table, read once a round; a round moves a count and sums for each centroid and task and brings one row
for each centroid to the driver. Vectors never move after the trees are built, so no cluster, however large, gathers.

Defined cases: vectors that are null, of another length than ``width``, or hold a null or non-finite component are left
out. Rows without an id are clustered and start centroids only where ids run out; rows that repeat are clustered each, and
equal hashes of ids go by the vector's numbers. Fewer vectors than ``k`` start fewer centroids; a table without any gives no rows. Numbers
beyond ``MOST`` would not leave room for a distance in a long and are an error. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.scratch import materialize

SCALE = 1024
MOST = 1 << 26
BLOCK = 1024
LEAF = 16
_FAR = np.iinfo(np.int64).max
_TREES = "ids array<long>, cells binary, low binary, high binary, sums binary"


def whole_numbers(vectors: DataFrame, width: int) -> DataFrame:
    """``vec_id, cells`` of the vectors that take part, ``cells`` as whole numbers."""
    vector = F.col("embedding").cast("array<double>")
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def cell(x):  # noqa: ANN001, ANN202
        beyond = F.raise_error(F.concat(F.lit(f"a component beyond {MOST // SCALE}: "), x.cast("string")))
        return F.when(F.abs(x * SCALE) <= MOST, F.floor(x * SCALE)).otherwise(beyond.cast("long"))

    kept = vectors.where((F.size("embedding") == width) & usable)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, cell).alias("cells"))


def starting_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of ``seed:vec_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("digest")
    rows = points.select(digest, "cells").orderBy(F.col("digest").asc_nulls_last(), "cells").limit(k).collect()
    return np.array([r.cells for r in rows], np.int64)


@lru_cache(maxsize=64)
def tree_shape(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, left child`` of the nodes over ``n`` vectors in level order; a leaf's child is -1, a right child follows its left one."""
    start, end, child = [0], [n], []
    at = 0
    while at < len(start):
        a, b = start[at], end[at]
        if b - a > LEAF:
            child.append(len(start))
            start += [a, (a + b) // 2]
            end += [(a + b) // 2, b]
        else:
            child.append(-1)
        at += 1
    return np.array(start), np.array(end), np.array(child)


def build_tree(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``order, low, high, sums``: vectors in the order of the tree, each node's box and sums; a node is halved along its widest side."""
    start, end, child = tree_shape(len(cells))
    order = np.arange(len(cells))
    low, high, sums = (np.zeros((len(start), cells.shape[1]), np.int64) for _ in range(3))
    for node in range(len(start)):
        inside = order[start[node] : end[node]]
        held = cells[inside]
        low[node], high[node], sums[node] = held.min(axis=0), held.max(axis=0), held.sum(axis=0)
        if child[node] >= 0:
            side = int(np.argmax(high[node] - low[node]))
            order[start[node] : end[node]] = inside[np.argpartition(held[:, side], len(inside) // 2)]
    return order, low, high, sums


def _squares(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    apart = rows - point
    return np.einsum("ij,ij->i", apart, apart)


def filter_tree(cells: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """``wholes, rows, owners``: nodes assigned whole with their centroids, and the rows left to leaves with theirs."""
    start, end, child = tree_shape(len(cells))
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    lengths = np.einsum("ij,ij->i", centroids, centroids)
    wholes, rows, chances = [], [], []
    while len(nodes):
        lo, hi = low[nodes], high[nodes]
        middle = np.stack([_squares(lo + hi, 2 * c) for c in centroids], axis=1)
        best = np.where(alive, middle, _FAR).argmin(axis=1)
        for z in range(len(centroids)):
            to = centroids[z] - centroids[best]  # a box's corner farthest this way is the one that favours z most
            corner = np.where(to > 0, hi, lo)
            excess = lengths[z] - lengths[best] - 2 * np.einsum("ij,ij->i", corner, to)
            alive[:, z] &= excess <= 0
        one = alive.sum(axis=1) == 1
        wholes.append((nodes[one], best[one]))
        nodes, alive = nodes[~one], alive[~one]
        leaf = child[nodes] < 0
        for node, left in zip(nodes[leaf], alive[leaf], strict=True):
            inside = np.arange(start[node], end[node])
            rows.append(inside)
            chances.append(np.broadcast_to(left, (len(inside), len(left))))
        nodes, alive = nodes[~leaf], alive[~leaf]
        nodes, alive = np.concatenate([child[nodes], child[nodes] + 1]), np.concatenate([alive, alive])
    if not rows:
        return wholes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, may = np.concatenate(rows), np.concatenate(chances)
    held, far = cells[at], np.full(may.shape, _FAR)
    for z in range(len(centroids)):
        asked = may[:, z]
        far[asked, z] = _squares(held[asked], centroids[z])
    return wholes, at, far.argmin(axis=1)


def plant(points: DataFrame, width: int) -> DataFrame:
    """The written table of trees, a row for each block of a partition's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                cells = part.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                order, low, high, sums = build_tree(cells)
                ids = part.column("vec_id").take(pa.array(order))
                raw = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((cells[order], "<i4"), (low, "<i4"), (high, "<i4"), (sums, "<i8"))]
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), *raw], [x.split()[0] for x in _TREES.split(", ")])

    planted = points.mapInArrow(run, _TREES)
    # Neither packed nor by dictionary: a task's share of the table is as large in memory as it is in storage.
    return materialize(planted, "kd-trees", compression="none", **{"parquet.enable.dictionary": "false"})


def _trees(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in range(batch.num_rows):
            raw = [np.frombuffer(batch.column(c)[row].as_buffer(), kind).reshape(-1, width) for c, kind in (("cells", "<i4"), ("low", "<i4"), ("high", "<i4"), ("sums", "<i8"))]
            yield (batch.column("ids")[row].values, *[x.astype(np.int64) for x in raw])


def cluster_sums(trees: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``counts, sums`` of the vectors nearest to each centroid."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, cells, low, high, sums in _trees(batches, width):
            start, end, _ = tree_shape(len(cells))
            wholes, rows, owners = filter_tree(cells, low, high, centroids)
            for nodes, owner in wholes:
                np.add.at(count, owner, end[nodes] - start[nodes])
                np.add.at(total, owner, sums[nodes])
            np.add.at(count, owners, 1)
            for z in range(k):
                total[z] += cells[rows[owners == z]].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    found = trees.mapInArrow(run, "cluster int, n long, total array<long>")
    added = found.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d]) for d in range(width)]).alias("total"))
    count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for r in added.collect():  # a row for each centroid
        count[r.cluster], total[r.cluster] = r.n, r.total
    return count, total


def settle(trees: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after ``rounds``; an empty one stays where it is."""
    for _ in range(rounds):
        count, total = cluster_sums(trees, centroids)
        moved = total // np.maximum(count, 1)[:, None]
        centroids = np.where(count[:, None] > 0, moved, centroids)
    return centroids


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, cells, low, high, _ in _trees(batches, width):
            start, end, _ = tree_shape(len(cells))
            wholes, rows, owners = filter_tree(cells, low, high, centroids)
            cluster = np.zeros(len(cells), np.int32)
            for nodes, owner in wholes:
                for a, b, z in zip(start[nodes], end[nodes], owner, strict=True):
                    cluster[a:b] = z
            cluster[rows] = owners
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(_squares(cells, centroids[cluster]))], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, width: int = 64, rounds: int = 10, seed: int = 3) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of ``vectors(vec_id, embedding)``.

    Distances are squared; the digest is of the final centroid's numbers joined by commas.
    """
    spark = vectors.sparkSession
    points = whole_numbers(vectors, width)
    centroids = starting_centroids(points, k, seed)
    none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], none)
    trees = plant(points, width)
    centroids = settle(trees, centroids, rounds)
    placed = materialize(assigned(trees, centroids), "clusters")
    sums = dict(placed.groupBy("cluster").agg(F.sum("distance")).collect())  # a row for each centroid
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    told = [(z, sums.get(z, 0), sum(sums.values()), digest[z]) for z in range(len(centroids))]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(*[x.split()[0] for x in none.split(", ")])
