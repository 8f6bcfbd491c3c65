"""Exact nearest neighbours: three metrics, filters before scoring, deterministic ties, class prototypes.

Queries are a stated set and meet the gallery in blocks. Up to ``QUERY_BLOCK`` queries travel to the gallery's partitions,
which are scanned once and do not move. More queries than that stay off the driver: they are dealt into blocks, the
gallery into others, and each pair of blocks is one group of a cogroup. Either way a task keeps ``k`` rows for a query,
ties cut by id, so what is shuffled is ``k`` rows for a query and task rather than the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "inner_product", "euclidean")
QUERY_BLOCK = 4096
GALLERY_BLOCK = 16_384
QUERY_SLICE = 256
ROW_SLICE = 4096  # a slice of scores is 8 MB
_FOUND = "query_id string, tile_id string, score double"


def check_vectors(gallery: DataFrame) -> None:
    """Raise unless ids are unique and vectors finite, of one length and not zero."""
    vector = F.col("embedding")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = gallery.agg(
        F.count("*").alias("rows"),
        F.count_distinct("tile_id").alias("ids"),
        F.count_distinct(F.size(vector)).alias("lengths"),
        F.count_if(vector.isNull() | bad | ~F.exists(vector, lambda x: x != 0)).alias("unusable"),
    ).first()
    if found.rows != found.ids or found.lengths > 1 or found.unusable:
        raise ValueError(f"gallery has {found.rows} rows, {found.ids} ids, {found.lengths} lengths, {found.unusable} unusable vectors")


def checked_matrix(ids: pa.Array, vectors: pa.Array, metric: str, what: str, wide: int | None = None) -> np.ndarray:
    """``vectors`` as a matrix; one that is null, not finite, of another length, or zero under cosine is an error that names its id."""
    length = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    wide = int(length[0]) if wide is None else wide
    for k in np.flatnonzero(length != wide)[:1]:
        raise ValueError(f"{what} {ids[int(k)]} has a vector of length {length[k]} where {wide} is expected")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    matrix = flat.reshape(-1, wide)
    for k in np.flatnonzero(~np.isfinite(matrix).all(axis=1))[:1]:
        raise ValueError(f"{what} {ids[int(k)]} has a component that is null or not finite")
    if metric == "cosine":
        for k in np.flatnonzero(~matrix.any(axis=1))[:1]:
            raise ValueError(f"{what} {ids[int(k)]} has a zero vector: its cosine is undefined")
    return matrix


def _exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs of row numbers, summed from the first component to the last, so equal vectors have equal scores."""
    total, one, two = np.zeros(len(q)), np.zeros(len(queries)), np.zeros(len(rows))
    for d in range(queries.shape[1]):
        a, b = queries[q, d], rows[r, d]
        total += (a - b) ** 2 if metric == "euclidean" else a * b
        one += queries[:, d] ** 2
        two += rows[:, d] ** 2
    if metric == "euclidean":
        return np.sqrt(total)
    if metric == "cosine":
        return np.clip(total / (np.sqrt(one)[q] * np.sqrt(two)[r]), -1.0, 1.0)
    return total


def best_rows(queries: np.ndarray, rows: np.ndarray, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``query number, row number, score`` of every pair that may be among the ``k`` best of its query, a slice of queries at a time.

    A block product chooses, with a margin for rounding; what it chooses is scored exactly. Ties at the cut stay in. Rows
    pass in slices, so what is held of a product does not grow with their number: a slice's pairs are kept where they may
    be among the best so far, and once more where they may be among the best of all.
    """
    long = np.linalg.norm(rows, axis=1)
    for at in range(0, len(queries), QUERY_SLICE):
        part = queries[at : at + QUERY_SLICE]
        own = np.linalg.norm(part, axis=1)[:, None]
        scale = own * max(1e-300, long.max(initial=0.0))
        if metric == "cosine":
            scale = np.ones((len(part), 1))
        elif metric == "euclidean":
            scale = scale + (long**2).max(initial=0.0)
        kept, top = [], np.zeros((len(part), 0))
        for first in range(0, len(rows), ROW_SLICE):
            some = slice(first, first + ROW_SLICE)
            rough = part @ rows[some].T
            if metric == "cosine":
                rough /= own * long[None, some]
            elif metric == "euclidean":
                rough -= long[None, some] ** 2 / 2  # the nearer, the larger; the query's own length does not matter
            least = min(k, rough.shape[1])
            top = np.concatenate((top, np.partition(rough, -least, axis=1)[:, -least:]), axis=1)
            least = min(k, top.shape[1])
            top = np.partition(top, -least, axis=1)[:, -least:].copy()
            q, r = np.nonzero(rough >= top[:, :1] - 1e-9 * scale)
            kept.append((q, r + first, rough[q, r]))
        if not kept:
            continue
        q, r, near = (np.concatenate(x) for x in zip(*kept, strict=True))
        q, r = (x[near >= (top[:, :1] - 1e-9 * scale)[q, 0]] for x in (q, r))
        yield q + at, r, _exact(part, rows, q, r, metric)


def _first(group: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first ``k`` of their run of equal numbers."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, int)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group)))) < k


class Best:
    """The ``k`` best rows of each query, as blocks of the gallery pass by; ties go to the smaller id."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray, k: int, metric: str, skip_self: bool) -> None:
        self.ids, self.matrix, self.k, self.metric, self.skip_self = ids.cast(pa.string()), matrix, k, metric, skip_self
        self.held: pa.Table | None = None

    def meet(self, names: pa.Array, rows: np.ndarray) -> None:
        names = names.cast(pa.string())
        by_name = np.empty(len(names), np.int64)
        by_name[pc.sort_indices(names).to_numpy(zero_copy_only=False)] = np.arange(len(names))
        own = pc.fill_null(pc.index_in(self.ids, names), -1).to_numpy(zero_copy_only=False) if self.skip_self else np.full(len(self.ids), -1)
        repeated = self.skip_self and len(pc.unique(names)) < len(names)
        sign = 1.0 if self.metric == "euclidean" else -1.0
        parts = []
        for q, r, score in best_rows(self.matrix, rows, self.k + 1, self.metric):  # one more, as a query may meet itself
            other = r != own[q]
            if repeated:
                other = pc.not_equal(self.ids.take(pa.array(q)), names.take(pa.array(r))).to_numpy(zero_copy_only=False)
            q, r, score = q[other], r[other], score[other]
            order = np.lexsort((by_name[r], sign * score, q))
            order = order[_first(q[order], self.k)]
            parts.append(pa.table({"q": q[order], "name": names.take(pa.array(r[order])), "score": score[order], "key": sign * score[order]}))
        found = pa.concat_tables(parts)
        if self.held is not None:
            found = pa.concat_tables([self.held, found])
            found = found.take(pc.sort_indices(found, [("q", "ascending"), ("key", "ascending"), ("name", "ascending")]))
            found = found.filter(pa.array(_first(found.column("q").to_numpy(), self.k)))
        self.held = found

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            out = pa.table({"query_id": self.ids.take(self.held.column("q").combine_chunks()), "tile_id": self.held.column("name"), "score": self.held.column("score")})
            yield from out.combine_chunks().to_batches()


def _meet_few(rows: DataFrame, held: list, k: int, metric: str, skip_self: bool) -> DataFrame:
    """Best rows of each partition for queries that travel to it."""
    ids = pa.array([r.query_id for r in held], pa.string())
    matrix = checked_matrix(ids, pa.array([r.embedding for r in held], pa.list_(pa.float64())), metric, "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, matrix, k, metric, skip_self)
        for batch in batches:
            if batch.num_rows:
                best.meet(batch.column("tile_id"), checked_matrix(batch.column("tile_id"), batch.column("embedding"), metric, "tile", matrix.shape[1]))
        yield from best.batches()

    return rows.mapInArrow(run, _FOUND)


def _meet_many(rows: DataFrame, asked: DataFrame, k: int, metric: str, skip_self: bool) -> DataFrame:
    """Best rows of each pair of a block of queries and a block of the gallery."""
    parts, blocks = -(-rows.count() // GALLERY_BLOCK), -(-asked.count() // QUERY_BLOCK)
    part, block = F.pmod(F.xxhash64("tile_id"), F.lit(max(1, parts))), F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n) - 1).cast("long")))
    left = rows.select(part.alias("part"), every(blocks).alias("block"), "tile_id", "embedding")
    right = asked.select(every(parts).alias("part"), block.alias("block"), "query_id", "embedding")

    def run(gallery: pa.Table, queries: pa.Table) -> pa.Table:
        if not gallery.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.string()), "tile_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        ids, names = queries.column("query_id").combine_chunks(), gallery.column("tile_id").combine_chunks()
        matrix = checked_matrix(ids, queries.column("embedding").combine_chunks(), metric, "query")
        best = Best(ids, matrix, k, metric, skip_self)
        best.meet(names, checked_matrix(names, gallery.column("embedding").combine_chunks(), metric, "tile", matrix.shape[1]))
        return pa.Table.from_batches(list(best.batches()))

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, _FOUND)


def top_k(gallery: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", skip_self: bool = True, strict: bool = False) -> DataFrame:
    """``query_id, rank, tile_id, score`` from ``gallery(tile_id, embedding)`` and ``queries(query_id, embedding)``.

    Best first (largest similarity or smallest distance), ties to the smaller ``tile_id``. Apply filters to ``gallery``
    before the call: they reach its scan. A gallery of fewer than ``k`` rows gives them all, or under ``strict`` is an
    error. Vectors that are null, not finite or of unlike length are errors, and zero vectors are under cosine.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError(f"k must be a positive integer, not {k!r}")
    if strict and (size := gallery.count()) < k:
        raise ValueError(f"k must lie between 1 and the gallery's size ({size}), not {k}")
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = gallery.select(F.col("tile_id").cast("string").alias("tile_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if not few:
        return gallery.sparkSession.createDataFrame([], "query_id string, rank int, tile_id string, score double")
    found = _meet_few(rows, few, k, metric, skip_self) if len(few) <= QUERY_BLOCK else _meet_many(rows, asked, k, metric, skip_self)
    by_score = F.col("score").asc() if metric == "euclidean" else F.col("score").desc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by_score, "tile_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "tile_id", "score")


def prototypes(support: DataFrame) -> DataFrame:
    """``label, embedding``: the normalized mean vector of each class of ``support(label, embedding)``."""
    parts = support.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    mean = parts.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    listed = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("cells"))
    vector = F.transform("cells", lambda c: c["x"])
    long = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    usable = F.when(long > 1e-12, long).otherwise(F.raise_error(F.lit("a prototype has no length")))
    return listed.select("label", F.transform(vector, lambda x: x / usable).alias("embedding"))
