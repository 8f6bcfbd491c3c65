r"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` distinct vectors, by a hash of their id) a neighbour graph is built and cut into parts of
equal size with few edges between them: one for about ``PART_ROWS`` rows of the table, as far as the sample has
``PART_SAMPLE`` vectors for each. A softmax classifier learns from each sampled vector's share of neighbours in every
part. It then deals every row of the table to its most probable part, and sends a query to several; within those parts
scores are exact. How many parts a query visits is settled on the table itself: ``HELD`` queries are answered by brute
force in one pass, and the smallest number that finds at least ``AIM`` of their true neighbours is taken.

A part of any size is split by a hash into blocks of about ``BLOCK`` rows, and the queries sent to a part into blocks of
``QUERY_BLOCK``, so neither a common vector nor a long list of queries gathers in one task. Rows are copied only for
parts with more queries than that. A block answers with its best rows for each query; a query's answers are merged.

Scores are sums from the first component to the last in double precision, so equal vectors have equal scores and ties go
to the smaller id on every layout. Block products by matrix multiplication only choose, with a margin for rounding.

Defined cases: a vector that is null, zero or holds a null or non-finite component takes no part, nor does a null id;
vectors of another length than the sample's commonest are compared with those of their own length, exactly; an id that
several rows have is listed once, with its best score; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.sized import checked
from tilewright.scratch import materialize

SAMPLE = 8192
PART_ROWS = 1024
PART_SAMPLE = 16
GRAPH_K = 10
AIM = 0.95
HELD = 256
BLOCK = 8192
QUERY_BLOCK = 16_384
_SLICE = 256


@dataclass(frozen=True)
class Router:
    """Weights of the classifier: a column for each part."""

    weights: np.ndarray
    bias: np.ndarray

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Parts from the most to the least probable, for each vector."""
        return np.argsort(-(_unit(vectors) @ self.weights + self.bias), axis=1, kind="stable")


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nearest(vectors: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
    """Row numbers of the ``k`` largest inner products of each query, without row ``own`` of it."""
    out = []
    for at in range(0, len(queries), _SLICE):
        scores = queries[at : at + _SLICE] @ vectors.T
        scores[np.arange(len(scores)), own[at : at + _SLICE]] = -np.inf
        out.append(np.argpartition(-scores, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def partition_graph(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.05) -> np.ndarray:
    """A part for each node: halves along main directions, then moves that save the most edges within the size limit."""
    n = len(vectors)
    label = np.zeros(n, np.int64)
    for level in range(int(math.log2(parts))):
        for part in range(1 << level):
            inside = np.flatnonzero(label == part)
            centred = vectors[inside] - vectors[inside].mean(axis=0)
            _, _, axes = np.linalg.svd(centred[:: max(1, len(inside) // 2048)], full_matrices=False)
            order = inside[np.argsort(centred @ axes[0], kind="stable")]
            label[order[len(order) // 2 :]] += 1 << level
    limit = math.ceil(slack * n / parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        target = votes.argmax(axis=1)
        gain = votes[np.arange(n), target] - votes[np.arange(n), label]
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if sizes[target[node]] < limit:
                sizes[label[node]] -= 1
                sizes[target[node]] += 1
                label[node] = target[node]
                moved += 1
        if not moved:
            break
    return label


def part_count(rows: int, sampled: int) -> int:
    """A power of two: parts of about ``PART_ROWS`` rows, as far as the sample goes."""
    parts = max(1, min(max(8, -(-rows // PART_ROWS)), sampled // PART_SAMPLE))
    return 1 << (parts.bit_length() - 1)


def fit_router(sample: np.ndarray, parts: int, seed: int = 7) -> Router:
    """Partition the sample's neighbour graph and fit the classifier; deterministic for a given sample."""
    vectors = np.unique(sample, axis=0)
    n = len(vectors)
    while parts > 1 and n < 8 * parts:
        parts //= 2
    if parts == 1:
        return Router(np.zeros((sample.shape[1], 1)), np.zeros(1))
    rng = np.random.default_rng(seed)
    vectors = vectors[rng.permutation(n)]
    graph = nearest(vectors, vectors, min(GRAPH_K, n - 1), np.arange(n))
    label = partition_graph(vectors, graph, parts)
    share = np.zeros((n, parts))
    np.add.at(share, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1.0)
    share[np.arange(n), label] += graph.shape[1]
    share /= share.sum(axis=1, keepdims=True)
    x = _unit(vectors)
    weights, bias = np.zeros((x.shape[1], parts)), np.zeros(parts)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(bias)]
    step = 0
    for _ in range(30):
        order = rng.permutation(n)
        for at in range(0, n, 512):
            rows = order[at : at + 512]
            z = x[rows] @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            off = (p - share[rows]) / len(rows)
            step += 1
            for value, slope, m in ((weights, x[rows].T @ off, 0), (bias, off.sum(axis=0), 2)):
                moments[m] = 0.9 * moments[m] + 0.1 * slope
                moments[m + 1] = 0.99 * moments[m + 1] + 0.01 * slope**2
                value -= 0.05 * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[m + 1] / (1 - 0.99**step)) + 1e-8)
    return Router(weights, bias)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite components, none null, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(whole), -1) if len(whole) else flat.reshape(0, 1)


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """For each query the ``k`` best ids of a block: ``query number, row number, score``, ordered."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    first_row = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    repeated = len(first_row) < len(ids)
    for at in range(0, len(queries), _SLICE):
        part = queries[at : at + _SLICE]
        rough = part @ rows.T
        rough[query_ids[at : at + _SLICE, None] == ids[None, :]] = -np.inf
        of_id = np.maximum.reduceat(rough, first_row, axis=1) if repeated else rough
        least = min(k, of_id.shape[1])
        kth = np.partition(of_id, -least, axis=1)[:, -least][:, None]
        with np.errstate(invalid="ignore"):
            margin = np.where(np.isfinite(kth), 1e-9 * np.linalg.norm(part, axis=1, keepdims=True) * np.linalg.norm(rows, axis=1).max(), 0)
            q, c = np.nonzero((rough >= kth - margin) & (rough > -np.inf))
        score = np.zeros(len(q))
        for d in range(part.shape[1]):
            score += part[q, d] * rows[c, d]
        best = np.lexsort((ids[c], -score, q))
        q, c, score = q[best], c[best], score[best]
        if repeated:  # of the rows of one id the best alone
            pair = np.unique(np.stack((q, ids[c])), axis=1, return_index=True)[1]
            pair.sort()
            q, c, score = q[pair], c[pair], score[pair]
        first = np.searchsorted(q, np.arange(len(part)))
        keep = np.arange(len(q)) - first[q] < k
        yield q[keep] + at, order[c[keep]], score[keep]


def _answers(asked: np.ndarray, asked_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query id, row number, score`` of the best rows of a block for all queries."""
    found = list(best_of_block(asked, asked_ids, rows, ids, k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return asked_ids[q], c, score


_BEST = "array<struct<away:double,vec_id:bigint,part:int>>"


def _best_lists(query: np.ndarray, vec_id: np.ndarray, part: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """``query_id, best``: a row for each query; rows of a query must stand together."""
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    values = pa.StructArray.from_arrays([pa.array(-score), pa.array(vec_id), pa.array(part.astype(np.int32))], ["away", "vec_id", "part"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(query)).astype(np.int32)), values)
    return pa.RecordBatch.from_arrays([pa.array(query[starts]), lists], ["query_id", "best"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``query_id, best``: the ``k`` best of each query's lists, an id once, with its best score."""
    lists = found.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("best"))
    none = F.array().cast(_BEST)
    # In order of score, so the first of an id's rows is its best.
    new = lambda acc, x: (F.size(acc) < k) & ~F.exists(acc, lambda y: y["vec_id"] == x["vec_id"])
    once = F.aggregate("best", none, lambda acc, x: F.when(new(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return lists.select("query_id", once.alias("best"))


def _probes(index: DataFrame, asked: DataFrame, router: Router, k: int, wide: int, aim: float) -> int:
    """The smallest number of parts that finds ``aim`` of the true neighbours of ``HELD`` queries; all rows are looked at."""
    parts = len(router.bias)
    held = asked.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(HELD).collect() if parts > 1 else []
    if not held:
        return parts
    vectors, ids = np.array([r.embedding for r in held], float), np.array([r.vec_id for r in held])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            if batch.num_rows:
                part, own = batch.column("part").to_numpy(), batch.column("vec_id").to_numpy()
                query, row, score = _answers(vectors, ids, _matrix(batch.column("embedding")), own, k)
                held = [np.concatenate(x) for x in zip(held, (query, own[row], part[row], score), strict=True)]
                order = np.lexsort((held[1], -held[3], held[0]))  # an id may stand twice; all its rows count as one later
                held = [x[order] for x in held]
                first = np.searchsorted(held[0], held[0])
                held = [x[np.arange(len(first)) - first < 4 * k] for x in held]
        yield _best_lists(*held)

    rows = index.where((F.size("embedding") == wide) & (F.col("part") >= 0)).select("part", "vec_id", "embedding")
    true = _merged(rows.mapInArrow(scan, f"query_id long, best {_BEST}"), k).collect()  # HELD rows
    turn = np.argsort(router.order(vectors), axis=1)  # when a query comes to a part
    row_of = {int(i): n for n, i in enumerate(ids)}
    turns = np.array([turn[row_of[r.query_id], x.part] for r in true for x in r.best])
    return next((p for p in range(1, parts) if len(turns) == 0 or (turns < p).mean() >= aim), parts)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, parts: int | None = None, aim: float = AIM) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries(vec_id, embedding)`` against ``vectors(vec_id, embedding)``.

    ``parts`` follows from the number of rows, if None.
    """
    spark = vectors.sparkSession
    numbers = F.col("embedding").cast("array<double>").alias("embedding")
    plain = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), numbers).where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    )
    order = F.md5(F.col("vec_id").cast("string"))
    chosen = plain(vectors).orderBy(order, "vec_id", F.xxhash64("embedding")).limit(sample).select("embedding").toArrow().column(0)
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = pc.list_value_length(chosen).to_numpy()
    wide = int(max(set(lengths.tolist()), key=lambda d: ((lengths == d).sum(), d)))
    fitted = _matrix(chosen.filter(pa.array(lengths == wide)))
    router = fit_router(fitted, parts or part_count(plain(vectors).count(), len(fitted)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its part; rows of another length have a part by length, below zero."""
        for batch in batches:
            long = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            part = -long.astype(np.int32)
            usual = np.flatnonzero(long == wide)
            if len(usual):
                part[usual] = router.order(_matrix(batch.column("embedding").take(pa.array(usual))))[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], ["part", "vec_id", "embedding"])

    index = materialize(plain(vectors).mapInArrow(deal, "part int, vec_id long, embedding array<double>"), "vector-index")
    asked = plain(queries)
    probes = _probes(index, asked.where(F.size("embedding") == wide), router, k, wide, aim)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            ways = [[-int(n)] for n in long]
            usual = np.flatnonzero(long == wide)
            if len(usual):
                found = router.order(_matrix(batch.column("embedding").take(pa.array(usual))))[:, :probes].tolist()
                for row, way in zip(usual.tolist(), found, strict=True):
                    ways[row] = way
            yield pa.RecordBatch.from_arrays([pa.array(ways, pa.list_(pa.int32())), *batch.columns], ["parts", "vec_id", "embedding"])

    routed = materialize(asked.mapInArrow(route, "parts array<int>, vec_id long, embedding array<double>"), "vector-queries")
    # A row for each part, of which there are at most SAMPLE / PART_SAMPLE, and one for each odd length.
    rows_in = index.groupBy("part").agg(F.count("*").alias("n_rows"))
    asked_in = routed.select(F.explode("parts").alias("asked_part")).groupBy("asked_part").agg(F.count("*").alias("n_asked"))
    met = rows_in.join(asked_in, F.col("part") == F.col("asked_part"))
    blocks = met.select(F.col("part").alias("of_part"), F.ceil(F.col("n_rows") / BLOCK).cast("int").alias("row_blocks"), F.ceil(F.col("n_asked") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    blocks = checked(materialize(blocks, "vector-blocks"), 24)
    block_of = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = index.join(blocks, F.col("part") == F.col("of_part")).select(
        "part", block_of(F.col("row_blocks")).alias("block"), every(F.col("query_blocks")).alias("query_block"), "vec_id", "embedding"
    )
    sent = routed.select(F.explode("parts").alias("part"), "vec_id", "embedding").join(blocks, F.col("part") == F.col("of_part"))
    sent = sent.select("part", every(F.col("row_blocks")).alias("block"), block_of(F.col("query_blocks")).alias("query_block"), "vec_id", "embedding")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        query, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(ids) and len(asked_ids):
            query, row, score = _answers(_matrix(right.column("embedding")), asked_ids, _matrix(left.column("embedding")), ids, k)
        return pa.Table.from_batches([_best_lists(query, ids[row], np.zeros(len(row)), score)])

    keys = ("part", "block", "query_block")
    found = rows.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(answer, f"query_id long, best {_BEST}")
    listed = _merged(found, k).select("query_id", F.posexplode("best").alias("at", "one"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.away")).alias("score"))
