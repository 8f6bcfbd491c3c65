"""Centroid clustering against plain loops, and what its trees prune."""

import hashlib
import random

import numpy as np
import pytest

from tilewright.llm import centroids

VECTORS = "vec_id long, embedding array<double>, cluster string, cells int, `a.b` int"


def whole(vector, width):
    ok = vector is not None and len(vector) == width and all(x is not None and np.isfinite(x) for x in vector)
    return [int(np.floor(1024 * x)) for x in vector] if ok else None


def slow_clusters(rows, k, width, rounds, seed):
    kept = [(i, whole(v, width)) for i, v in rows if whole(v, width) is not None]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, digest(r[0]) if r[0] is not None else "", r[1]))[:k]
    at = [list(c) for _, c in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda c: min(range(len(at)), key=lambda z: (far(c, at[z]), z))
    for _ in range(rounds):
        owners = [place(c) for _, c in kept]
        for z in range(len(at)):
            own = [c for (_, c), o in zip(kept, owners, strict=True) if o == z]
            if own:
                at[z] = [sum(c[d] for c in own) // len(own) for d in range(width)]
    out = [(i, place(c), far(c, at[place(c)])) for i, c in kept]
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    of = lambda z: sum(d for _, o, d in out if o == z)
    return sorted(((i if i is not None else -1), z, d, of(z), sum(x[2] for x in out), said[z]) for i, z, d in out)


def table(rows):
    return [(i, v, "x", 1, 2) for i, v in rows]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    middles = [[r.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    out = [(k, [m + r.gauss(0, 0.2) for m in middles[k % 6]]) for k in range(300)]
    out += [(300 + k, out[7][1]) for k in range(70)] + [(7, out[7][1])] * 3 + [(9, [0.5] * 5), (None, [0.25] * 5), (None, [0.25] * 5)]
    out += [(400, None), (401, []), (402, [1.0] * 4), (403, [1.0, None, 1.0, 1.0, 1.0]), (404, [float("nan")] * 5), (405, [float("inf")] * 5), (406, [0.0] * 5), (407, [-0.0001] * 5)]
    return out


def test_clusters_against_loops(spark, rows):
    df = spark.createDataFrame(table(rows), VECTORS).repartition(3)
    for k, rounds in ((8, 10), (3, 2), (1, 1), (8, 0)):
        got = centroids.cluster(df, k, 5, rounds)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, got.collect())) == slow_clusters(rows, k, 5, rounds, 3)


def test_few_none_and_too_large(spark):
    some = [(5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [3.0, 3.0])]
    got = centroids.cluster(spark.createDataFrame(table(some), VECTORS), 8, 2, 3).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, got)) == slow_clusters(some, 8, 2, 3, 3)
    none = spark.createDataFrame(table([(1, None), (2, [1.0])]), VECTORS)
    assert centroids.cluster(none, 8, 2).count() == 0 and centroids.cluster(none.limit(0), 8, 2).count() == 0
    nameless = [(None, [float(k), 1.0]) for k in range(20)]
    got = centroids.cluster(spark.createDataFrame(table(nameless), VECTORS), 4, 2, 2).collect()
    assert sorted((-1, *r[1:]) for r in map(tuple, got)) == slow_clusters(nameless, 4, 2, 2, 3)
    with pytest.raises(Exception, match="a component beyond 65536"):
        centroids.cluster(spark.createDataFrame(table([(1, [1e30, 0.0])]), VECTORS), 8, 2).count()


def test_trees_assign_whole_nodes_and_keep_ties():
    """In groups apart, whole nodes go to a centroid; a vector as near to two centroids goes to the smaller number."""
    r = np.random.default_rng(4)
    middles = r.integers(-4000, 4000, (8, 3))
    cells = (middles[r.integers(0, 8, 1024)] + r.integers(-40, 40, (1024, 3))).astype(np.int64)
    order, low, high, sums = centroids.build_tree(cells)
    wholes, rows, owners = centroids.filter_tree(cells[order], low, high, middles)
    start, end, _ = centroids.tree_shape(len(cells))
    got = np.full(len(cells), -1)
    for nodes, owner in wholes:
        for node, z in zip(nodes, owner, strict=True):
            got[start[node] : end[node]] = z
            assert (sums[node] == cells[order][start[node] : end[node]].sum(axis=0)).all()
    got[rows] = owners
    want = ((cells[order][:, None] - middles) ** 2).sum(axis=2).argmin(axis=1)
    assert (got == want).all() and len(rows) < 200
    same = np.zeros((600, 3), np.int64)
    _, low, high, _ = centroids.build_tree(same)
    tied = np.array([[5, 0, 0], [0, 3, 0], [0, 0, -3], [3, 0, 0]])
    wholes, rows, owners = centroids.filter_tree(same, low, high, tied)
    assert sum(len(n) for n, _ in wholes) == 0 and len(rows) == 600 and (owners == 1).all()
