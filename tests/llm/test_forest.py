"""The forest of random-projection trees against all pairs."""

import math
import random

import numpy as np
import pytest

from tilewright.llm import embedding_forest as forest

VECTORS = "vec_id long, embedding array<double>, label int, key string, wide int, `a.b` int"


def slow_links(rows, threshold):
    """Number of links and smallest reachable id of each row, by all pairs."""

    def usable(v, label):
        return label is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, up = [0] * n, list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if usable(v, x) else None for _, v, x in rows]
    for a in range(n):
        for b in range(a):
            if unit[a] is None or unit[b] is None or rows[a][2] != rows[b][2] or len(unit[a]) != len(unit[b]):
                continue
            if float(unit[a] @ unit[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    said = [(i, links[k], least.get(find(k))) for k, (i, _, _) in enumerate(rows)]
    return sorted(((i if i is not None else -1), n, c, i == c) for i, n, c in said)


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(i, v, x, "k", 1, 2) for i, v, x in rows], VECTORS).repartition(parts)
    got = forest.near_duplicates(df, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect())


def near(r, v, apart):
    """A vector at an angle of about ``apart`` from ``v``."""
    side = np.array([r.gauss(0, 1) for _ in v])
    side -= side @ np.array(v) / (np.array(v) @ np.array(v)) * np.array(v)
    long = np.linalg.norm(v)
    return (math.cos(apart) * np.array(v) + math.sin(apart) * long * side / np.linalg.norm(side)).tolist()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = [(k, [r.gauss(0, 1) for _ in range(12)], k % 3 if k % 7 else None) for k in range(200)]
    out += [(200 + k, near(r, out[k][1], r.uniform(0, 0.5)), out[k][2]) for k in range(100)]
    out += [(300 + k, near(r, out[4][1], 0.1), out[4][2]) for k in range(40)]
    out += [(400 + k, out[5][1], out[5][2]) for k in range(30)] + [(5, out[5][1], out[5][2])] * 2 + [(450, [2 * x for x in out[5][1]], out[5][2]), (451, out[5][1], 2 - out[5][2])]
    out += [(None, out[5][1], out[5][2]), (None, [1.0] * 12, 1), (None, [1.0] * 12, 1), (None, None, None)]
    out += [(500, None, 1), (501, [], 1), (502, [0.0] * 12, 1), (503, [float("nan")] * 12, 1), (504, [float("inf")] + [1.0] * 11, 1), (505, [None] + [1.0] * 11, 1)]
    out += [(506, [1.0, 2.0], 1), (507, [2.0, 4.1], 1), (508, [1e200] * 12, 0), (509, [1e-200] * 12, 0)]
    return out


def test_links_against_all_pairs(spark, rows):
    want = slow_links(rows, forest.THRESHOLD)
    assert run(spark, rows) == want
    assert run(spark, rows, leaf=32, trees=40) == want  # cut and spilled, every pair found by one tree or another
    assert run(spark, []) == []


def test_depth_sets_the_number_of_trees():
    assert forest.depth_and_trees(2048, 2048) == (0, 1) and forest.depth_and_trees(0, 2048) == (0, 1)
    levels, trees = forest.depth_and_trees(1_000_000, 2048)
    assert levels == 13 and (1 - forest.KEPT**levels) ** trees <= forest.MISS


def test_forest_of_its_own_depth_finds_what_it_says(spark):
    """Pairs at the threshold itself, the hardest: one level keeps at least ``KEPT`` of them, and the trees of a depth miss few."""
    r = random.Random(9)
    apart = math.acos(forest.THRESHOLD) * 0.999
    rows = []
    for k in range(1500):
        v = [r.gauss(0, 1) for _ in range(64)]
        rows += [(2 * k, v, 1), (2 * k + 1, near(r, v, apart), 1)]
    one = run(spark, rows, leaf=1800, trees=1)
    assert sum(n for _, n, _, _ in one) / 3000 >= forest.KEPT
    full = run(spark, rows, leaf=256)
    assert sum(n for _, n, _, _ in full) >= 0.995 * 3000
    assert all(c == i // 2 * 2 for i, n, c, _ in full if n)


def test_large_family_is_counted_without_its_pairs(spark):
    """A family many times a leaf: every link counted, one component, though no tree keeps it together."""
    r = random.Random(10)
    middle = [r.gauss(0, 1) for _ in range(16)]
    rows = [(k, near(r, middle, 0.05 * r.random()), 0) for k in range(900)] + [(1000 + k, [r.gauss(0, 1) for _ in range(16)], 0) for k in range(600)]
    got = run(spark, rows, leaf=64)
    assert all(n == 899 and c == 0 for i, n, c, _ in got if i < 900)
    assert [x for x in got if x[0] >= 1000] == [x for x in slow_links(rows[900:], forest.THRESHOLD)]


def test_a_pair_counts_once_however_many_leaves_it_shares():
    rows = np.eye(4)[[0, 0, 0, 1]]
    copies, family = np.array([1, 2, 3, 1]), np.array([-1, -1, -1, -1])
    links, up = forest.leaf_links(rows, copies, family, np.packbits(np.zeros((4, 1), bool), axis=1), 0.93)
    assert links.tolist() == [5, 4, 3, 0] and up.tolist() == [0, 0, 0, 3]
    seen = np.packbits(np.array([[1, 0], [1, 0], [0, 1], [0, 1]], bool), axis=1)
    links, _ = forest.leaf_links(rows, copies, family, seen, 0.93)
    assert links.tolist() == [3, 3, 3, 0]
    links, up = forest.leaf_links(rows, copies, np.array([7, 7, -1, -1]), np.packbits(np.zeros((4, 1), bool), axis=1), 0.93)
    assert links.tolist() == [3, 3, 3, 0] and up.tolist() == [0, 0, 0, 3]
