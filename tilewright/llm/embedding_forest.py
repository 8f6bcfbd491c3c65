r"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared only with those of their label (and length). A node of a tree with more than ``LEAF`` vectors is cut
along a random direction where the middle fifth of its projections is thinnest; vectors beside the cut, up to a tenth of the
node and no farther from it than ``SPILL`` of the distance of the farthest pair sought, go to both sides. All trees go down
a level at once: one aggregation finds the cuts of all nodes by approximate quantiles, one join routes, and rows carry
their projections, not their vectors. Within leaves every pair is verified by its cosine in double precision.

A pair may share several leaves. Vectors carry the list of their leaves, and a pair counts in the first it shares, so
links are counted without a row for each pair, and a leaf gives at most two rows for each of its vectors: its count, and
an edge of a spanning forest. The edges of all leaves are united by ``components``.

Exact copies are one class with a weight. Families of near copies of any size are told by ``pivots`` from a sample of
``SAMPLE`` classes: vectors within half the angle sought of one pivot are all linked with one another, so their links are
the family's weight and no pair of them is compared. What is sought outside such families has few links, so a leaf of
bounded size holds it. Trees are as many as their depth asks: a level keeps a pair at the threshold with a chance of at
least ``KEPT`` (measured in the tests), and a pair is missed by all trees with at most ``MISS``. Where a label has no more than
``LEAF`` classes there is one tree with one leaf, and the result is exact.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing, nor does one
with a null label; such a row is its own component. Rows of one id are vectors each. A row without an id counts as a link
and belongs to its component but does not name it; in a component of such rows alone ``component_id`` is null and ``kept``
true. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.simhash import named_components
from tilewright.llm.sized import checked
from tilewright.scratch import materialize

THRESHOLD = 0.93
LEAF = 2048
SPILL = 0.1
MIDDLE = 0.1  # a cut lies within this share of the median; so many vectors at most spill on either side
KEPT = 0.9
MISS = 1e-3
SAMPLE = 4096
FAMILY = 8  # sampled classes within half the angle that make a family
_MARGIN = 1e-9
_LEVELS = 50  # bits of a path
_NODE = ["label", "wide", "tree", "path"]


def unit_rows(flat: np.ndarray, wide: int) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so no square overflows."""
    rows = flat.reshape(-1, wide).astype(float)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _usable() -> Column:
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(vec_id, key)``, the key null where nothing can link, and ``(key, label, wide, embedding, copies)`` of distinct vectors."""
    label = F.col("label").cast("string")
    told = [F.when(F.col("usable"), F.xxhash64(F.lit(salt), "label", "embedding")) for salt in (1, 2)]
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding", _usable().alias("usable"))
    known = known.withColumns({"h1": told[0], "h2": told[1]})
    grouped = known.where("usable").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
    kinds = grouped.select(F.monotonically_increasing_id().alias("key"), "h1", "h2", "label", F.size("embedding").alias("wide"), "embedding", "copies")
    kinds = materialize(kinds, "vector-classes")
    of = kinds.select("key", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    rows = known.select("vec_id", "h1", "h2").join(of, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    return materialize(rows.select("vec_id", "key"), "vector-rows"), kinds.drop("h1", "h2")


def pivots(kinds: DataFrame, threshold: float, sample: int = SAMPLE, least: int = FAMILY) -> list[tuple[int, str, np.ndarray]]:
    """``key, label, unit vector`` of the middles of families found in a sample by a hash of the key."""
    drawn = kinds.select("key", "label", "wide", F.col("embedding").cast("array<double>").alias("v")).orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    near = math.cos(math.acos(threshold) / 2) + _MARGIN
    groups: dict[tuple, list] = {}
    for r in drawn:
        groups.setdefault((r.label, r.wide), []).append(r)
    out = []
    for (label, wide), held in sorted(groups.items()):
        rows = unit_rows(np.array([r.v for r in held]).ravel(), wide)
        close = rows @ rows.T >= near
        while len(close) and (count := close.sum(axis=1)).max() >= least:
            at = int(count.argmax())
            out.append((held[at].key, label, rows[at]))
            free = ~close[at]
            close[:, ~free] = close[~free] = False
    return out


def with_families(kinds: DataFrame, found: list[tuple[int, str, np.ndarray]], threshold: float) -> DataFrame:
    """``kinds`` with ``family``, the key of the first pivot within half the angle, or null."""
    near = math.cos(math.acos(threshold) / 2) + _MARGIN
    schema = f"key long, label string, wide int, embedding {dict(kinds.dtypes)['embedding']}, copies long, family long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family = np.full(batch.num_rows, -1, np.int64)
            label, wide = np.array(batch.column("label").to_pylist(), object), batch.column("wide").to_numpy(zero_copy_only=False)
            for key, of, middle in found:
                asked = np.flatnonzero((label == of) & (wide == len(middle)) & (family < 0))
                if len(asked):
                    rows = unit_rows(batch.column("embedding").take(pa.array(asked)).flatten().to_numpy(zero_copy_only=False), len(middle))
                    family[asked[rows @ middle >= near]] = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(family, mask=family < 0)], [*batch.schema.names, "family"])

    return materialize(kinds.mapInArrow(run, schema), "vector-families")


def direction(tree: int, level: int, wide: int) -> np.ndarray:
    """A random direction that a tree cuts along at a level."""
    found = np.random.default_rng((tree, level, wide)).normal(size=wide)
    return found / np.linalg.norm(found)


def depth_and_trees(largest: int, leaf: int, kept: float = KEPT, miss: float = MISS) -> tuple[int, int]:
    """Levels that a label of ``largest`` classes needs, and the trees that miss a pair with at most ``miss``."""
    levels = max(0, math.ceil(math.log(max(1, largest) / leaf) / math.log(2 / (1 + 2 * MIDDLE))))
    return levels, 1 if not levels else max(1, math.ceil(math.log(miss) / math.log1p(-(kept**levels))))


def _projected(kinds: DataFrame, trees: int, levels: int) -> DataFrame:
    """``key, label, wide, tree, path, at``: every class at the root of every tree, with its projections for all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("wide").to_numpy(zero_copy_only=False)
            for wide in np.unique(every):
                part = batch.filter(pa.array(every == wide))
                rows = unit_rows(part.column("embedding").flatten().to_numpy(zero_copy_only=False), int(wide))
                for tree in range(trees):
                    axes = np.stack([direction(tree, level, int(wide)) for level in range(levels)], axis=1)
                    at = pa.FixedSizeListArray.from_arrays(pa.array((rows @ axes).ravel()), levels).cast(pa.list_(pa.float64()))
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key"), part.column("label"), part.column("wide"), pa.array(np.full(n, tree, np.int32)), pa.array(np.ones(n, np.int64)), at],
                        ["key", *_NODE, "at"],
                    )

    return kinds.select("key", "label", "wide", "embedding").mapInArrow(run, "key long, label string, wide int, tree int, path long, at array<double>")


def node_cuts(places: DataFrame, level: int, levels: int, leaf: int, reach: float) -> DataFrame:
    """A row for each node: ``cut`` and ``spill``, null where it is small enough to be a leaf."""
    shares = [0.5 - MIDDLE + k * MIDDLE / 10 for k in range(21)]
    marks = F.percentile_approx(F.col("at")[level % levels], F.array(*[F.lit(s) for s in shares]), 10_000)
    found = places.groupBy(*_NODE).agg(F.count("*").alias("n"), marks.alias("m"))
    # Of the slices between marks the widest is the thinnest; the cut goes through its middle.
    gaps = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.struct((F.element_at("m", k + 1) - F.element_at("m", k)).alias("wide"), (F.element_at("m", k + 1) + F.element_at("m", k)).alias("sum")))
    widest = F.array_max(gaps)
    span = F.element_at("m", -1) - F.element_at("m", 1)
    big = F.col("n") > leaf
    cut = F.when(big, widest["sum"] / 2).alias("cut")
    spill = F.when(big & (span > _MARGIN), F.least(F.lit(reach * SPILL), span / 2)).alias("spill")
    return found.select(*[F.col(c).alias(f"of_{c}") for c in _NODE], cut, spill)


def leaves(kinds: DataFrame, trees: int, levels: int, leaf: int, threshold: float) -> DataFrame:
    """``key, label, wide, tree, path``: the leaves of every class, at least one in each tree."""
    if not levels:
        return kinds.select("key", "label", "wide", F.lit(0).alias("tree"), F.lit(1).cast("long").alias("path"))
    reach = math.sqrt(2 - 2 * threshold)
    places, done = materialize(_projected(kinds, trees, levels), "forest"), []
    for level in range(_LEVELS):
        cuts = materialize(node_cuts(places, level, levels, leaf, reach), "forest-cuts")
        same = F.lit(True)
        for c in _NODE:
            same = same & (F.col(c) == F.col(f"of_{c}"))
        met = places.join(checked(cuts, 96), same)
        done.append(materialize(met.where("cut IS NULL").select("key", *_NODE), "forest-leaves"))
        if cuts.where("cut IS NOT NULL").isEmpty():
            break
        at, left, right = F.col("at")[level % levels], F.col("path") * 2, F.col("path") * 2 + 1
        coin = F.xxhash64("key", F.lit(level)) % 2 == 0  # projections that are all but equal: by chance
        sides = F.when(F.col("spill").isNull(), F.when(coin, F.array(left)).otherwise(F.array(right)))
        sides = sides.when(F.abs(at - F.col("cut")) <= F.col("spill"), F.array(left, right)).when(at < F.col("cut"), F.array(left)).otherwise(F.array(right))
        places = materialize(met.where("cut IS NOT NULL").select("key", "label", "wide", "tree", F.explode(sides).alias("path"), "at"), "forest")
    else:
        raise RuntimeError(f"nodes of more than {leaf} vectors after {_LEVELS} levels")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def leaf_links(rows: np.ndarray, copies: np.ndarray, family: np.ndarray, earlier: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``links, up`` of a leaf's vectors (of length one): links that count here, by weight, and the row number of a vector reached by links.

    ``earlier`` holds, as bits, the leaves before this one that a vector lies in; a negative ``family`` is none.
    """
    n = len(rows)
    links, up = np.zeros(n, np.int64), np.arange(n)
    linked = np.zeros((n, n), bool)
    for at in range(0, n, 512):
        linked[at : at + 512] = rows[at : at + 512] @ rows.T >= threshold
    np.fill_diagonal(linked, False)
    linked |= linked.T  # a product by blocks may differ in its last bit from one side to the other
    i, j = np.nonzero(np.triu(linked))
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        here = ~(earlier[a] & earlier[b]).any(axis=1) & ((family[a] < 0) | (family[a] != family[b]))
        np.add.at(links, a[here], copies[b[here]])
        np.add.at(links, b[here], copies[a[here]])
    unseen = linked.any(axis=1)
    for first in np.flatnonzero(unseen):
        if not unseen[first]:
            continue
        front = np.zeros(n, bool)
        front[first] = True
        while front.any():
            unseen &= ~front
            up[front] = first
            front = linked[front].any(axis=0) & unseen
    return links, up


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links and edges of each leaf of a sorted partition; a leaf may go over the ends of batches."""
    held: list[pa.RecordBatch] = []

    def one(table: pa.Table) -> pa.RecordBatch:
        wide, code = table.column("wide")[0].as_py(), table.column("code")[0].as_py()
        rows = unit_rows(table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), wide)
        copies, key = table.column("copies").to_numpy(), table.column("key").to_numpy()
        family = table.column("family").fill_null(-1).to_numpy()
        mine = table.column("mine").combine_chunks()
        flat, owner = mine.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(rows)), mine.value_lengths().to_numpy(zero_copy_only=False))
        before = flat < code
        names, which = np.unique(flat[before], return_inverse=True)
        bits = np.zeros((len(rows), max(1, len(names))), bool)
        bits[owner[before], which] = True
        links, up = leaf_links(rows, copies, family, np.packbits(bits, axis=1), threshold)
        some = (links > 0) | (up != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(links[some]), pa.array(key[up[some]])], ["key", "links", "up"])

    for batch in batches:
        if not batch.num_rows:
            continue
        label, code = np.array(batch.column("label").to_pylist(), object), batch.column("code").to_numpy(zero_copy_only=False)
        wide = batch.column("wide").to_numpy(zero_copy_only=False)
        new = np.flatnonzero((label[1:] != label[:-1]) | (code[1:] != code[:-1]) | (wide[1:] != wide[:-1])) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and (a or any(held[-1].column(c)[0] != part.column(c)[0] for c in ("label", "code", "wide"))):
                yield one(pa.Table.from_batches(held))
                held = []
            held.append(part)
    if held:
        yield one(pa.Table.from_batches(held))


def forest_links(kinds: DataFrame, threshold: float, leaf: int = LEAF, trees: int | None = None) -> DataFrame:
    """``key, links, up`` from every leaf: the weight of links that count there, and a class of the same component.

    ``kinds`` is ``(key, label, wide, embedding, copies, family)``; ``trees`` overrides what the depth asks.
    """
    most = kinds.groupBy("label", "wide").count().agg(F.max("count")).first()[0] or 0
    levels, asked = depth_and_trees(most, leaf)
    found = leaves(kinds, trees or asked, levels, leaf, threshold)
    found = found.withColumn("code", F.shiftleft(F.col("tree").cast("long"), _LEVELS + 1).bitwiseOR(F.col("path")))
    found = materialize(found.select("key", "code"), "forest-codes") if levels else found.select("key", "code")
    mine = found.groupBy("key").agg(F.collect_list("code").alias("mine"))  # a few for each tree
    met = kinds.join(mine, "key").select("key", "label", "wide", "embedding", "copies", "family", "mine", F.explode("mine").alias("code"))
    dealt = met.repartition("label", "wide", "code").sortWithinPartitions("label", "wide", "code")
    return materialize(dealt.mapInArrow(lambda batches: _compared(batches, threshold), "key long, links long, up long"), "forest-links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, trees: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``."""
    rows, kinds = classes(vectors)
    kinds = with_families(kinds, pivots(kinds, threshold), threshold)
    found = forest_links(kinds, threshold, leaf, trees)
    edges = found.select(F.col("key").alias("a"), F.col("up").alias("b")).unionByName(kinds.where("family IS NOT NULL").select(F.col("key").alias("a"), F.col("family").alias("b")))
    weight = kinds.where("family IS NOT NULL").groupBy("family").agg(F.sum("copies").alias("weight"))
    weight = materialize(weight, "family-weights").withColumnRenamed("family", "of_family")  # as many rows as the sample has pivots
    inside = kinds.join(F.broadcast(weight), F.col("family") == F.col("of_family"), "left")
    counted = found.groupBy("key").agg(F.sum("links").alias("links"))
    total = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.col("copies") - 1)
    per_key = inside.join(counted, "key", "left").select(F.col("key").alias("of_key"), total.alias("n_links"))
    per_key = materialize(per_key, "vector-links")
    marked = rows.where("key IS NOT NULL").select(F.col("vec_id").alias("doc_id"), F.col("key").alias("print"))
    named = named_components(materialize(marked, "vector-keys"), lambda _: edges.where("a <> b"))
    some = named.join(per_key, F.col("print") == F.col("of_key")).select(F.col("doc_id").alias("vec_id"), "n_links", "component_id")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
