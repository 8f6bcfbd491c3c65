r"""Near-duplicates by the Jaccard similarity of word shingles: candidates by MinHash bands, every link verified exactly.

Two texts link if their sets of ``SHINGLE``-word shingles have a similarity of at least 4/5. Texts with equal sets are
one node. A node enters the table under ``BANDS`` keys, each made of ``ROWS`` minima of its set, so a pair at 4/5 meets
under no key with a probability of (1 - 0.8^4)^24 = 3 in a million; 64 bits of a SimHash would need a radius near 18
for that, which no multi-index over 64 bits serves.

First each node under a key is compared with the key's least node. Then, where nodes of more than one component are left
under a key, pairs across components are judged inside a join, which Spark splits where a key has many nodes; only close
pairs come out of it. Dense groups thereby cost a comparison or so a node and key, and no link between components is
lost. Sets are made only for nodes that share a key with another, and are never kept for all documents.

Links that another method found (``simhash`` in the pipeline) can be handed over; components are then those of all links.

Defined cases are those of ``simhash``: texts without words have the empty set and are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import filled
from tilewright.llm.components import components
from tilewright.llm.simhash import SEED, named_components
from tilewright.llm.sized import checked
from tilewright.scratch import materialize

SHINGLE = 5
BANDS = 24
ROWS = 4
_CHUNK = 1 << 13
_DRAW = np.random.default_rng(SEED)
_FACTORS = _DRAW.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles; a text shorter than a shingle is one."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    first = np.concatenate(([0], ends[:-1] + 1))[: len(last)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(last)))


def keys(found: np.ndarray) -> np.ndarray:
    """A set's key in each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), _CHUNK):
        mixed = found[at : at + _CHUNK, None] * _FACTORS + _ADDED
        np.minimum(least, (mixed >> np.uint64(32)).astype(np.uint32).min(axis=0), out=least)
    rows = least.astype("<u4").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), nth) for nth, row in enumerate(rows)], np.uint64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "digest", "print", "keys"]
    kind = pa.list_(pa.int64())
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(x.as_py()) for x in part.column("text")]
            under = [keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            columns = [part.column("doc_id"), part.column("digest"), pa.array(_prints(sets)), pa.array(under, kind)]
            yield pa.RecordBatch.from_arrays(columns, names)


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            found = [shingles(x.as_py()) for x in batch.column("text").slice(at, 512)]
            listed = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(_prints(found)), listed], ["print", "shingles"])


def _plain(docs: DataFrame) -> DataFrame:
    """``doc_id, text, digest``; the digest tells unlike texts under one id apart."""
    text = filled(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("digest"))


def _close(n: Column, m: Column, shared: Column) -> Column:
    return shared * 5 >= (n + m - shared) * 4


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose sets have a similarity of at least 4/5."""
    one = sets.select(F.col("print").alias("a_print"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("print").alias("b_print"), F.col("shingles").alias("of_b"))
    both = pairs.join(one, F.col("a") == F.col("a_print")).join(two, F.col("b") == F.col("b_print"))
    n, m = F.size("of_a"), F.size("of_b")
    close = F.when(F.least(n, m) * 5 >= F.greatest(n, m) * 4, _close(n, m, F.size(F.array_intersect("of_a", "of_b"))))
    return both.where(close).select("a", "b")


def _across(left: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``left(key, print, root)`` under one key, in different components, whose short sets are close.

    The join itself judges a pair, at the first key that both share, so it gives out no pair but close ones. Short sets
    hold half of each hash; what may have fallen together in them is allowed for, and the pairs are verified afterwards.
    """
    short = F.array_distinct(F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")))
    own = sets.select(F.col("print").alias("own_print"), F.size("shingles").alias("n"), short.alias("short"))
    keyed = nodes.select(F.col("print").alias("node_print"), "keys")
    rows = left.join(own, F.col("print") == F.col("own_print")).join(keyed, F.col("print") == F.col("node_print"))
    rows = rows.select("key", "print", "root", "n", "short", "keys")
    other = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    n, m = F.col("n"), F.col("b_n")
    lost = n - F.size("short") + m - F.size("b_short")
    first_key = F.element_at(F.array_intersect("keys", "b_keys"), 1) == F.col("key")
    judged = (
        (F.col("key") == F.col("b_key"))
        & (F.col("root") < F.col("b_root"))
        & (F.least(n, m) * 5 >= F.greatest(n, m) * 4)
        & first_key
        & _close(n, m, F.size(F.array_intersect("short", "b_short")) + lost)
    )
    return rows.join(other, judged).select(F.col("print").alias("a"), F.col("b_print").alias("b"))


def set_links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b``: links that connect ``nodes(print, keys)`` as all links under common keys do.

    ``sets_of`` gives ``print, shingles`` for a table of prints; it is asked only for nodes that share a key with another.
    """
    entries = nodes.select(F.explode("keys").alias("key"), "print")
    hubs = entries.groupBy("key").agg(F.min("print").alias("a"), F.max("print").alias("most")).where("a < most")
    hubs = materialize(hubs.select(F.col("key").alias("hub_key"), "a"), "resemblance-hubs")
    shared = entries.join(checked(hubs, 16), F.col("key") == F.col("hub_key")).select("key", "a", "print")
    shared = materialize(shared, "resemblance-shared")
    met = materialize(shared.select("print").distinct(), "resemblance-met")  # the others share no key with another node
    sets = materialize(sets_of(met), "resemblance-sets")
    pairs = shared.where("a <> print").select("a", F.col("print").alias("b")).distinct()
    first = materialize(_verified(pairs, sets), "resemblance-links")
    found = materialize(components(first), "resemblance-components")
    placed = shared.join(found, F.col("print") == F.col("node"), "left").select("key", "print", F.coalesce("root", "print").alias("root"))
    placed = materialize(placed, "resemblance-placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    mixed = materialize(mixed.select(F.col("key").alias("mixed_key")), "resemblance-mixed")
    left = placed.join(checked(mixed, 8), F.col("key") == F.col("mixed_key")).drop("mixed_key")
    across = materialize(_across(materialize(left, "resemblance-left"), nodes, sets), "resemblance-across")
    return first.unionByName(_verified(across.distinct(), sets))


def _stars(sketched: DataFrame, linked: DataFrame) -> DataFrame:
    """``a, b``: the prints under each root of ``linked(doc_id, digest, root)``, hung below the least of them."""
    own = sketched.select(F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest"), "print").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))
    met = materialize(linked.select("doc_id", "digest", "root").distinct().join(own, same).select("root", "print").distinct(), "linked-met")
    least = met.groupBy("root").agg(F.min("print").alias("a"), F.max("print").alias("most")).where("a < most")
    least = materialize(least.select(F.col("root").alias("least_root"), "a"), "linked-least")
    hung = met.join(checked(least, 16), F.col("root") == F.col("least_root")).where("a <> print")
    return materialize(hung.select("a", F.col("print").alias("b")), "linked-stars")


def near_duplicates(docs: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, print, root, component_id``: one row for each document; ``print`` tells its set of shingles.

    ``linked(doc_id, digest, root)`` are components that another method found in ``docs``; their links count as well.
    """
    plain = _plain(docs)
    sketched = materialize(plain.mapInArrow(_sketches, "doc_id long, digest long, print long, keys array<long>"), "sketches")

    def sets_of(met: DataFrame) -> DataFrame:
        """Sets made anew from one text for each print of ``met``, rather than kept for all documents."""
        of = sketched.join(met, "print", "left_semi").groupBy("print").agg(F.min(F.struct("doc_id", "digest")).alias("one"))
        chosen = materialize(of.select(F.col("one.doc_id").alias("met_id"), F.col("one.digest").alias("met_digest")).distinct(), "resemblance-chosen")
        same = F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("digest") == F.col("met_digest"))
        found = plain.join(checked(chosen, 32), same, "left_semi").select("text").mapInArrow(_sets, "print long, shingles array<long>")
        return found.dropDuplicates(["print"])

    def links(prints: DataFrame) -> DataFrame:
        nodes = sketched.groupBy("print").agg(F.first("keys").alias("keys"))  # equal prints have equal keys
        found = set_links(materialize(nodes, "resemblance-nodes"), sets_of)
        return found if linked is None else found.unionByName(_stars(sketched, linked))

    return named_components(sketched.drop("keys"), links)
