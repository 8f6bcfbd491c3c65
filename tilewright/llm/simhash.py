r"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint takes, bit by bit, the majority of the hashes of a text's word shingles. Fingerprints link if at most
``DISTANCE`` bits differ. Of the two 32-bit segments of such a pair one differs in at most two bits, so both lie within
one bit of a common value: each distinct fingerprint enters the table under the 33 values of the ball of radius one
around each of its segments, and those that meet under a value are verified over all 64 bits.

Work is linear. Exact copies share one fingerprint before any table is built; under a value shared by many, links are
found by a search that leaves the set of unvisited fingerprints as it reaches them, so a dense group yields a tree
rather than all its pairs, and no link between components is lost. A value that very many fingerprints share is split by
parts of the other segment, of which one must agree.

Defined cases: null and empty texts have fingerprint zero, linked like any other; a text shorter than a shingle is one
shingle; repeated rows share a fingerprint and each keep a row; a row with a null id belongs to its component, but does
not name it (a component of such rows alone has a null ``component_id``); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.rows import whole_row
from tilewright.functions.text import filled
from tilewright.llm.components import components
from tilewright.llm.sized import checked
from tilewright.scratch import materialize, temporary

SHINGLE = 4
SEED = 42
DISTANCE = 4
BITS = 64
HOT = 1 << 17  # fingerprints under one table value, beyond which it is split
_CHUNK = 1 << 16
_LOW = 0xFFFFFFFF
_PAIRED = 8  # runs up to this length are compared pair by pair


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, as an unsigned integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)]
        as_bytes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(as_bytes, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        columns = [batch.column("doc_id"), batch.column("digest"), pa.array(prints.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, print`` (a hash of the text, the fingerprint as a signed long) of each document."""
    text = filled(F.col("text"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))
    return plain.mapInArrow(_print_batches, "doc_id long, digest long, print long")


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under the values within one bit of each of its segments."""
    flips = np.concatenate(([0], 1 << np.arange(32))).astype(np.uint64)
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), 8192):
            part = prints[at : at + 8192]
            low = (part & np.uint64(0xFFFFFFFF))[:, None] ^ flips
            high = ((part >> np.uint64(32))[:, None] ^ flips) | np.uint64(1 << 32)
            keys = np.concatenate((low, high), axis=1).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(np.repeat(part, 2 * len(flips)).view(np.int64))], ["key", "print"]
            )


def _search(prints: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the links among ``prints``: each fingerprint with those first reached from it."""
    unseen = prints
    while len(unseen) > 1:
        front, unseen = [unseen[0]], unseen[1:]
        while front and len(unseen):
            at = front.pop()
            near = np.bitwise_count(unseen ^ at) <= distance
            if near.any():
                reached = unseen[near]
                yield at, reached
                front.extend(reached)
                unseen = unseen[~near]


def run_links(keys: np.ndarray, prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints under the same key; ``keys`` are sorted."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(keys)))
    size = np.repeat(lengths, lengths)
    a, b = [], []
    for apart in range(1, _PAIRED):
        if len(keys) <= apart:
            break
        left = np.flatnonzero((size[:-apart] <= _PAIRED) & (keys[:-apart] == keys[apart:]))
        near = np.bitwise_count(prints[left] ^ prints[left + apart]) <= distance
        a.append(prints[left[near]])
        b.append(prints[left[near] + apart])
    for k in np.flatnonzero(lengths > _PAIRED):
        for at, reached in _search(np.unique(prints[starts[k] : starts[k] + lengths[k]]), distance):
            a.append(np.full(len(reached), at, np.uint64))
            b.append(reached)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys of a sorted partition; a run may go over the ends of batches."""
    held_keys, held = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = run_links(keys, prints) if len(keys) else (prints, prints)
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        columns = [pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held_keys.append(batch.column("key").to_numpy(zero_copy_only=False))
        held.append(batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64))
        if held_keys[-1][0] == held_keys[-1][-1]:
            continue  # the whole batch may belong to a run that goes on
        keys, prints = np.concatenate(held_keys), np.concatenate(held)
        cut = int(np.searchsorted(keys, keys[-1]))
        held_keys, held = [keys[cut:]], [prints[cut:]]
        yield links(keys[:cut], prints[:cut])
    yield links(np.concatenate(held_keys), np.concatenate(held))


def hot_values(prints: DataFrame, hot: int) -> DataFrame | None:
    """``hot_key``: table values under which more than ``hot`` fingerprints may stand, or None; two rows a fingerprint are counted."""
    low = F.col("print").bitwiseAND(_LOW)
    high = F.shiftrightunsigned("print", 32).bitwiseOR(F.lit(1 << 32))
    segments = prints.select(F.explode(F.array(low, high)).alias("segment"))
    many = segments.groupBy("segment").agg(F.count("*").alias("n")).where(F.col("n") > hot // 33).select("segment")
    many = materialize(many, "hot-segments")
    if many.isEmpty():
        return None
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(32)])
    around = F.explode(F.transform(flips, lambda f: F.col("segment").bitwiseXOR(f))).alias("hot_key")
    return materialize(many.select(around).distinct(), "hot-values")


def split_hot(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """``entries(key, print)`` with each hot key dealt on by parts of the other segment.

    Two fingerprints within ``DISTANCE`` bits agree in one of the ``DISTANCE + 1`` parts of that segment, so they still meet.
    """
    other = F.when(F.col("key").bitwiseAND(F.lit(1 << 32)) != 0, F.col("print").bitwiseAND(_LOW)).otherwise(F.shiftrightunsigned("print", 32))
    edges = [32 * k // (DISTANCE + 1) for k in range(DISTANCE + 2)]
    parts = [
        F.xxhash64("key", F.lit(k), F.shiftright(other, a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ]
    met = entries.join(checked(hot, 16), F.col("key") == F.col("hot_key"), "left")
    keys = F.when(F.col("hot_key").isNull(), F.array("key")).otherwise(F.array(*parts))
    return met.select(F.explode(keys).alias("key"), "print")


def print_links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints of ``prints(print)`` as all links do."""
    entries = prints.mapInArrow(_balls, "key long, print long")
    values = hot_values(prints, hot)
    if values is not None:
        entries = split_hot(entries, values)
    dealt = entries.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_link_batches, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, print, root, component_id``: one row for each document."""
    return named_components(materialize(fingerprints(docs), "prints"), print_links)


def named_components(marked: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``marked(doc_id, print, ...)`` with ``root``, the print that names its component, and ``component_id``, given the ``links`` of ``(print)``."""
    prints = materialize(marked.groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    found = materialize(components(links(prints.select("print"))), "print-components")
    named = found.join(prints, found["node"] == prints["print"]).select("node", "root", "first_id")
    named = materialize(named, "print-roots")
    least = materialize(named.groupBy("root").agg(F.min("first_id").alias("least_id")), "root-ids")
    least = least.withColumnRenamed("root", "least_root")
    of_node = named.join(least, named["root"] == least["least_root"]).select("node", "root", "least_id")
    of_print = materialize(
        prints.join(of_node, prints["print"] == of_node["node"], "left").select(
            F.col("print").alias("of_print"),
            F.coalesce("root", "print").alias("root"),
            F.when(F.col("node").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"),
        ),
        "print-ids",
    )
    return marked.join(of_print, marked["print"] == of_print["of_print"]).select(*marked.columns, "root", "component_id")


def hex_print(value: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def one_of_each(docs: DataFrame, finder: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with one document of each component that ``finder`` tells of: the one with the smallest id, then text digest.

    Rows without an id are nobody's duplicates and stay. Unlike documents that share an id are judged each; of rows that
    repeat the chosen id and text the first in the order of their JSON stays. Texts are moved only where such repeats are.
    """
    with temporary() as tables:
        known = finder(docs).where("doc_id IS NOT NULL").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
        known = materialize(known, "kept-known")
        chosen = known.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("one"))
        chosen = materialize(chosen.select(F.col("root").alias("one_root"), "one"), "kept-ids")
        met = known.join(chosen, known["root"] == chosen["one_root"])
        stays = (F.col("doc_id") == F.col("one.doc_id")) & (F.col("digest") == F.col("one.digest"))
        odd = met.where(~stays | (F.col("n") > 1))
        odd = tables.keep(odd.select(F.col("doc_id").alias("odd_id"), F.col("digest").alias("odd_digest"), stays.alias("stays")), "kept-odd")
    few = checked(odd, 32)
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("of_id"), F.xxhash64(filled(F.col("text"))).alias("of_digest"))
    same = (F.col("of_id") == F.col("odd_id")) & (F.col("of_digest") == F.col("odd_digest"))
    kept = rows.join(few, same, "left_anti").select("row")
    if odd.where("stays").count():
        repeats = rows.join(few.where("stays"), same).groupBy("of_id", "of_digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.unionByName(repeats.select("row"))
    return kept.select("row.*")
