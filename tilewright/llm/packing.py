r"""Lexical retrieval packing: windows filled with a seed document and its unused BM25 neighbours.

Terms are token ids, so what the corpus says of them is bounded by the vocabulary: how many documents hold each, and the
mean length, are counted over all documents and are the same for every shard of the index.

Documents are dealt to shards by what they say. A document's key is the least of its tokens under a fixed random order in
which rare tokens come early (weighted min-wise sampling by inverse document frequency), so two documents share a key
with the probability of their weighted overlap; its least token under a second order, in ``PARTS`` parts, splits the key.
Consecutive keys share a shard of about ``SHARD_TOKENS`` tokens; a part of a key with more is split evenly among shards of
its own, however many rows repeat one text. Each shard has its own inverted
index. A seed is laid into the window; while room is left, the unused document of the shard that scores best against the
seed follows (the next in order, if none shares a word that counts). A document that overflows is cut there and its rest
is the seed of the next window. No window is left with a gap: the tail of a shard is cut into pieces whose lengths are
powers of two, which need no padding. Tokens that more than ``COMMON`` of all documents hold are stop words: neither
indexed nor looked up.

Defined cases: null text is empty and yields the single end id; repeated rows are packed each; a null id is an id like
others; ties in score go to the earlier document in the order of id, then ids; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import filled
from tilewright.scratch import materialize

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1 << 20
SHARDS_A_TASK = 8
COMMON = 0.2
K1, B = 1.2, 0.75
PARTS = 16
SEED = 29
_TEXTS_AT_ONCE = 256
# Fixed value: the pattern by which byte-level BPE vocabularies of this kind split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary's file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[Callable[[str], list[int]], int]:
    """A function from a text to the ids of the vocabulary file ``path``, and the number of ids.

    Where ids stand in the order of merges, as ranks do, the quicker of the two tokenizer libraries gives the same ids.
    """
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model, split = said["model"], said.get("pre_tokenizer") or {}
    ids = model.get("vocab", {})
    numbers = ids.values() if isinstance(ids, dict) else range(len(ids))
    size = max([*numbers, *(x["id"] for x in said.get("added_tokens", []))], default=-1) + 1

    @lru_cache(maxsize=1)
    def plain() -> object:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    slow = lambda text: plain().encode(text, add_special_tokens=False).ids
    ranked = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and not said.get("normalizer")
    joined = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model.get("merges", [])]
    if not ranked or any(ids.get(word) != 256 + k for k, word in enumerate(joined)):
        return slow, size
    import tiktoken

    letters, special = _byte_letters(), {x["content"]: x["id"] for x in said.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in word): k for word, k in ids.items() if word not in special}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(word in text for word in special):  # an added token's string in a text is that token
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as error:  # its splitter gives up on some very long runs
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    return encode, size


def _kind(size: int) -> str:
    """The narrowest type that holds the ids."""
    return "<u2" if size <= 1 << 16 else "<u4"


@dataclass(frozen=True)
class Corpus:
    """What all shards share: documents by token, their number, their mean length, and the order that keys follow."""

    held: np.ndarray
    documents: int
    mean_length: float

    @property
    def idf(self) -> np.ndarray:
        """BM25's inverse document frequency; 0 for stop words and for tokens of a single document."""
        idf = np.log1p((self.documents - self.held + 0.5) / (self.held + 0.5))
        return np.where((self.held > max(1.0, COMMON * self.documents)) | (self.held < 2), 0.0, idf)

    @property
    def turns(self) -> np.ndarray:
        """The place of each token in the two orders of keys."""
        share = np.maximum(self.held, 1) / max(1, self.documents)
        weight = np.where(self.held < 2, 1e-6, np.maximum(1e-9, -np.log(np.minimum(share, 1.0))))
        drawn = np.random.default_rng(SEED).exponential(size=(2, len(weight)))
        return np.argsort(np.argsort(drawn / weight, axis=1, kind="stable"), axis=1, kind="stable")


def keys_of(docs: list[np.ndarray], turns: np.ndarray) -> np.ndarray:
    """The key of each document, with its part."""
    if not docs:
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])[:-1]))
    every = np.concatenate(docs)
    key, part = (np.minimum.reduceat(turn[every], starts) for turn in turns)
    return key * PARTS + part % PARTS


def shard_plan(mass: dict[int, int], keys: int, shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """By key, its first shard and how many shards it has, from the tokens under each key."""
    first, many = np.zeros(keys, np.int64), np.ones(keys, np.int64)
    shard, filled_up = 0, 0
    for key in sorted(mass):
        need = -(-mass[key] // shard_tokens)
        if filled_up and (need > 1 or filled_up + mass[key] > shard_tokens):
            shard, filled_up = shard + 1, 0
        first[key], many[key] = shard, need
        shard, filled_up = (shard + need, 0) if need > 1 else (shard, filled_up + mass[key])
    return first, many


class ShardIndex:
    """A BM25 inverted index over the documents of one shard, given as arrays of token ids."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = len(docs)
        long = np.array([len(d) for d in docs], float)
        every = np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64)
        counted = idf[every] > 0
        wide = len(idf)
        pairs = (np.repeat(np.arange(self.n), long.astype(np.int64)) * wide + every)[counted]
        keys, counts = np.unique(pairs, return_counts=True)
        owner, terms = keys // wide, keys % wide
        _, compact, df = np.unique(terms, return_inverse=True, return_counts=True)
        scale = K1 * (1 - B + B * long / max(1.0, mean_length))
        weight = idf[terms] * counts * (K1 + 1) / (counts + scale[owner])
        order = np.argsort(compact, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.starts = np.concatenate(([0], np.cumsum(df)))
        self.of_doc = np.split(compact, np.searchsorted(owner, np.arange(1, self.n))) if self.n else []

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document of the shard against the tokens of ``seed``."""
        terms = self.of_doc[seed]
        at, long = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        total = int(long.sum())
        where = np.arange(total) + np.repeat(at - (np.cumsum(long) - long), long)
        return np.bincount(self.owner[where], self.weight[where], self.n)


def fill_windows(lengths: list[int], index: ShardIndex, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` that hold every id of the shard once."""
    n = len(lengths)
    unused = np.ones(n, bool)
    placed: list[list[tuple[int, int, int]]] = [[]]
    room, following = window, 0
    scores: np.ndarray | None = None
    for _ in range(n):
        best = -1
        if scores is not None:
            best = int(scores.argmax())
            best = best if scores[best] > 0 else -1
        if best < 0:
            while not unused[following]:
                following += 1
            best = following
        unused[best] = False
        if scores is not None:
            scores[best] = 0
        start, rest, turned = 0, lengths[best], room == window
        while rest:
            take = min(rest, room)
            placed[-1].append((best, start, take))
            start, rest, room = start + take, rest - take, room - take
            if not room:
                placed.append([])
                room, turned = window, True
        if room == window:
            scores = None  # the next window begins with a document of its own
        elif turned or scores is None:
            scores = np.where(unused, index.scores(best), 0.0)
    out = []
    for number, pieces in enumerate(placed[:-1]):
        offset = 0
        for doc, start, long in pieces:
            out.append((doc, start, long, number, offset))
            offset += long
    tail, number = sum(p[2] for p in placed[-1]), len(placed) - 1
    sizes = [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
    queue = placed[-1][::-1]
    for size in sizes:
        offset = 0
        while offset < size:
            doc, start, long = queue.pop()
            take = min(long, size - offset)
            out.append((doc, start, take, number, offset))
            offset += take
            if take < long:
                queue.append((doc, start + take, long - take))
        number += 1
    return out


_TOKENIZED = "doc_id long, ids binary, tokens array<int>, held array<long>"


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``nth, doc_id, ids`` of each document, with rows of ``tokens, held`` beside them: documents by token, a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(vocabulary)
        names = ["doc_id", "ids", "tokens", "held"]
        kind, many, count = _kind(size), pa.list_(pa.int32()), pa.list_(pa.int64())
        held = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                part = batch.slice(at, _TEXTS_AT_ONCE)
                ids = []
                for text in part.column("text"):
                    found = np.array([*encode(text.as_py()), END_ID], kind)
                    held[np.unique(found)] += 1
                    ids.append(found.tobytes())
                rest = [pa.nulls(len(ids), many), pa.nulls(len(ids), count)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), *rest], names)
        some = np.flatnonzero(held)
        columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([some.astype(np.int32)], many), pa.array([held[some]], count)]
        yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text"))
    return materialize(texts.mapInArrow(run, _TOKENIZED).withColumn("nth", F.monotonically_increasing_id()), "token-ids")


def corpus_of(made: DataFrame, size: int) -> Corpus:
    """Statistics of all documents of ``made``; at most a row for each id of the vocabulary is collected."""
    apart = made.where("tokens IS NOT NULL").select(F.explode(F.arrays_zip("tokens", "held")).alias("one"))
    counts = apart.groupBy(F.col("one.tokens").alias("token")).agg(F.sum("one.held").alias("n")).collect()
    whole = made.where("ids IS NOT NULL").agg(F.count("*").alias("n"), F.sum(F.octet_length("ids")).alias("bytes")).first()
    held = np.zeros(size)
    for row in counts:
        held[row.token] = row.n
    return Corpus(held, whole["n"], (whole["bytes"] or 0) / np.dtype(_kind(size)).itemsize / max(1, whole["n"]))


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = True
) -> DataFrame:
    """Pieces of packed sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``vocabulary`` is the path of a tokenizer's file on the driver and the executors. With ``with_ids`` a piece also has
    ``ids``, its ids as little-endian 32-bit integers.
    """
    spark = docs.sparkSession
    size = encoder(vocabulary)[1]
    kind = _kind(size)
    made = tokenized(docs, vocabulary)
    corpus = corpus_of(made, size)
    turns, idf, mean_length = corpus.turns, corpus.idf, corpus.mean_length
    shared = spark.sparkContext.broadcast((turns, idf))  # three numbers for each id of the vocabulary
    rows = made.where("ids IS NOT NULL").select("nth", "doc_id", "ids")

    def read(ids: pa.Array) -> list[np.ndarray]:
        return [np.frombuffer(x.as_py(), kind) for x in ids]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(size * PARTS, np.int64)
        for batch in batches:
            ids = read(batch.column("ids"))
            np.add.at(mass, keys_of(ids, shared.value[0]), np.array([len(x) for x in ids], np.int64))
        some = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(mass[some])], ["key", "n"])

    weighed = rows.select("ids").mapInArrow(weigh, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    first, many = shard_plan({r.key: r.n for r in weighed.collect()}, size * PARTS, shard_tokens)
    plan = spark.sparkContext.broadcast((first, many))  # of the size of the vocabulary times PARTS

    @F.arrow_udf("long")
    def shard_of(ids: pa.Array, nth: pa.Array) -> pa.Array:
        (first, many), key = plan.value, keys_of(read(ids), shared.value[0])
        # Rows of a split key go round its shards; the rows of a task are numbered consecutively.
        return pa.array(first[key] + nth.to_numpy() % many[key])

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        held = sorted(
            zip(table.column("doc_id").to_pylist(), table.column("ids").to_pylist(), strict=True),
            key=lambda r: (r[0] is None, r[0] or 0, r[1]),
        )
        ids = [np.frombuffer(x, kind) for _, x in held]
        out = fill_windows([len(x) for x in ids], ShardIndex(ids, shared.value[1], mean_length), window)
        cuts = [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in out]
        columns = {
            "doc_id": pa.array([held[d][0] for d, *_ in out], pa.int64()),
            "start": pa.array([s for _, s, *_ in out], pa.int64()),
            "length": pa.array([n for _, _, n, *_ in out], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x) for x in cuts], pa.int64()),
            "doc_tokens": pa.array([len(ids[d]) for d, *_ in out], pa.int64()),
            "sequence_id": pa.array([(shard << 32) + q for *_, q, _ in out], pa.int64()),
            "offset": pa.array([o for *_, o in out], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array(cuts, pa.binary())
        return pa.table(columns)

    shards = int((first + many).max(initial=1))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_A_TASK))
    dealt = rows.select(shard_of("ids", "nth").alias("shard"), "doc_id", "ids").repartition(tasks, "shard")
    return dealt.groupBy("shard").applyInArrow(pack, _SCHEMA + (", ids binary" if with_ids else ""))
