r"""Language-model scores by online logistic context mixing.

A text is a sequence of tokens and an end. The ``SYMBOLS`` most frequent tokens, the end and an escape are written in a
Huffman code; a rarer token follows its escape byte by byte in a code of bytes. Each bit is predicted by several tables of
counts under hashed contexts (the place in the code with none, one or two tokens
before it, or with the last but one alone; inside a spelled token, with the one to three bytes before it, or with the last
byte and the token before). The predictions are added in the logistic domain with weights chosen by a gate (how often the
contexts were seen, and what is being spelled), and the sum is refined by adaptive tables of how such sums turned out.

Learning covers every training document in one pass. Each task predicts a block from the counts before it, corrects the
weights and the refinement by the errors, and counts the block once it is read. Texts are cut into tokens by Arrow. Tasks follow from the size of the input. Counts of
all tasks are summed slot by slot where they meet, in a stream; weights are averaged by the bits they saw. A predictor has
as many slots as there are training tokens, in powers of two from ``LEAST_SLOT_BITS`` to ``MOST_SLOT_BITS``; the upper
end is what fits into a task's memory, and contexts of a larger corpus share slots. The finished model is thereby bounded
(with ``SYMBOLS``), so it is broadcast.

What has no bound stays in tables that scoring joins. Token counts: only those of the model's own symbols travel with it.
Runs: a text is cut where a hash of three tokens says so, in runs of about ``RUN`` tokens, and the runs of all training
documents are counted. One more predictor says that a run of the corpus follows, in proportion to its count without the
document's own; it is mixed with the bits' product by the share of runs that occur elsewhere, as learned from training.

Defined cases: null text is empty and has the end alone; a null id counts as the empty text for the choice of training
documents; repeated rows are learned from and scored each; without training documents every bit has probability a half;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.scratch import materialize

SYMBOLS = 131_072
LEAST_SLOT_BITS = 21
MOST_SLOT_BITS = 22  # 134 MB of counts in each task
PREDICTORS = 4
RUN = 32
TASK_BYTES = 64 << 20  # of training text in a task
BLOCK_TOKENS = 4_000
BATCH = 16_384
GATES = 2 * 4 * 4 * 3
RUNGS = 33
LANES = 4
_FLUSH = 400_000
_HELD_TOKENS = 4 << 20  # whose counts are made at once
_CHUNK = 1 << 15
_END, _ESCAPE = 0, 1  # symbols before those of tokens
_START = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Code:
    """A prefix code: for each symbol a run of ``nodes`` (inner nodes passed) and ``bits`` taken there."""

    starts: np.ndarray
    lengths: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    @cached_property
    def steps(self) -> np.ndarray:
        """By place in the runs: the node, how deep it lies in three grades, and the bit, in one number, so one look-up gives all."""
        depth = np.arange(len(self.nodes)) - np.repeat(self.starts, self.lengths)
        return self.nodes << np.uint32(3) | np.minimum(depth // 4, 2).astype(np.uint32) << np.uint32(1) | self.bits

    def spell(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every bit of ``symbols``: whose it is, the node, the bit, and the grade of its depth."""
        long = self.lengths[symbols]
        whose = np.repeat(np.arange(len(symbols)), long)
        at = np.arange(len(whose))
        at += np.take(self.starts[symbols] - np.cumsum(long) + long, whose, mode="clip")
        step = np.take(self.steps, at, mode="clip") if len(at) else np.zeros(0, np.uint32)
        return whose, step >> np.uint32(3), (step & np.uint32(1)).astype(np.uint8), step >> np.uint32(1) & np.uint32(3)


def huffman(counts: list[int]) -> Code:
    """The Huffman code of symbols 0, 1, ...; ties go to the earlier symbol."""
    heap = [(max(1, c), k, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    up, side, serial = {}, {}, len(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], side[x], up[y], side[y] = serial, 0, serial, 1
        heapq.heappush(heap, (a + b, serial, serial))
        serial += 1
    starts, lengths, nodes, bits = [], [], [], []
    for k in range(len(counts)):
        path, node = [], k
        while node in up:
            path.append((up[node], side[node]))
            node = up[node]
        starts.append(len(nodes))
        lengths.append(len(path))
        nodes.extend(p[0] for p in reversed(path))
        bits.extend(p[1] for p in reversed(path))
    return Code(np.array(starts), np.array(lengths), np.array(nodes, np.uint32), np.array(bits, np.uint8))


@dataclass(frozen=True)
class Vocabulary:
    """What all tasks share: token numbers, both codes, and the counts the base score needs."""

    number: dict[bytes, int]
    words: Code
    letters: Code
    counts: np.ndarray  # by symbol; the escape has none
    total: int
    distinct: int
    slot_bits: int = LEAST_SLOT_BITS  # of each predictor

    @property
    def slots(self) -> int:
        return 1 << self.slot_bits

    @cached_property
    def tokens(self) -> pa.Array:
        """Tokens in the order of their numbers."""
        return pa.array(list(self.number), pa.binary())


def slot_bits(n_tokens: int) -> int:
    """The power of two that gives every training token a slot of its own, within bounds."""
    return min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, (n_tokens - 1).bit_length()))


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint32)
    for nth, part in enumerate(parts):
        out = (out ^ (part + np.uint32(0x9E3779B9 + 0x61C88647 * nth & 0xFFFFFFFF))) * np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(15)
    return out


def _before(values: np.ndarray, apart: int, first: np.ndarray) -> np.ndarray:
    """The value ``apart`` places earlier, or the start mark where that is before the sequence's first."""
    out = np.full(len(values), _START, np.uint32)
    out[apart:] = values[:-apart] if apart else values
    place = np.arange(len(values)) - first
    out[place < apart] = _START
    return out


@dataclass
class Events:
    """Bits to predict: slots of each predictor, the bit, part of its gate, whose symbol's it is, and the places of the symbols."""

    slots: list[np.ndarray]
    bits: np.ndarray
    kind: np.ndarray
    whose: np.ndarray
    places: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The token of each bit, by its place in the group; never falls."""
        return self.places[self.whose]


def _events(code: Code, symbols: np.ndarray, contexts: list[np.ndarray | None], places: np.ndarray, kind: int, slot_bits: int) -> Events:
    whose, node, bit, grade = code.spell(symbols)
    spread = node * np.uint32(0x9E3779B1)
    slots = []
    for nth, context in enumerate(contexts):
        if context is None:  # the place in the code alone: its number is its slot, beside the others of its kind
            slots.append((node & np.uint32((1 << slot_bits) - 1)).astype(np.int64))
            continue
        key = context[whose]
        key ^= spread
        key *= np.uint32(0xC2B2AE35)
        key ^= key >> np.uint32(13)
        key *= np.uint32(0x27D4EB2F)
        key >>= np.uint32(32 - slot_bits)
        slot = key.astype(np.int64)
        slot += nth << slot_bits
        slots.append(slot)
    gate = grade.astype(np.int64)
    gate += kind * 3
    gate *= 16
    return Events(slots, bit, gate, whose, places)


def numbered(vocabulary: Vocabulary, tokens: pa.Array) -> np.ndarray:
    """The symbol of each token."""
    place = pc.fill_null(pc.index_in(tokens, value_set=vocabulary.tokens), _ESCAPE - 2)
    return (place.to_numpy(zero_copy_only=False) + 2).astype(np.uint32)


def blocks_of(vocabulary: Vocabulary, texts: list[list[bytes]]) -> Iterator[Events]:
    """Events of the documents in ``texts`` (lists of tokens), a bounded number of tokens at a time."""
    tokens = pa.array([w for t in texts for w in t], pa.binary())
    yield from _blocks(vocabulary, tokens, np.array([len(t) for t in texts], np.int64), numbered(vocabulary, tokens))


def _blocks(vocabulary: Vocabulary, tokens: pa.Array, lengths: np.ndarray, own: np.ndarray) -> Iterator[Events]:
    """Events of documents whose ``tokens`` (of numbers ``own``) follow one another, ``lengths`` of them in each."""
    n = len(own) + len(lengths)
    if not n:
        return
    start = np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    place_of = np.arange(n)
    here = np.arange(len(own)) + np.repeat(np.arange(len(lengths)), lengths)  # each document before has an end
    symbol = np.full(n, _END, np.uint32)
    symbol[here] = own
    one, two = _before(symbol, 1, start), _before(symbol, 2, start)
    contexts = [None, _mix(one), _mix(one, two), _mix(np.full(n, 7, np.uint32), two)]
    for at in range(0, n, BLOCK_TOKENS):
        cut = slice(at, at + BLOCK_TOKENS)
        yield _events(vocabulary.words, symbol[cut], [c if c is None else c[cut] for c in contexts], place_of[cut], 0, vocabulary.slot_bits)
    rare = np.flatnonzero(own == _ESCAPE)
    if not len(rare):
        return
    words, at_rare = _as_bytes(tokens.take(pa.array(rare))), here[rare]
    wide = np.fromiter(map(len, words), np.int64, len(words)) + 1
    edges = np.flatnonzero(np.diff((np.cumsum(wide) - 1) // (2 * BLOCK_TOKENS))) + 1
    for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(rare)], strict=True):
        joined = b" ".join(words[begin:end]) + b" "
        letters = np.frombuffer(joined, np.uint8).astype(np.uint32)
        long = wide[begin:end]
        first = np.repeat(np.cumsum(long) - long, long)
        place = np.repeat(at_rare[begin:end], long)
        b1, b2, b3 = (_before(letters, d, first) for d in (1, 2, 3))
        mark = np.full(len(letters), 0xB17E, np.uint32)
        spelling = [_mix(mark, b1), _mix(mark, b1, b2), _mix(mark, b1, b2, b3), _mix(mark, b1, one[place])]
        yield _events(vocabulary.letters, letters, spelling, place, 1, vocabulary.slot_bits)


def _stretched(none: np.ndarray, some: np.ndarray) -> np.ndarray:
    return np.log((some.astype(np.float32) + np.float32(0.4)) / (none.astype(np.float32) + np.float32(0.4)))


def _seen(n: np.ndarray) -> np.ndarray:
    """How often a context was seen, in four grades."""
    return (n > 0).view(np.uint8) + (n > 2).view(np.uint8) + (n > 15).view(np.uint8)


def _rung(x: np.ndarray) -> np.ndarray:
    x = x * np.float32(2)
    x += np.float32((RUNGS - 1) / 2)
    np.rint(x, out=x)
    np.maximum(x, np.float32(0), out=x)
    return np.minimum(x, np.float32(RUNGS - 1), out=x).astype(np.int64)


def _chance(x: np.ndarray) -> np.ndarray:
    """The logistic function."""
    x = np.exp(-x)
    x += np.float32(1)
    return np.divide(np.float32(1), x, out=x)


class Held:
    """Arrays that one block leaves for the next, so their memory is asked for once."""

    def __init__(self) -> None:
        self.arrays: dict[str, np.ndarray] = {}

    def __call__(self, name: str, size: int, kind: type) -> np.ndarray:
        if name not in self.arrays or len(self.arrays[name]) < size:
            self.arrays[name] = np.empty(size + size // 4, kind)
        return self.arrays[name][:size]


class Learner:
    """Counts, mixing weights and refinement of one task, adapted as it reads."""

    def __init__(self, slots: int) -> None:
        self.counts = np.zeros(2 * PREDICTORS * slots, "<i4")
        self.pairs = self.counts.view("<i8")
        self.held = Held()
        self.lanes = np.arange(BATCH) % LANES
        self.weights = np.full((GATES, PREDICTORS + 1), 0.3, np.float32)
        self.weights[:, -1] = 0
        self.turned = np.zeros((GATES, RUNGS, 2), np.int64)
        self.seen = np.zeros(GATES, np.int64)

    def count(self, events: Events) -> None:
        """Add the block to the counts."""
        for slot in events.slots:
            np.add.at(self.pairs, slot, self._added(events))

    def _added(self, events: Events) -> np.ndarray:
        """What each bit adds to its pair of counts."""
        return np.take(np.array([1, 1 << 32]), events.bits, mode="clip")

    def adapt(self, events: Events, counting: bool = False) -> None:
        """Predict the block from what was counted before it, and learn from the errors.

        With ``counting`` the block is counted too, each predictor as soon as it is read, while its slots are in cache.
        """
        size, grades = len(events.bits), []
        inputs, both, n = self.held("inputs", PREDICTORS * size, np.float32).reshape(PREDICTORS, size), self.held("both", size, np.int64), self.held("n", 2 * size, np.float32)
        none, some, sums = n[0::2], n[1::2], self.held("sums", size, np.float32)
        added = self._added(events) if counting else None
        for k, slot in enumerate(events.slots):
            np.take(self.pairs, slot, out=both, mode="clip")  # two 32-bit counts fetched as one
            if counting:
                np.add.at(self.pairs, slot, added)
            n[:] = both.view("<i4")
            if k in (1, 2):
                grades.append(_seen(np.add(none, some, out=sums)))
            n += np.float32(0.4)
            np.divide(some, none, out=inputs[k])
            np.log(inputs[k], out=inputs[k])
        gate = events.kind + (4 * grades[0] + grades[1])
        for at in range(0, size, BATCH):
            x, g, b = inputs[:, at : at + BATCH], gate[at : at + BATCH], events.bits[at : at + BATCH]
            total, part, wide = (self.held(name, len(b), kind) for name, kind in (("total", np.float32), ("part", np.float32), ("wide", float)))
            _mixed(self.weights, x, g, total, part)
            lane = self.lanes[: len(b)] + LANES * g
            n_bits = _by_gate(lane, None)
            off = np.subtract(b, _chance(total), dtype=np.float32)
            for k in range(PREDICTORS + 1):
                wide[:] = np.multiply(off, x[k], out=part) if k < PREDICTORS else off
                self.weights[:, k] += 0.4 * _by_gate(lane, wide) / (n_bits + 20)
            cell = _rung(total)
            g *= RUNGS
            cell += g
            cell += cell
            cell += b
            self.turned += np.bincount(cell, minlength=self.turned.size).reshape(self.turned.shape)
            self.seen += n_bits


def _mixed(weights: np.ndarray, x: np.ndarray | list[np.ndarray], gate: np.ndarray, total: np.ndarray, part: np.ndarray) -> None:
    """The weighed sum of the predictions ``x`` into ``total``, by each bit's gate."""
    weights = np.ascontiguousarray(weights.T)
    np.take(weights[PREDICTORS], gate, out=total, mode="clip")
    for k in range(PREDICTORS):
        np.take(weights[k], gate, out=part, mode="clip")
        part *= x[k]
        total += part


def _by_gate(lane: np.ndarray, values: np.ndarray | None) -> np.ndarray:
    """Sums by gate; several lanes of each gate in turn, as sums into one place would wait for each other."""
    return np.bincount(lane, values, GATES * LANES).reshape(GATES, LANES).sum(axis=1)


@dataclass(frozen=True)
class Model:
    """The finished mixture; of the size of the predictors' slots."""

    stretched: np.ndarray  # 16-bit numbers, whose two lowest bits tell how often the slot was seen: one look-up gives both
    weights: np.ndarray
    refined: np.ndarray

    def log2(self, events: Events) -> np.ndarray:
        """The base-2 logarithm of each bit's probability."""
        found = [np.take(self.stretched, slot, mode="clip") for slot in events.slots]
        seen = [found[k].view(np.uint16) & np.uint16(3) for k in (1, 2)]
        gate = events.kind + (4 * seen[0] + seen[1])
        total, part = np.empty((2, len(gate)), np.float32)
        _mixed(self.weights, [x.astype(np.float32) for x in found], gate, total, part)
        cell = _rung(total)
        cell += gate * RUNGS
        p = _chance(total)
        p += np.take(self.refined.ravel(), cell, mode="clip")
        p *= np.float32(0.5)
        p -= 1 - events.bits  # of a zero: less one, and the sign taken off
        np.abs(p, out=p)
        np.clip(p, np.float32(1e-5), np.float32(1 - 1e-5), out=p)
        return np.log2(p, out=p)


def _marked(none: np.ndarray, some: np.ndarray) -> np.ndarray:
    """A slot of the finished model: its prediction, with the grade of how often it was seen in the two lowest bits."""
    number = _stretched(none, some).astype("<f2").view("<u2")
    return ((number & np.uint16(0xFFFC)) | _seen(none + some).astype(np.uint16)).view("<f2")


def _tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _groups(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows a few at a time, by the size of their texts."""
    for batch in batches:
        wide = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.flatnonzero(np.diff(np.cumsum(wide) // most_bytes)) + 1
        for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(wide)], strict=True):
            if end > begin:
                yield batch.slice(begin, end - begin)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all ``texts`` one after another, and how many each text has."""
    plain = pc.fill_null(texts, b"")
    plain = plain.view(pa.large_string() if pa.types.is_large_binary(plain.type) else pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    tokens, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(tokens), 0)  # white space at either end of a text leaves an empty one
    ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    tokens = tokens.filter(full)
    tokens = tokens.view(pa.large_binary() if pa.types.is_large_string(tokens.type) else pa.binary()).cast(pa.binary())
    return tokens, np.diff(ends[np.concatenate(([0], np.cumsum(n, dtype=np.int64)))])


def _as_bytes(tokens: pa.Array) -> list[bytes]:
    return tokens.to_numpy(zero_copy_only=False).tolist()


def runs_of(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of a text (with its end) begin, and a hash of each.

    A run begins with the text and after every three tokens whose hash is a multiple of ``RUN``.
    """
    starts, hashes, _ = _runs(pa.array(tokens, pa.binary()), np.array([len(tokens)]))
    return starts, hashes


def _runs(tokens: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of several texts whose ``tokens`` follow one another, and how many each text has; an end is counted as a place."""
    n, ends = len(tokens) + len(lengths), np.cumsum(lengths + 1) - 1
    firsts = ends - lengths
    here = np.arange(len(tokens)) + np.repeat(np.arange(len(lengths)), lengths)
    one = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        own = np.fromiter(map(zlib.crc32, _as_bytes(tokens)), np.uint64, len(tokens))
        own += np.uint64(1)
        own *= np.uint64(0x9E3779B97F4A7C15)
        own ^= own >> np.uint64(29)
        one[here] = own
        three = one.copy()
        three[1:] += one[:-1] * np.uint64(0x632BE59BD9B4E019)
        three[2:] += one[:-2] * np.uint64(0xD6E8FEB86659FD93)
        cut = (three ^ (three >> np.uint64(32))) % np.uint64(RUN) == 0
        cut[ends] = False
        cut[firsts] = False
        cut[np.minimum(firsts + 1, ends)] = False
        begins = np.zeros(n, bool)
        begins[1:] = cut[:-1]
        begins[firsts] = True
        starts = np.flatnonzero(begins)
        place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        # Each place of a run has a factor of its own, so the sum tells orders apart.
        factor = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        factor ^= factor >> np.uint64(31)
        factor |= np.uint64(1)
        factor *= one
        hashes = np.add.reduceat(factor, starts) if n else np.zeros(0, np.uint64)
        times = np.diff(np.searchsorted(starts, np.append(firsts, n)))
        hashes[np.cumsum(times) - 1] += np.uint64(1)  # the end is part of the last run
    return starts, hashes.view(np.int64), times


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens with their counts, and runs with theirs (``token`` is null there)."""
    tokens: list[pa.Array] = []
    runs: list[np.ndarray] = []
    names, n_tokens, n_runs = ["token", "run", "n"], 0, 0

    def out() -> Iterator[pa.RecordBatch]:
        found = pc.value_counts(pa.chunked_array(tokens, pa.binary()))
        for part in found.chunks if isinstance(found, pa.ChunkedArray) else [found]:
            yield pa.RecordBatch.from_arrays([part.field("values"), pa.nulls(len(part), pa.int64()), part.field("counts")], names)

    def out_runs() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *runs]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.binary()), pa.array(found), pa.array(n.astype(np.int64))], names)

    for group in _groups(batches):
        some, lengths = _split(group.column("text"))
        tokens.append(some)
        n_tokens += len(some)
        runs.append(_runs(some, lengths)[1])
        n_runs += len(runs[-1])
        if n_tokens > _HELD_TOKENS:
            yield from out()
            tokens.clear()
            n_tokens = 0
        if n_runs > _FLUSH:
            yield out_runs()
            runs.clear()
            n_runs = 0
    yield from out()
    yield out_runs()


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def held_out_id(doc_id: int | None) -> bool:
    """``held_out`` of one id."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def corpus_counts(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``token, n`` and ``run, n_runs`` over all training texts, written once."""
    partial = _plain(training).mapInArrow(_count_tokens, "token binary, run long, n long")
    summed = materialize(partial.groupBy("token", "run").agg(F.sum("n").alias("n")), "corpus-counts")
    runs = summed.where("run IS NOT NULL").select("run", F.col("n").alias("n_runs"))
    return summed.where("token IS NOT NULL").select("token", "n"), runs


def build_vocabulary(counts: DataFrame, n_documents: int, most: int = SYMBOLS) -> Vocabulary:
    """Symbols for all tokens that are at least as frequent as the level at which ``most`` would be passed.

    Levels are steps of the logarithm of the count; their sizes (at most a thousand numbers) say where to stop, and only
    tokens above it are collected. A token seen once is no symbol: such tokens teach the escape and the spelling, and
    their share stands for that of tokens never seen.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()
    total, distinct = sum(r.n for r in sizes), sum(r.k for r in sizes)
    room, least = most, None
    for row in sorted(sizes, key=lambda r: -r.level):
        room -= row.k
        if room < 0 or row.level == 0:  # level 0 is a count of 1
            break
        least = row.level
    chosen = counts.where(level >= least).collect() if least is not None else []
    chosen.sort(key=lambda r: (-r.n, bytes(r.token)))
    letters = Counter({k: 1 for k in range(256)})
    for row in chosen:
        letters.update(bytes(row.token))
        letters[0x20] += 1
    known = [n_documents, 0, *(r.n for r in chosen)]
    shares = [n_documents, total - sum(r.n for r in chosen), *known[2:]]
    return Vocabulary(
        {bytes(r.token): k + 2 for k, r in enumerate(chosen)},
        huffman(shares),
        huffman([letters[k] for k in range(256)]),
        np.array(known, float),
        total + n_documents,
        distinct + (n_documents > 0),
        slot_bits(total + n_documents),
    )


def _packed(counts: np.ndarray) -> bytes:
    """32-bit counts compressed byte plane by byte plane; the upper planes are nearly empty."""
    return zlib.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of equal chunks summed, in a stream sorted by chunk; each becomes its part of the model."""
    names = ["chunk", "stretched"]

    def out(chunk: int, counts: np.ndarray) -> pa.RecordBatch:
        value = _marked(counts[0::2], counts[1::2]).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([value], pa.binary())], names)

    at, held = None, None
    for batch in batches:
        for chunk, data in zip(batch.column("chunk"), batch.column("counts"), strict=True):
            if chunk.as_py() != at:
                if at is not None:
                    yield out(at, held)
                at, held = chunk.as_py(), np.zeros(2 * _CHUNK, np.int64)
            held += _unpacked(data.as_py())
    if at is not None:
        yield out(at, held)


def train(training: DataFrame, vocabulary: Vocabulary, tasks: int | None = None) -> Model:
    """Learn from every row of ``training`` in ``tasks`` tasks (one for about ``TASK_BYTES`` of text)."""
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    slots = vocabulary.slots
    if tasks is None:
        tasks = math.ceil((training.agg(F.sum(F.octet_length("text"))).first()[0] or 1) / TASK_BYTES)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, any_row = Learner(slots), False
        for group in _groups(batches):
            any_row = True
            tokens, lengths = _split(group.column("text"))
            for events in _blocks(shared.value, tokens, lengths, numbered(shared.value, tokens)):
                learner.adapt(events, counting=True)
        if not any_row:
            return
        names = ["chunk", "counts"]
        for k in range(0, PREDICTORS * slots // _CHUNK):
            part = learner.counts[2 * k * _CHUNK : 2 * (k + 1) * _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(part)], pa.binary())], names)
        weighed = (learner.weights.astype(float) * learner.seen[:, None]).tobytes()
        rest = weighed + learner.seen.astype(float).tobytes() + learner.turned.astype(float).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([rest], pa.binary())], names)

    learned = materialize(_plain(training).coalesce(tasks).mapInArrow(learn, "chunk int, counts binary"), "model-parts")
    stretched = np.zeros(PREDICTORS * slots, np.float16)
    parts = learned.where("chunk >= 0").repartition(64, "chunk").sortWithinPartitions("chunk")
    for row in parts.mapInArrow(_merged, "chunk int, stretched binary").toLocalIterator():
        cut = slice(row.chunk * _CHUNK, (row.chunk + 1) * _CHUNK)
        stretched[cut] = np.frombuffer(row.stretched, np.float16)
    wide = GATES * (PREDICTORS + 1)
    sums = np.zeros(wide + GATES + GATES * RUNGS * 2)
    for row in learned.where("chunk = -1").toLocalIterator():
        sums += np.frombuffer(row.counts, float)
    seen = sums[wide : wide + GATES]
    weights = sums[:wide].reshape(GATES, -1) / np.maximum(seen, 1)[:, None]
    weights[seen == 0, :PREDICTORS] = 0.3
    turned = sums[wide + GATES :].reshape(GATES, RUNGS, 2)
    level = 1 / (1 + np.exp(-(np.arange(RUNGS) - (RUNGS - 1) / 2) / 2))
    refined = (turned[:, :, 1] + 16 * level) / (turned.sum(axis=2) + 16)
    return Model(stretched, weights.astype(np.float32), refined.astype(np.float32))


def _times(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often each hash occurs in its document; a training document's own runs are left out of what it is told."""
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    n = np.diff(np.append(np.flatnonzero(new), len(order)))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(n, n)
    return out


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    """``values`` cut into lists of ``lengths``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values)


_SCORED = (
    "doc_id long, n_tokens long, n_bytes long, known long, base double, rare array<struct<token:binary,n:long>>, "
    "runs array<struct<run:long,bits:double,own:long>>"
)


def score(docs: DataFrame) -> DataFrame:
    """Scores of every document.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.
    """
    spark = docs.sparkSession
    training = docs.where(~held_out(F.col("doc_id")))
    counts, runs = corpus_counts(training)
    vocabulary = build_vocabulary(counts, training.count())
    model = train(training, vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, model))
    smooth = np.log10(vocabulary.total + vocabulary.distinct + 1.0)
    n_end = int(vocabulary.counts[_END] > 0)
    told = runs.agg(F.sum("n_runs").alias("all"), F.sum(F.when(F.col("n_runs") > 1, F.col("n_runs"))).alias("again")).first()
    n_runs = told["all"] or 0
    share = ((told["again"] or 0) + 0.5) / (n_runs + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        spelled = np.log10(vocabulary.counts + 1) - smooth
        for group in _groups(batches):
            tokens, lengths = _split(group.column("text"))
            own = numbered(vocabulary, tokens)
            bits = np.zeros(len(own) + len(lengths))  # by token and end
            for events in _blocks(vocabulary, tokens, lengths, own):
                owner = events.owner
                if len(owner):
                    bits[owner[0] : owner[-1] + 1] -= np.bincount(owner - owner[0], model.log2(events))
            doc = np.repeat(np.arange(len(lengths)), lengths)
            listed = own != _ESCAPE
            known = np.bincount(doc[listed], minlength=len(lengths)) + n_end
            base = np.bincount(doc[listed], spelled[own[listed]], len(lengths)) + spelled[_END]
            n_rare = np.bincount(doc[~listed], minlength=len(lengths))
            rare = pa.StructArray.from_arrays([tokens.filter(pa.array(~listed)), pa.array(np.ones(n_rare.sum(), np.int64))], ["token", "n"])
            starts, hashes, n_runs = _runs(tokens, lengths)
            sums = np.add.reduceat(bits, starts)
            held = np.array([held_out_id(k) for k in group.column("doc_id").to_pylist()], bool)
            own_runs = np.where(np.repeat(held, n_runs), 0, _times(np.repeat(np.arange(len(lengths)), n_runs), hashes))
            cuts = pa.StructArray.from_arrays([pa.array(hashes), pa.array(sums), pa.array(own_runs)], ["run", "bits", "own"])
            columns = [
                group.column("doc_id"), pa.array(lengths + 1), pc.fill_null(pc.binary_length(group.column("text")), 0).cast(pa.int64()),
                pa.array(known), pa.array(base), _lists(n_rare, rare), _lists(n_runs, cuts),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_bytes", "known", "base", "rare", "runs"])

    scored = _plain(docs).mapInArrow(run, _SCORED).withColumn("nth", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    apart = scored.select("nth", F.explode("rare").alias("one")).select("nth", F.col("one.token").alias("seek"), F.col("one.n").alias("times"))
    looked = apart.join(counts, apart["seek"] == counts["token"], "left")
    found = looked.groupBy("nth").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - F.lit(float(smooth)))).alias("rare_base"),
    )
    found = found.withColumnRenamed("nth", "of")
    cut = scored.select("nth", F.explode("runs").alias("one")).select("nth", F.col("one.run").alias("sought"), "one.bits", "one.own")
    elsewhere = F.coalesce("n_runs", F.lit(0)) - F.col("own")
    spelt = F.log2(F.lit(1 - share)) - F.col("bits")
    copied = F.log2(F.lit(float(share)) * elsewhere / F.lit(float(max(1, n_runs))))
    high, low = F.greatest(spelt, copied), F.least(spelt, copied)
    cost = F.when(elsewhere > 0, -high - F.log2(F.lit(1.0) + F.pow(F.lit(2.0), low - high))).otherwise(-spelt)
    costs = cut.join(runs, F.col("sought") == F.col("run"), "left").groupBy(F.col("nth").alias("costs_of")).agg(F.sum(cost).alias("bits"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = scored.drop("rare", "runs").join(found, F.col("nth") == F.col("of"), "left").join(costs, F.col("nth") == F.col("costs_of"), "left")
    return whole.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + zero("rare_known")).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (-zero("bits") * F.lit(float(np.log10(2)))).alias("score"),
        (zero("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
