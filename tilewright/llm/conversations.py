r"""Repair of conversations by a dynamic programme over all of them at once.

The roles of a well-formed conversation read ``(s?(ua)+)?`` by their initials: a system turn perhaps, then user and
assistant in turn. A row may be kept, given the role that is due, or deleted; an empty turn of the role that is due may be
inserted anywhere. Blank rows and rows that repeat an earlier role and text must go; a row that ends without ``.``, ``!`` or
``?`` costs extra while it stays. The audit names the cheapest edits by their initials, ties to the least in ASCII.

Four states tell what has been built so far, and in each but one role is due. Costs are a tensor ``[turn, conversation,
state]``: conversations are put in buckets of like length, a step updates the costs of all in a bucket from those of the
turn after, and the stored costs then lead all of them from the first turn to the last together. From a state an edit's
initial fixes the next state, so taking the least initial among those that keep the cost gives the least audit.

A conversation of any length is cut into segments of at most ``SEGMENT`` rows. Where there are several, a segment's costs
are taken from every state to every state (four times four numbers); these are folded from the last segment back, traces
from each state are folded forward, and every segment is traced from its own first state. So a task holds segments, never
a conversation. Digests of whole texts are sequential: the rows of a conversation pass through a task in order as a stream.

Defined cases: null roles and texts read as one space, and so do null ids and turns in the damage's key; a role whose
initial is none of ``s``, ``u``, ``a`` (or that is empty) is never kept as it is; rows of one turn are in the order of role
and text; a null id is a conversation of its own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tilewright.functions.order import placed_within
from tilewright.functions.text import WORD
from tilewright.scratch import materialize

SEGMENT = 4096
KEEP, RELABEL, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # what edits cost, and what a truncated row that stays costs besides
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
# States: nothing yet, after a system turn, after a user's, after an assistant's.
DUE = ("user", "user", "assistant", "user")
AFTER_DUE = np.array([2, 2, 3, 2])
AFTER_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # by state and initial: s, u, a, other
END = np.array([0, 2 * INSERT, INSERT, 0])  # what is still due when rows end
_FAR = 1 << 40
_D, _I, _K, _R = (ord(c) for c in "DIKR")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after a damage that a checksum of id and turn chooses."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    hurt = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)))
    return hurt.drop("col")


def with_faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``place`` and the ``number`` of their initial, written, and ``(conv_id, place, in_group, code)``.

    A code is four times the number of the initial, plus the first fault.
    """
    placed = placed_within(rows.select("conv_id", "turn", "role", "text"), F.col("conv_id"), F.col("turn"), ties=("role", "text"))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    own = F.when(~F.col("text").rlike(WORD), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(0)
    digest = F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text"), 256)
    known = materialize(placed.select("*", number.alias("number"), own.alias("own"), digest.alias("digest")), "turns")
    first = known.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    first = first.select(F.col("conv_id").alias("of_conv"), F.col("digest").alias("of_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("digest") == F.col("of_digest"))
    told = known.select("conv_id", "place", "in_group", "number", "own", "digest").join(first, same, "left")
    fault = F.when((F.col("own") != BLANK) & (F.col("place") > F.col("first")), DUPLICATE).otherwise(F.col("own"))
    return known, told.select("conv_id", "place", "in_group", (F.col("number") * 4 + fault).alias("code"))


def segments(told: DataFrame, length: int) -> DataFrame:
    """``conv_id, segment, last, codes``: the codes of at most ``length`` rows of a conversation, in order."""
    nth = F.floor((F.col("place") - 1) / length)
    grouped = told.groupBy("conv_id", nth.alias("segment")).agg(F.max("in_group").alias("n"), F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))
    return grouped.select("conv_id", "segment", (F.col("segment") == F.floor((F.col("n") - 1) / length)).alias("last"), F.transform("rows", lambda r: r["code"]).alias("codes"))


def costs(codes: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``[turn, conversation, state]``: the least cost from there on, given the costs beyond the last row.

    ``codes`` is ``[turn, conversation]``; beyond a conversation's length its costs are those of its end.
    """
    turns, many = codes.shape
    out = np.empty((turns + 1, many, 4), np.int64)
    out[turns] = end
    every = np.arange(many)[:, None]
    for t in range(turns - 1, -1, -1):
        after, code = out[t + 1], codes[t]
        stays = np.where(code % 4 == TRUNCATED, CUT, np.where(code % 4 == 0, 0, _FAR))[:, None]
        to = AFTER_KEPT[:, code // 4].T
        kept = np.where(to >= 0, after[every, to], _FAR) + KEEP + stays
        least = np.minimum(np.minimum(DELETE + after, kept), RELABEL + stays + after[:, AFTER_DUE])
        one, two = least[:, 2], least[:, 3]
        least[:, 2], least[:, 3] = np.minimum(one, INSERT + two), np.minimum(two, INSERT + one)
        least[:, :2] = np.minimum(least[:, :2], INSERT + least[:, 2:3])
        out[t] = np.where((t < length)[:, None], least, after)
    return out


def trace(codes: np.ndarray, length: np.ndarray, cost: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The least audit of each conversation from its state ``start``, and the state it ends in; what is due is added only after a ``last`` row."""
    turns, many = codes.shape
    letters = np.zeros((3 * turns + 2, many), np.uint8)
    state, every = start.copy(), np.arange(many)
    for t in range(turns):
        code = codes[t]
        stays = np.where(code % 4 == TRUNCATED, CUT, np.where(code % 4 == 0, 0, _FAR))
        open_ = t < length
        for step in range(3):
            now, due = cost[t, every, state], AFTER_DUE[state]
            to = AFTER_KEPT[state, code // 4]
            drop = open_ & (now == DELETE + cost[t + 1, every, state])
            put = open_ & ~drop & (now == INSERT + cost[t, every, due])
            keep = open_ & ~drop & ~put & (to >= 0) & (now == KEEP + stays + cost[t + 1, every, to])
            turn = open_ & ~drop & ~put & ~keep
            letters[3 * t + step] = np.select([drop, put, keep, turn], [_D, _I, _K, _R], 0)
            state = np.where(keep, to, np.where(put | turn, due, state))
            open_ = put
    for step in range(2):
        put = last & (END[state] > 0)
        letters[3 * turns + step] = np.where(put, _I, 0)
        state = np.where(put, AFTER_DUE[state], state)
    return [column[column > 0].tobytes().decode() for column in letters.T], state


def _bucketed(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """``work(batch, codes, length)`` for the rows of each batch whose lengths have the same power of two, turns first."""
    for batch in batches:
        lists = batch.column("codes")
        length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        bucket = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
        for size in np.unique(bucket):
            chosen = np.flatnonzero(bucket == size)
            for at in range(0, len(chosen), max(1, (1 << 16) >> size)):  # so many numbers at a time
                some = pa.array(chosen[at : at + max(1, (1 << 16) >> size)])
                part = batch.take(some)
                n = length[some.to_numpy()]
                codes = np.zeros((int(n.max(initial=0)), len(n)), np.int64)
                inside = np.arange(len(codes))[:, None] < n
                codes.T[inside.T] = part.column("codes").flatten().to_numpy(zero_copy_only=False)
                yield work(part, codes, n)


def _columns(batch: pa.RecordBatch, names: list[str], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *more.values()], [*names, *more])


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.int64()))


def _states(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)


def scripts(parts: DataFrame) -> DataFrame:
    """``conv_id, segment, audit, start, cost`` of every segment of ``parts(conv_id, segment, last, codes)``."""
    kind = dict(parts.dtypes)["conv_id"]
    alone = parts.where("last AND segment = 0")
    several = materialize(parts.where("NOT (last AND segment = 0)"), "segments")

    def done(part: pa.RecordBatch, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        start, end = part.column("start").to_numpy(zero_copy_only=False), _states(part.column("end"))
        cost = costs(codes, n, end)
        audit, state = trace(codes, n, cost, start, part.column("last").to_numpy(zero_copy_only=False))
        after = np.where(part.column("last").to_numpy(zero_copy_only=False), 0, end[np.arange(len(n)), state])
        own = cost[0, np.arange(len(n)), start] - after
        return _columns(part, ["conv_id", "segment"], audit=pa.array(audit), start=part.column("start"), cost=pa.array(own))

    def traced(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda b: _bucketed(b, done), f"conv_id {kind}, segment long, audit string, start long, cost long")

    ends = F.array(*[F.lit(int(x)).cast("long") for x in END])
    out = traced(alone.withColumns({"end": ends, "start": F.lit(0).cast("long")}))
    if several.isEmpty():
        return out

    def matrix(part: pa.RecordBatch, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        found = np.empty((len(n), 4, 4), np.int64)
        for z in range(4):
            end = np.full((len(n), 4), _FAR)
            end[:, z] = 0
            found[:, :, z] = costs(codes, n, end)[0]
        return _columns(part, ["conv_id", "segment"], costs=_lists(found.reshape(-1, 16)))

    def back(rows: pd.DataFrame) -> pd.DataFrame:
        """The costs beyond each segment, from the last one to the first."""
        rows = rows.sort_values("segment", ascending=False)
        beyond, ends = END.astype(np.int64), []
        for m in rows["costs"]:
            ends.append(beyond)
            beyond = (np.asarray(m).reshape(4, 4) + beyond).min(axis=1)
        return rows[["conv_id", "segment"]].assign(end=ends)

    def leads(part: pa.RecordBatch, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        cost = costs(codes, n, _states(part.column("end")))
        no = np.zeros(len(n), bool)
        to = np.stack([trace(codes, n, cost, np.full(len(n), z), no)[1] for z in range(4)], axis=1)
        return _columns(part, ["conv_id", "segment"], to=_lists(to))

    def forth(rows: pd.DataFrame) -> pd.DataFrame:
        """The state that each segment starts in, from the first one to the last."""
        rows = rows.sort_values("segment")
        state, starts = 0, []
        for to in rows["to"]:
            starts.append(state)
            state = int(to[state])
        return rows[["conv_id", "segment"]].assign(start=starts)

    def with_part(rows: DataFrame, more: DataFrame) -> DataFrame:
        more = more.withColumnsRenamed({"conv_id": "of_conv", "segment": "of_segment"})
        return rows.join(more, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("segment") == F.col("of_segment"))).drop("of_conv", "of_segment")

    folded = several.mapInArrow(lambda b: _bucketed(b, matrix), f"conv_id {kind}, segment long, costs array<long>")
    ended = with_part(several, folded.groupBy("conv_id").applyInPandas(back, f"conv_id {kind}, segment long, end array<long>"))
    ended = materialize(ended, "segment-ends")
    led = ended.mapInArrow(lambda b: _bucketed(b, leads), f"conv_id {kind}, segment long, to array<long>")
    started = with_part(ended, led.groupBy("conv_id").applyInPandas(forth, f"conv_id {kind}, segment long, start long"))
    return out.unionByName(traced(started))


_STREAM = "place long, kind int, turn long, role string, text string, code int, audit string, start long, cost long"


def _stream(conversations: DataFrame, known: DataFrame, told: DataFrame, script: DataFrame, length: int) -> DataFrame:
    """One frame sorted by conversation and place: an opening row, then each segment's script before its rows."""
    names = ["conv_id", *[x.split()[0] for x in _STREAM.split(", ")]]
    kinds = dict(x.split() for x in _STREAM.split(", "))

    def shaped(df: DataFrame, kind: int, **given: Column) -> DataFrame:
        given["kind"] = F.lit(kind)
        return df.select("conv_id", *[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names[1:]])

    opening = shaped(conversations.select("conv_id").distinct(), 0, place=F.lit(0))
    plans = shaped(script, 1, place=F.col("segment") * length + 1, **{c: F.col(c) for c in ("audit", "start", "cost")})
    rows = shaped(known, 2, **{c: F.col(c) for c in ("place", "turn", "role", "text")}, code=F.col("number"))
    whole = opening.unionByName(plans).unionByName(rows)
    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")


class _Walk:
    """A conversation while its rows pass by."""

    def __init__(self) -> None:
        self.turns, self.first, self.latest, self.illegal, self.cost = 0, None, None, 0, 0
        self.before: int | None = None
        self.audit: list[str] = []
        self.left, self.at, self.state = "", 0, 0

    def plan(self, audit: str, start: int, cost: int) -> list[tuple[str, str]]:
        """A segment's script; what the one before still adds comes out."""
        out = self.inserted()
        self.audit.append(audit)
        self.left, self.at, self.state = audit, 0, start
        self.cost += cost
        return out

    def inserted(self) -> list[tuple[str, str]]:
        out = []
        while self.at < len(self.left) and self.left[self.at] == "I":
            out.append((DUE[self.state], ""))
            self.state = int(AFTER_DUE[self.state])
            self.at += 1
        return out

    def row(self, turn: int | None, role: str, text: str, number: int) -> list[tuple[str, str]]:
        """What stands in place of a row: inserted turns and the row itself, unless it is deleted."""
        if turn is not None and turn != self.latest:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.latest = turn
        if self.before is not None:
            self.illegal += (self.before, number) not in ((0, 1), (1, 2), (2, 1))
        self.before = number
        out = self.inserted()
        letter = self.left[self.at]
        self.at += 1
        if letter == "K":
            out.append((role, text))
            self.state = int(AFTER_KEPT[self.state, number])
        elif letter == "R":
            out.append((DUE[self.state], text))
            self.state = int(AFTER_DUE[self.state])
        return out

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.latest - self.first + 1 - self.turns


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, _Walk, list[tuple[str, str]], bool]]:
    """``conv_id, walk, turns that come out, whether it ends`` as rows pass."""
    walk, now = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv, _, kind, turn, role, text, number, audit, start, cost in zip(*columns, strict=True):
            if kind == 0:
                if walk is not None:
                    yield now, walk, walk.inserted(), True
                walk, now = _Walk(), conv
            elif kind == 1:
                yield now, walk, walk.plan(audit, start, cost), False
            else:
                yield now, walk, walk.row(turn, role, text, number), False
    if walk is not None:
        yield now, walk, walk.inserted(), True


def _sorted_stream(conversations: DataFrame, rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    known, told = with_faults(rows)
    told = materialize(told, "turn-codes")
    return _stream(conversations, known, told, scripts(segments(told, length)), length), told


def repaired_turns(conversations: DataFrame, rows: DataFrame, length: int = SEGMENT) -> DataFrame:
    """``conv_id, place, role, text``: the repaired turns of ``rows(conv_id, turn, role, text)``, which are those of ``conversations``."""
    stream, _ = _sorted_stream(conversations, rows, length)
    kind, conv_type = dict(stream.dtypes)["conv_id"], to_arrow_type(stream.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = 0, []
        for conv, _, turns, ends in _walked(batches):
            for role, text in turns:
                place += 1
                held.append((conv, place, role, text))
            place = 0 if ends else place
            if len(held) >= 1024:
                yield _rows(held, conv_type)
                held = []
        yield _rows(held, conv_type)

    return stream.mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def _rows(held: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], conv), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["conv_id", "place", "role", "text"])


def repair(conversations: DataFrame, rows: DataFrame, length: int = SEGMENT) -> DataFrame:
    """A row for each id of ``conversations``: the faults of its ``rows(conv_id, turn, role, text)``, the cheapest edits, a digest of what they give."""
    stream, told = _sorted_stream(conversations, rows, length)
    kind, conv_type = dict(stream.dtypes)["conv_id"], to_arrow_type(stream.schema["conv_id"].dataType)
    names = ["conv_id", "gaps", "illegal", "cost", "audit", "repaired_sha256"]

    def told_of(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [[]] * len(names)
        types = [conv_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, some, held = hashlib.sha256(), False, []
        for conv, walk, turns, ends in _walked(batches):
            for role, text in turns:
                digest.update(("\n" if some else "").encode() + f"{role}:{text}".encode())
                some = True
            if ends:
                held.append((conv, walk.gaps, walk.illegal, walk.cost, "".join(walk.audit), digest.hexdigest()))
                digest, some = hashlib.sha256(), False
            if len(held) >= 1024:
                yield told_of(held)
                held = []
        yield told_of(held)

    report = stream.mapInArrow(run, f"conv_id {kind}, gaps long, illegal long, cost long, audit string, repaired_sha256 string")
    faults = told.groupBy("conv_id").agg(*[F.count_if(F.col("code") % 4 == k).alias(c) for k, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))])
    faults = faults.withColumnRenamed("conv_id", "of_conv")
    met = report.join(faults, F.col("conv_id").eqNullSafe(F.col("of_conv")), "left")
    of = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return met.select("conv_id", "gaps", of("blank"), of("duplicate"), of("truncated"), "illegal", "cost", "audit", "repaired_sha256")
