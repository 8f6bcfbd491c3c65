"""Exact quantiles of whole columns by radix selection: no task holds more than counts, whatever the number of rows.

A double's bits, with all of them flipped below zero and the first above, are ordered as numbers are. A round counts the
next ``DIGIT`` bits of the values that agree with what is known of a sought rank, and fixes those bits; as soon as few
values are left they are brought to the driver and sorted. Ranks of all columns go down together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 12
FEW = 1 << 18  # two megabytes of doubles for a rank


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of ``values``; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(bits: int) -> float:
    whole = bits & ~(1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([whole], np.uint64).view(np.float64)[0])


def _values(batch: pa.RecordBatch, column: str) -> np.ndarray:
    found = batch.column(column).drop_null().to_numpy(zero_copy_only=False)
    if np.isnan(found).any():
        raise ValueError(f"{column} holds values that are not numbers")
    return ordered_bits(found)


def _agrees(bits: np.ndarray, prefix: int, known: int) -> np.ndarray:
    return bits if not known else bits[bits >> np.uint64(64 - known) == np.uint64(prefix)]


def _counts(rows: DataFrame, sought: list[tuple[str, int]], known: int) -> dict[tuple[str, int], np.ndarray]:
    """For each column and prefix of ``known`` bits, how many values go on with each next digit."""
    wide = min(DIGIT, 64 - known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(sought), 1 << wide), np.int64)
        for batch in batches:
            bits = {c: _values(batch, c) for c in {c for c, _ in sought}}
            for k, (column, prefix) in enumerate(sought):
                mine = _agrees(bits[column], prefix, known)
                digits = (mine >> np.uint64(64 - known - wide)) & np.uint64((1 << wide) - 1)
                found[k] += np.bincount(digits.astype(np.int64), minlength=1 << wide)
        which, digit = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(digit, pa.int32()), pa.array(found[which, digit])], ["which", "digit", "n"])

    out = {key: np.zeros(1 << wide, np.int64) for key in sought}
    added = rows.mapInArrow(run, "which int, digit int, n long").groupBy("which", "digit").agg(F.sum("n").alias("n"))
    for r in added.collect():  # at most so many rows as a digit has values, for each rank sought
        out[sought[r.which]][r.digit] = r.n
    return out


def _remaining(rows: DataFrame, sought: list[tuple[str, int, int]]) -> dict[tuple[str, int, int], np.ndarray]:
    """The few values of each column that agree with a prefix of so many bits, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (column, prefix, known) in enumerate(sought):
                mine = _agrees(_values(batch, column), prefix, known)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), k, np.int32)), pa.array(mine.view(np.int64))], ["which", "bits"])

    found = rows.mapInArrow(run, "which int, bits long").toArrow()
    which, bits = found.column("which").to_numpy(), found.column("bits").to_numpy().view(np.uint64)
    return {key: np.sort(bits[which == k]) for k, key in enumerate(sought)}


def exact_quantiles(rows: DataFrame, shares: dict[str, Sequence[float]], few: int = FEW) -> dict[str, list[float | None]]:
    """The quantiles of each column at its ``shares``, interpolated between the two values beside a rank as ``percentile`` does.

    Nulls do not count; a column without values gives None; values that are not numbers are an error. ``rows`` is read
    once a round, so it should be a written table.
    """
    table = rows.select(*[F.col(c).cast("double").alias(c) for c in shares])
    size = table.agg(*[F.count(c).alias(c) for c in shares]).first().asDict()
    ranks = {}
    for column, wanted in shares.items():
        for share in wanted:
            if not 0 <= share <= 1:
                raise ValueError(f"a share must lie between 0 and 1, not {share}")
            at = (size[column] - 1) * share
            for rank in {math.floor(at), math.ceil(at)} if size[column] else ():
                ranks[column, rank] = (0, rank, size[column])  # prefix, rank among those that agree, their number
    known, value = 0, {}
    while ranks:
        small = {key: (key[0], at[0], known) for key, at in ranks.items() if at[2] <= few}
        if small:
            left = _remaining(table, sorted(set(small.values())))
            for key, sought in small.items():
                value[key] = _value(int(left[sought][ranks.pop(key)[1]]))
            continue
        wide = min(DIGIT, 64 - known)
        counted = _counts(table, sorted({(c, at[0]) for (c, _), at in ranks.items()}), known)
        for (column, rank), (prefix, offset, _) in list(ranks.items()):
            n = counted[column, prefix]
            digit = int(np.searchsorted(np.cumsum(n), offset, side="right"))
            ranks[column, rank] = (prefix << wide | digit, offset - int(n[:digit].sum()), int(n[digit]))
        known += wide
        if known == 64:
            value |= {key: _value(at[0]) for key, at in ranks.items()}
            break
    out: dict[str, list[float | None]] = {}
    for column, wanted in shares.items():
        out[column] = []
        for share in wanted:
            at = (size[column] - 1) * share
            low, high = math.floor(at), math.ceil(at)
            if not size[column]:
                out[column].append(None)
            elif low == high or value[column, low] == value[column, high]:
                out[column].append(value[column, low])
            else:
                out[column].append((high - at) * value[column, low] + (at - low) * value[column, high])
    return out
