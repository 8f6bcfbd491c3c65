"""One digest over many lines in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.order import one_stream


def ordered_digest(rows: DataFrame, line: Column, *order: Column) -> DataFrame:
    """``fingerprint``: SHA-256 over ``line`` of all rows in ``order``.

    The digest of one long text is sequential by its definition: one task sorts the lines, on disk where they are many, and
    reads them as a stream; it holds a batch of lines, never all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in batches:
            for one in batch.column("line"):
                digest.update(one.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["fingerprint"])

    keys = [o.alias(f"by{k}") for k, o in enumerate(order)]
    lines = one_stream(rows.select(line.cast("binary").alias("line"), *keys), *[f"by{k}" for k in range(len(order))])
    return lines.select("line").mapInArrow(run, "fingerprint string")
