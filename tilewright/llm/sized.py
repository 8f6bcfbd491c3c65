"""Joins whose small side is broadcast only after a look at its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def checked(table: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``table``, a written one, marked for broadcast if its rows of ``row_bytes`` take at most ``most``.

    A larger table is left to a shuffled join; the rows of the join are the same.
    """
    return F.broadcast(table) if table.count() * row_bytes <= most else table
