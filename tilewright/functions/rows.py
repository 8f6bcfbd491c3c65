"""A frame's own columns, kept apart from working columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, whatever their names hold; working columns beside it cannot clash."""
    return F.struct(*[F.col(f"`{name.replace('`', '``')}`").alias(name) for name in df.columns])
