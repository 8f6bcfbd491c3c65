"""Columns over text: words are maximal runs of characters other than ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def filled(text: Column) -> Column:
    """``text``, with null as the empty string."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(filled(text), SPACE_RUN, -1), "")


def word_count(text: Column) -> Column:
    """Number of words as a long; null has 0."""
    return F.size(words(text)).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    whole = filled(text)
    return (F.length(whole) - F.length(F.translate(whole, characters, ""))).cast("long")
