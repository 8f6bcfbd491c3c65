"""Columns over file names and nested metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_of(name: Column) -> Column:
    """What stands before the first underscore."""
    return F.substring_index(name, "_", 1)


def stem_of(path: Column) -> Column:
    """A path's last part without its last suffix."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.rlike(r"^.+\.[^.]+$"), F.regexp_replace(last, r"\.[^.]+$", "")).otherwise(last)


def suffix_of(path: Column) -> Column:
    """A path's last suffix in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def typed_json(text: Column, schema: str) -> Column:
    """A JSON object read as ``schema``; text that is no such object is an error, null stays null."""
    found = F.from_json(text, schema)
    bad = F.raise_error(F.concat(F.lit("not an object of the expected form: "), text)).cast(schema)
    shaped = F.coalesce(F.get_json_object(text, "$").startswith("{"), F.lit(False))
    return F.when(text.isNull(), F.lit(None).cast(schema)).when(shaped & found.isNotNull(), found).otherwise(bad)
