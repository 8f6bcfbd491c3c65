"""The request layer: a validated query, its predicates as columns, and place search."""

from __future__ import annotations

import datetime as dt
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The intents, place levels and modalities a query may name, and how long its texts may be.
INTENTS = (
    "flood", "no_flood", "visual_similarity",
    "spectral_water_signal", "spectral_water_increase", "spectral_water_decrease",
    "spectral_scene_similarity", "spectral_change_similarity", "unsupported",
)
LEVELS = ("country", "admin1")
MODALITIES = ("rgb", "s2_12band", "unspecified")
MOST = {"place_name": 120, "place_country": 120, "example_tile_id": 200, "unsupported_conditions": 8, "interpretation": 400, "original_query": 1000}


@dataclass(frozen=True)
class Query:
    """What is asked for; checked when made."""

    intent: str
    interpretation: str
    start_date: dt.date | None = None
    end_date: dt.date | None = None
    place_name: str | None = None
    place_level: str | None = None
    place_country: str | None = None
    requested_modality: str = "unspecified"
    example_tile_id: str | None = None
    unsupported_conditions: tuple[str, ...] = ()
    original_query: str = ""
    resolved_place_id: str | None = None

    def __post_init__(self) -> None:
        for ok, said in (
            (self.intent in INTENTS, f"intent must be one of {INTENTS}, not {self.intent!r}"),
            (self.requested_modality in MODALITIES, f"requested_modality must be one of {MODALITIES}, not {self.requested_modality!r}"),
            (self.place_level in (None, *LEVELS), f"place_level must be one of {LEVELS}, not {self.place_level!r}"),
            (not (self.start_date and self.end_date and self.end_date < self.start_date), f"end_date {self.end_date} lies before start_date {self.start_date}"),
            ((self.place_name is None) == (self.place_level is None), f"place_name {self.place_name!r} and place_level {self.place_level!r} must both be given, or neither"),
            (not self.place_country or self.place_level == "admin1", f"place_country {self.place_country!r} needs place_level admin1, not {self.place_level!r}"),
            (not self.resolved_place_id or self.place_name, f"resolved_place_id {self.resolved_place_id!r} needs a place_name"),
        ):
            if not ok:
                raise ValueError(said)
        for name, most in MOST.items():
            if len(getattr(self, name) or "") > most:
                raise ValueError(f"{name} must not be longer than {most} characters or items, and has {len(getattr(self, name))}")

    @classmethod
    def of(cls, values: dict) -> Query:
        """From a mapping, dates as dates or ISO text; unknown and missing keys are errors."""
        unknown = set(values) - {f.name for f in fields(cls)}
        lacking = {"intent", "interpretation"} - set(values)
        if unknown or lacking:
            raise ValueError(f"unknown fields {sorted(unknown)}, missing fields {sorted(lacking)}")
        given = dict(values)
        for name in ("start_date", "end_date"):
            if isinstance(given.get(name), str):
                given[name] = dt.date.fromisoformat(given[name])
        given["unsupported_conditions"] = tuple(given.get("unsupported_conditions") or ())
        return cls(**given)

    def require_supported(self) -> None:
        """Raise for what no retrieval path answers."""
        if self.intent == "unsupported" or self.unsupported_conditions:
            raise ValueError("nothing here answers: " + ", ".join(self.unsupported_conditions))
        if self.intent == "visual_similarity" and not self.example_tile_id:
            raise ValueError("visual_similarity needs an example tile")
        if self.place_name and not self.resolved_place_id:
            raise ValueError(f"place_name {self.place_name!r} has no resolved_place_id")

    def require_modality(self, modality: str) -> None:
        """Raise if another modality than a run's is asked for."""
        if self.requested_modality not in ("unspecified", modality):
            raise ValueError(f"{self.requested_modality} is wanted, but the run holds {modality}")


@dataclass(frozen=True)
class Request:
    """A query with a run and a depth; ``run_id`` may be absent on the spectral path."""

    query: Query
    run_id: str | None = None
    k: int = 10
    before_example_tile_id: str | None = None
    after_example_tile_id: str | None = None

    def __post_init__(self) -> None:
        if isinstance(self.k, bool) or not 1 <= self.k <= 30:
            raise ValueError(f"k must lie between 1 and 30, not {self.k!r}")
        if self.run_id is not None and not 1 <= len(self.run_id) <= 160:
            raise ValueError(f"run_id must have 1 to 160 characters, not {len(self.run_id)}")
        for name in (self.before_example_tile_id, self.after_example_tile_id):
            if len(name or "") > 200:
                raise ValueError("example ids must not be longer than 200")


def parse_text(text: str) -> str:
    """The text of a request to be parsed: 4 to 1000 characters."""
    if not 4 <= len(text) <= 1000:
        raise ValueError(f"a query has 4 to 1000 characters, not {len(text)}")
    return text


def within_dates(ts: Column, start: dt.date | None, end: dt.date | None, null_passes: bool) -> Column:
    """Inclusive days. A null time fails against a bound; without bounds it passes only if ``null_passes``."""
    out = F.lit(True) if null_passes else ts.isNotNull()
    if start:
        out = out & F.coalesce(ts >= F.lit(start), F.lit(False))
    if end:
        out = out & F.coalesce(ts < F.lit(end + dt.timedelta(days=1)), F.lit(False))
    return out


def boxes_meet(west: Column, south: Column, east: Column, north: Column, box: Sequence[float]) -> Column:
    """Whether a row's box meets ``box`` (west, south, east, north); either may cross the antimeridian; null fails."""
    w, s, e, n = (F.lit(float(v)) for v in box)

    def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
        return (a <= d) & (c <= b)

    def lon(a: Column, b: Column) -> Column:
        plain = overlap(a, b, w, e)
        split = overlap(a, b, w, F.lit(180.0)) | overlap(a, b, F.lit(-180.0), e)
        return split if box[0] > box[2] else plain

    crossing = lon(west, F.lit(180.0)) | lon(F.lit(-180.0), east)
    across = F.when(west > east, crossing).otherwise(lon(west, east))
    return F.coalesce(across & overlap(south, north, s, n), F.lit(False))


def ring_meets_box(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether the closed ``ring(x, y)`` and a plain box share a point: a vertex in the box, a corner in the ring, or edges that cross."""
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    inside = F.exists(ring, lambda p: p["x"].between(west, east) & p["y"].between(south, north))

    def passes(e: Column) -> Column:
        """Whether an edge crosses the ray that leaves the box's first corner to the east."""
        spans = (e["a"]["y"] > south) != (e["b"]["y"] > south)
        at = (e["b"]["x"] - e["a"]["x"]) * (south - e["a"]["y"]) / F.when(spans, e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
        return F.coalesce(spans & (west < at), F.lit(False))

    around = F.size(F.filter(edges, passes)) % 2 == 1

    def meets(e: Column) -> Column:
        """Whether an edge has a point in the box, by clipping its parameter to both slabs."""
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]

        def slab(start: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
            none = F.when(start.between(low, high), F.lit(0.0))  # a still coordinate lies in the slab or never
            one, two = (low - start) / F.nullif(step, F.lit(0.0)), (high - start) / F.nullif(step, F.lit(0.0))
            return F.when(step == 0, none).otherwise(F.least(one, two)), F.when(step == 0, none + 1).otherwise(F.greatest(one, two))

        (x0, x1), (y0, y1) = slab(e["a"]["x"], dx, west, east), slab(e["a"]["y"], dy, south, north)
        still = x0.isNull() | y0.isNull()
        return ~still & (F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0)))

    return F.coalesce(inside | around | F.exists(edges, meets), F.lit(False))


def ring_meets_bounds(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """``ring_meets_box`` for bounds that may cross the antimeridian (west beyond east): two boxes then."""
    split = ring_meets_box(ring, west, south, F.lit(180.0), north) | ring_meets_box(ring, F.lit(-180.0), south, east, north)
    return F.when(west > east, split).otherwise(ring_meets_box(ring, west, south, east, north))


def normalized_name(value: str | None) -> str:
    """Case folded, without combining marks, trimmed."""
    folded = unicodedata.normalize("NFKD", (value or "").casefold())
    return "".join(c for c in folded if not unicodedata.combining(c)).strip()


@F.pandas_udf(ArrayType(StringType()))
def normalized_names(names: pd.Series) -> pd.Series:
    return names.map(lambda row: [normalized_name(x) for x in row if x] if row is not None else [])


def find_places(places: DataFrame, name: str, level: str | None = None, country: str | None = None, limit: int = 10) -> DataFrame:
    """``place_id, name, level, country, score`` for ``places(place_id, level, name, country, aliases)``.

    Score 0 for an exact name or alias, 1 for a part of one. A country counts under any of its names.
    """
    needle = normalized_name(name)
    every = normalized_names(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    known = places.withColumn("names", every)
    hit = F.when(F.array_contains("names", needle), 0).when(F.exists("names", lambda x: x.contains(needle)), 1)
    found = known.where(F.lit(bool(needle))).withColumn("score", hit).where(F.col("score").isNotNull())
    if level:
        found = found.where(F.col("level") == level)
    if country:
        wanted = normalized_name(country)
        alike = known.where((F.col("level") == "country") & F.array_contains("names", wanted)).select(F.explode("names").alias("alike"))
        alike = alike.unionByName(places.sparkSession.createDataFrame([(wanted,)], "alike string")).distinct()
        own = found.withColumn("own", F.element_at(normalized_names(F.array(F.coalesce("country", F.lit(" ")))), 1))
        found = own.join(alike, F.col("own") == F.col("alike"), "left_semi")
    order = ["score", "name", F.coalesce("country", F.lit("")), "place_id"]
    return found.select("place_id", "name", "level", "country", "score").orderBy(*order).limit(max(1, min(limit, 20)))


def find_tiles(tiles: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Tiles whose normalized id holds the normalized ``text``, in order of id; ``limit`` lies between 1 and 200."""
    name = F.element_at(normalized_names(F.array("tile_id")), 1)
    return tiles.where(name.contains(normalized_name(text))).orderBy("tile_id").limit(max(1, min(limit, 200)))
