"""Readers and writers of catalogs and artifacts: file inventories, scene pairs, embeddings, splits, gazetteers."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.digest import ordered_digest
from tilewright.scratch import remove_path
from tilewright.sources import commits

SCHEMA_VERSION = 1
# The band order of twelve-band scenes.
BANDS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12")
STAC = "id string, bbox array<double>, properties map<string,string>, assets map<string,struct<href:string,title:string>>"


class StaleCatalog(ValueError):
    """The files are not those a catalog was made from."""


def inventory(spark: SparkSession, root: str, pattern: str = "*.tif*") -> DataFrame:
    """``path, length, modified`` of files below ``root``: paths relative to it, times in nanoseconds; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = store.makeQualified(hadoop).toString().rstrip("/")
    relative = F.col("path").substr(F.lit(len(whole) + 2), F.length("path"))
    return files.select(relative.alias("path"), "length", (F.unix_micros("modificationTime") * 1000).alias("modified"))


def inventory_digest(files: DataFrame) -> DataFrame:
    """SHA-256 over ``path, NUL, size, NUL, time, LF`` of all files in order of path."""
    line = F.concat(F.col("path"), F.lit("\0"), F.col("length").cast("string"), F.lit("\0"), F.col("modified").cast("string"), F.lit("\n"))
    return ordered_digest(files, line, F.col("path"))


def read_stac(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """STAC items below ``root`` whose id matches ``pattern`` whole, with ``sequence_id`` and ``date`` from its groups.

    Other documents are passed over; no item at all, or two of one key, are errors.
    """
    items = spark.read.schema(STAC).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "stac.json").json(root)
    whole = f"^(?:{pattern})$"
    found = items.where(F.col("id").rlike(whole)).select(
        "*", F.regexp_extract("id", whole, 1).alias("sequence_id"), F.regexp_extract("id", whole, 2).alias("date"), F.input_file_name().alias("document")
    )
    if found.isEmpty():
        raise ValueError(f"no matching items below {root}")
    if not duplicate_keys(found, "sequence_id", "date").isEmpty():
        raise ValueError(f"items below {root} repeat a key")
    return found


def parsed_flag(value: Column, name: str, required: bool) -> Column:
    """A flag from text: true or false in any case, trimmed; null only where not ``required``; anything else is an error."""
    plain = F.lower(F.trim(value.cast("string")))
    wrong = F.raise_error(F.concat(F.lit(f"{name} must be true or false, not "), F.coalesce(value.cast("string"), F.lit("null")))).cast("boolean")
    none = wrong if required else F.lit(None).cast("boolean")
    return F.when(value.isNull(), none).when(plain == "true", True).when(plain == "false", False).otherwise(wrong)


def parsed_time(value: Column, token: Column) -> Column:
    """A time in UTC from ISO text, ``Z`` or an offset allowed, or else from a ``yyyy_MM_dd`` token."""
    return F.coalesce(F.try_to_timestamp(value), F.to_timestamp(token, "yyyy_MM_dd"))


def iso_time(ts: Column) -> Column:
    """A time as ISO text in UTC; null stays null."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def box_centre(box: Column) -> tuple[Column, Column]:
    """``latitude, longitude`` of the middle of a box (west, south, east, north); null for fewer than four numbers."""
    whole = F.size(box) >= 4
    at = lambda a, b: F.when(whole, (F.get(box, a) + F.get(box, b)) / 2)
    return at(1, 3), at(0, 2)


def safe_path(path: Column) -> Column:
    """A relative path that stays below its root; an absolute one or one with ``..`` is an error."""
    unsafe = path.rlike(r"^/|^[A-Za-z]:|^[A-Za-z][A-Za-z0-9+.-]*://|(?:^|[/\\])\.\.(?:\z|[/\\])")
    return F.when(unsafe, F.raise_error(F.concat(F.lit("unsafe path: "), path)).cast("string")).otherwise(path)


def scene_catalog(sources: DataFrame, labels: DataFrame, files: DataFrame, bands: tuple[str, ...] = BANDS, dataset: str = "scene") -> DataFrame:
    """Scenes from paired source and label items: ids, time, place, flags, resolved assets and what is missing.

    ``files(path)`` lists what is there, relative to the root like the assets' paths (``folder`` of the source item and
    the asset's ``href``). Sources and labels must pair one to one on sequence and date. Ids begin with ``dataset``.
    """
    href = lambda b: F.concat(F.col("folder"), F.lit("/"), F.try_element_at("assets", F.lit(b))["href"])
    hrefs = F.array(*[F.struct(F.lit(b).alias("band"), href(b).alias("path")) for b in bands])
    keys = ("sequence_id", "date")
    items = sources.select("bbox", F.try_element_at("properties", F.lit("datetime")).alias("told"), *keys, hrefs.alias("hrefs"))
    unlisted = F.transform(F.filter("hrefs", lambda one: one["path"].isNull()), lambda one: one["band"])
    listed = F.transform("hrefs", lambda one: F.struct(one["band"].alias("band"), safe_path(one["path"]).alias("path")))
    flags = labels.select(*keys, F.col("properties").alias("said"))
    latitude, longitude = box_centre(F.col("bbox"))
    scenes = pair_items(items.withColumns({"unlisted": unlisted, "assets": listed}), flags, *keys).select(
        F.concat_ws(":", F.lit(dataset), *keys).alias("tile_id"), *keys, "bbox",
        parsed_time(F.col("told"), F.col("date")).alias("timestamp"), latitude.alias("latitude"), longitude.alias("longitude"),
        parsed_flag(F.try_element_at("said", F.lit("FLOODING")), "FLOODING", True).alias("flooding"),
        parsed_flag(F.try_element_at("said", F.lit("FULL-DATA-COVERAGE")), "FULL-DATA-COVERAGE", False).alias("full_coverage"), "assets", "unlisted",
    )
    # Items pair one to one, so their assets need no join first; what is not there comes back by the keys that scenes are dealt by.
    each = items.select(*keys, F.explode("hrefs").alias("one")).where("one.path IS NOT NULL").select(*keys, "one.band", safe_path(F.col("one.path")).alias("path"))
    absent = each.join(files.select("path"), "path", "left_anti").groupBy(*keys).agg(F.collect_set("band").alias("absent"))
    lacks = F.concat("unlisted", F.coalesce("absent", F.array().cast("array<string>")))
    missing = F.array_intersect(F.array(*[F.lit(b) for b in bands]), lacks)
    met = scenes.join(absent, list(keys), "left").withColumn("missing_bands", missing)
    return with_status(met).select("tile_id", "sequence_id", "bbox", "timestamp", "latitude", "longitude", "flooding", "full_coverage", "assets", "missing_bands", "asset_status").orderBy("tile_id")


def stem_roles(files: DataFrame, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """``stem`` with a column of paths for each role, from ``files(path)`` laid out as ``.../role/stem.suffix``.

    A stem of the first role that lacks another required one is an error; a role's second file for a stem too.
    """
    role, stem = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    roles = (*required, *optional)
    found = files.select(role.alias("role"), stem.alias("stem"), "path").where(F.col("role").isin(*roles))
    if not duplicate_keys(found, "role", "stem").isEmpty():
        raise ValueError("a role has two files for one stem")
    wide = found.groupBy("stem").agg(*[F.max(F.when(F.col("role") == r, F.col("path"))).alias(r) for r in roles]).where(F.col(required[0]).isNotNull())
    lacking = wide.where(" OR ".join(f"`{r}` IS NULL" for r in required)).limit(3).collect()
    if lacking:
        raise ValueError(f"stems without all of {required}: {[r.stem for r in lacking]}")
    return wide


def write_catalog(records: DataFrame, path: str, about: dict[str, object]) -> None:
    """Tile records as Parquet with a header beside them; the header, written last and at once, is what makes the catalog.

    ``about`` holds dataset, source_fingerprint, bands and expected_shape. Paths must be relative and safe. An existing
    catalog is an error; what a write that broke off left behind is not.
    """
    spark = records.sparkSession
    safe = records.withColumn("relative_path", safe_path(F.col("relative_path")))
    if commits.exists(spark, f"{path}/header"):
        raise ValueError(f"{path}/header already exists")
    folder = commits.write_rows(safe, path, "records")
    header = {"type": "catalog", "schema_version": SCHEMA_VERSION, "records": folder, "tile_count": spark.read.parquet(f"{path}/{folder}").count(), **about}
    commits.commit_text(spark, f"{path}/header", json.dumps(header, sort_keys=True))


def read_catalog(spark: SparkSession, path: str, about: dict[str, object]) -> DataFrame:
    """The records of a catalog whose header agrees with ``about``; paths are checked again."""
    header = commits.read_named(spark, f"{path}/header")
    if header.get("type") != "catalog" or header.get("schema_version") != SCHEMA_VERSION:
        raise ValueError("not a catalog of this version")
    if header.get("dataset") != about.get("dataset"):
        raise ValueError(f"the catalog describes {header.get('dataset')}")
    for name, value in about.items():
        if header.get(name) != json.loads(json.dumps(value)):
            raise StaleCatalog(f"{name} differs from the catalog's")
    rows = spark.read.parquet(f"{path}/{header['records']}")
    if rows.count() != header["tile_count"]:
        raise ValueError("the catalog's records are not as many as its header says")
    return rows.withColumn("relative_path", safe_path(F.col("relative_path")))


def reuse_or_build(spark: SparkSession, path: str, about: dict[str, object], build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table cached under ``path`` if its manifest equals ``about`` and its rows are whole, else built anew; and whether it was there.

    A build has a folder of its own, which the manifest names; the manifest is swapped last. The build before stays for
    those who still read it, earlier ones go.
    """
    wanted = json.loads(json.dumps({"schema_version": SCHEMA_VERSION, **about}, sort_keys=True))
    manifest = commits.current(spark, f"{path}/manifest") or {}
    before = manifest.get("rows")
    if manifest == {**wanted, "rows": before, "count": manifest.get("count")}:
        try:
            rows = spark.read.parquet(f"{path}/{before}")
            if rows.count() == manifest["count"]:
                return rows, True
        except AnalysisException:
            pass  # the rows are gone: build
    folder = commits.write_rows(build(), path, "rows")
    rows = spark.read.parquet(f"{path}/{folder}")
    commits.commit_text(spark, f"{path}/manifest", json.dumps({**wanted, "rows": folder, "count": rows.count()}, sort_keys=True), overwrite=True)
    for old in commits.folders(spark, path, "rows-"):
        if old not in (folder, before):
            remove_path(spark, f"{path}/{old}")
    return rows, False


def gallery_records(ids: DataFrame, records: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """``records`` of the ids of a gallery; an id without a record, repeated, or outside ``expected`` is an error."""
    if not duplicate_keys(ids, "tile_id").isEmpty():
        raise ValueError("the gallery repeats an id")
    if expected is not None and not id_difference(ids, expected, "tile_id").isEmpty():
        raise ValueError("the gallery's ids are not those expected")
    return lookup(ids, records, "tile_id")


def lookup(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` for all ``ids``; a missing id is an error."""
    absent = ids.select(key).join(table.select(key), key, "left_anti").limit(3).collect()
    if absent:
        raise ValueError(f"unknown {key}: {sorted(str(r[0]) for r in absent)}")
    return table.join(ids.select(key).distinct(), key, "left_semi")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def pair_items(sources: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """Each source with its label; raises when a key repeats or one side lacks it, as a key with a null always does."""
    sides = ("source", "label")
    each = [rows.select(*keys, F.lit(k).alias("_side")) for k, rows in enumerate((sources, labels))]
    known = [F.count_if(F.col("_side") == k).alias(f"_{name}") for k, name in enumerate(sides)]
    met = each[0].unionByName(each[1]).groupBy(*keys).agg(*known)  # both sides meet once for all four questions
    unknown = F.lit(False)
    for key in keys:
        unknown |= F.col(key).isNull()
    asked = {}
    for name, other in (sides, sides[::-1]):
        asked[f"{name} items repeat a key"] = F.col(f"_{name}") > 1
        asked[f"{name} items lack a partner"] = (F.col(f"_{name}") > 0) & (unknown | (F.col(f"_{other}") == 0))
    found = met.agg(*[F.max(wrong) for wrong in asked.values()]).first()
    for said, wrong in zip(asked, found, strict=True):
        if wrong:
            raise ValueError(said)
    return sources.join(labels, list(keys))


def missing_bands(tiles: DataFrame, assets: DataFrame, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """``tiles`` with ``missing_bands`` and ``asset_status`` by what ``assets(tile_id, band)`` has."""
    have = assets.groupBy("tile_id").agg(F.collect_set("band").alias("have"))
    met = tiles.join(have, "tile_id", "left")
    lacking = F.array_except(F.array(*[F.lit(b) for b in bands]), F.coalesce("have", F.array().cast("array<string>")))
    return with_status(met.withColumn("missing_bands", lacking).drop("have"))


def with_status(scenes: DataFrame) -> DataFrame:
    """``asset_status`` by whether ``missing_bands`` is empty."""
    return scenes.withColumn("asset_status", F.when(F.size("missing_bands") == 0, "available").otherwise("missing"))


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids on one side only: ``key, side``."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("first"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("second"))
    return left.unionByName(right)


def check_embeddings(rows: DataFrame, tolerance: float = 2e-4) -> int:
    """The number of rows; raises unless ids are unique, vectors finite and of unit length, and one length holds for all.

    Where there is a column ``row`` it must count from 0; where there is ``split`` it must name one.
    """
    square = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    off = F.abs(F.sqrt(square) - 1) <= tolerance
    n = F.count("*")
    row = F.col("row") if "row" in rows.columns else F.lit(None).cast("long")
    split = F.col("split") if "split" in rows.columns else F.lit("train")
    found = rows.agg(
        n.alias("n"), F.count_distinct("tile_id").alias("ids"), F.count_distinct(F.size("embedding")).alias("lengths"),
        F.count_if(~F.coalesce(off, F.lit(False))).alias("off"), F.min(row).alias("low"), F.max(row).alias("high"), F.count_distinct(row).alias("places"),
        F.count_if(~F.coalesce(split.isin("train", "validation", "test"), F.lit(False))).alias("unsplit"),
    ).first()
    if found.n != found.ids or found.lengths > 1 or found.off or found.unsplit:
        raise ValueError(f"{found.n} rows, {found.ids} ids, {found.lengths} lengths, {found.off} vectors off unit length, {found.unsplit} without a split")
    if "row" in rows.columns and found.n and (found.low != 0 or found.high != found.n - 1 or found.places != found.n):
        raise ValueError("rows are not numbered from 0 without a gap")
    return found.n


def write_embeddings(rows: DataFrame, path: str, **about: object) -> None:
    """Checked embeddings as Parquet, with a manifest beside them; an existing artifact is an error.

    Rows are written once and checked as they lie there; only then does the manifest make them an artifact.
    """
    spark = rows.sparkSession
    if commits.exists(spark, f"{path}/manifest"):
        raise ValueError(f"{path}/manifest already exists")
    folder = commits.write_rows(rows, path, "rows")
    try:
        count = check_embeddings(spark.read.parquet(f"{path}/{folder}"))
    except ValueError:
        remove_path(spark, f"{path}/{folder}")
        raise
    commits.commit_text(spark, f"{path}/manifest", json.dumps({"schema_version": SCHEMA_VERSION, "count": count, "rows": folder, **about}, sort_keys=True))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """A written artifact, in order of ``row`` where it has one; raises when manifest and rows disagree or rows are not sound."""
    manifest = commits.read_named(spark, f"{path}/manifest")
    if manifest.get("schema_version") != SCHEMA_VERSION:
        raise ValueError("the artifact has another schema version")
    rows = spark.read.parquet(f"{path}/{manifest['rows']}")
    if check_embeddings(rows) != manifest["count"]:
        raise ValueError("the artifact's rows are not as many as its manifest says")
    return rows.orderBy("row") if "row" in rows.columns else rows


def write_splits(rows: DataFrame, path: str) -> None:
    """``tile_id, split`` (and ``group_id``, where there is one) in order of id as CSV, one file after another."""
    columns = ["tile_id", *(["group_id"] if "group_id" in rows.columns else []), "split"]
    rows.select(*columns).orderBy("tile_id").write.mode("errorifexists").csv(path, header=True)


def read_splits(spark: SparkSession, path: str, ids: DataFrame | None = None, grouped: bool = False) -> DataFrame:
    """A split manifest; ids stay strings. A repeated id, another split than the three, or a group in two splits is an error.

    With ``ids`` the manifest must name exactly those.
    """
    kind = "tile_id string, group_id string, split string" if grouped else "tile_id string, split string"
    rows = spark.read.schema(kind).csv(path, header=True, enforceSchema=False)
    if not duplicate_keys(rows, "tile_id").isEmpty():
        raise ValueError("the manifest repeats an id")
    if not rows.where("split NOT IN ('train', 'validation', 'test') OR split IS NULL").isEmpty():
        raise ValueError("the manifest names an unknown split")
    if grouped and not rows.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a group lies in two splits")
    if ids is not None and not id_difference(rows, ids, "tile_id").isEmpty():
        raise ValueError("the manifest's ids are not those of the table")
    return rows


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Gazetteer rows from (gzipped) JSON lines."""
    return spark.read.schema("place_id string, level string, name string, country string, aliases array<string>, geometry string").json(path)


def export_neighbours(ranked: DataFrame, tiles: DataFrame) -> DataFrame:
    """Ranked results with the labels of both sides and the score to eight places, ready for CSV.

    Where tiles have a ``timestamp`` or a ``sequence_id``, those of both sides follow as text, empty where there is none.
    """
    said = {"timestamp": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), "sequence_id": F.col("sequence_id").cast("string")}
    more = {name.removesuffix("_id"): F.coalesce(text, F.lit("")) for name, text in said.items() if name in tiles.columns}

    def side(of: str, key: str) -> DataFrame:
        return tiles.select(F.col("tile_id").alias(key), F.col("label").alias(f"{of}_label"), *[text.alias(f"{of}_{name}") for name, text in more.items()])

    met = ranked.join(side("query", "query_id"), "query_id").join(side("neighbour", "tile_id"), "tile_id")
    both = [f"{of}_{name}" for name in more for of in ("query", "neighbour")]
    return met.select("query_id", "query_label", "rank", "tile_id", "neighbour_label", F.format_string("%.8f", "score").alias("score"), *both)
