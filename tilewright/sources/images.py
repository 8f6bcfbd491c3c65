"""Pictures and annotation masks: decoded by Spark's own image source on the executors, joined by stem into pixels and labels.

Eight bits a channel. A file that cannot be decoded is an error that names it, and so is one of sixteen bits, of which the
image source would keep the lower half.

Spark's file sources list what they read in the driver, so one read holds a record of every picture there. Many pictures are
therefore kept in shares, folders of some hundred tiles whole with all their roles, and read a few shares at a time.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.scratch import fresh_path
from tilewright.sources.commits import folders
from tilewright.sources.readers import ANOMALIES

ROLES = {"rgb": "images/rgb", "nir": "images/nir", "field": "masks", "boundary": "boundaries"}
SHARE, TILES_A_SHARE, SHARES_A_ROUND = "share-", 1000, 4
LISTINGS_KEPT = "spark.sql.hive.filesourcePartitionFileCacheSize"
_CELLS = "stem string, row int, col int"


def read_images(spark: SparkSession, root: str | list[str], check_depth: bool = True) -> DataFrame:
    """``path, stem, folder, height, width, channels, data`` of all pictures below ``root``, one folder or several; ``data`` holds rows of blue, green, red."""
    if check_depth:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root)
        deep = files.where(F.hex(F.substring("content", 25, 1)) == "10").select("path").limit(3).collect()
        if deep:
            raise ValueError(f"pictures of sixteen bits a channel: {[r.path for r in deep]}")
    read = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root).select("image.*", "_metadata.file_path")
    data = F.when(F.col("height") > 0, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("could not decode "), F.col("origin"))).cast("binary"))
    # The folder is told by the file's path alone, so Spark opens no file that a filter on it, or on the role, leaves out.
    below = F.substring_index("origin", "/", -1)
    folder = F.regexp_replace(F.col("file_path"), r"/[^/]*$", "")
    return read.select(F.col("origin").alias("path"), F.regexp_replace(below, r"\.[^.]*$", "").alias("stem"), folder.alias("folder"), "height", "width", F.col("nChannels").alias("channels"), data.alias("data"))


def image_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """``[rows, columns, channels]``: gray, or red, green, blue and perhaps opacity."""
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return image if channels == 1 else image[:, :, [2, 1, 0, 3][:channels]]


def with_roles(images: DataFrame, categories: tuple[str, ...] = ANOMALIES) -> DataFrame:
    """``images`` with ``role``: rgb, nir, field, boundary or a category, by the folder; others are left out, a role's second file for a stem is an error."""
    known = {**ROLES, **{c: f"labels/{c}" for c in categories}}
    role = F.coalesce(*[F.when(F.col("folder").endswith(f"/{where}"), F.lit(name)) for name, where in known.items()])
    return images.withColumn("role", role).where("role IS NOT NULL")


def share_of(tile: Column, tiles: int) -> Column:
    """The share of a tile's pictures, a folder, where there are ``tiles`` in all."""
    return F.format_string(f"{SHARE}%05d", F.pmod(F.xxhash64(tile), F.lit(max(1, -(-tiles // TILES_A_SHARE)))))


def over_shares(spark: SparkSession, root: str, roles: tuple[str, ...], found: Callable[[DataFrame], DataFrame], categories: tuple[str, ...] = ANOMALIES) -> DataFrame:
    """``found`` of the pictures of ``roles`` in all shares below ``root``, a few shares at a time, as one scratch table.

    ``found`` takes pictures ``with_roles`` and joins no tile to another, as a tile lies in one share. Every share holds every
    role. Only folders of ``roles`` are listed, by tasks where a round has many; a root without shares is read at once.
    """
    where = {**ROLES, **{c: f"labels/{c}" for c in categories}}
    named, out = folders(spark, root, SHARE), fresh_path(spark, "shares")
    rounds = [[f"{root}/{share}/{where[r]}" for share in named[at : at + SHARES_A_ROUND] for r in roles] for at in range(0, len(named), SHARES_A_ROUND)]
    size = spark.conf.get(LISTINGS_KEPT)
    spark.conf.set(LISTINGS_KEPT, "0")  # else the driver keeps up to 250 MB of earlier rounds' listings
    try:
        for paths in rounds or [[root]]:
            rows = found(with_roles(read_images(spark, paths), categories))
            rows.write.mode("append").parquet(out)
            schema = rows.schema
            del rows
            gc.collect()  # frames lie in cycles, and each keeps its round's files listed in the JVM
    finally:
        spark.conf.set(LISTINGS_KEPT, size)
    return spark.read.schema(schema).parquet(out)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks as bits, set where any channel is: an eighth of their bytes, or less, is shuffled. Of a picture only its size is kept."""
    for batch in batches:
        bits = []
        for role, data, height, width, channels in zip(*[batch.column(c).to_pylist() for c in ("role", "data", "height", "width", "channels")], strict=True):
            bits.append(None if role == "rgb" else np.packbits(np.frombuffer(data, np.uint8).reshape(height * width, channels).any(axis=1)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("stem"), batch.column("role"), batch.column("height"), batch.column("width"), pa.array(bits, pa.binary())], ["stem", "role", "height", "width", "bits"])


def mask_labels(images: DataFrame, categories: tuple[str, ...] = ANOMALIES) -> DataFrame:
    """``stem, labels`` of pictures ``with_roles``: the categories with a pixel set inside field and boundary, in their order.

    A stem with a picture but without one of its masks, with two of one, or with masks of unlike size is an error: an absent
    mask is no negative example.
    """
    needed = ("field", "boundary", *categories)
    wanted = images.where(F.col("role").isin("rgb", *needed)).select("stem", "role", "height", "width", "channels", "data")
    bits = wanted.mapInArrow(_packed, "stem string, role string, height int, width int, bits binary")  # every file is decoded once

    def present(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        stem, role = key[0].as_py(), table.column("role").to_pylist()
        none = pa.table({"stem": pa.array([], pa.string()), "labels": pa.array([], pa.list_(pa.string()))})
        if "rgb" not in role:
            return none
        lacking = [c for c in needed if c not in role]
        if lacking or len(set(role)) < len(role):
            raise ValueError(f"tile {stem} lacks the masks {lacking}" if lacking else f"tile {stem} has two files of one role")
        if len(set(zip(table.column("height").to_pylist(), table.column("width").to_pylist(), strict=True))) > 1:
            raise ValueError(f"tile {stem} has pictures of unlike size")
        of = {r: np.frombuffer(b, np.uint8) for r, b in zip(role, table.column("bits").to_pylist(), strict=True) if b is not None}
        inside = of["field"] & of["boundary"]
        found = [c for c in categories if (of[c] & inside).any()]
        return pa.table({"stem": pa.array([stem]), "labels": pa.array([found], pa.list_(pa.string()))})

    return bits.groupBy("stem").applyInArrow(present, "stem string, labels array<string>")


def image_pixels(images: DataFrame, nir: bool = True) -> DataFrame:
    """``stem, row, col, r, g, b`` and with ``nir`` also ``nir``, from pictures ``with_roles``.

    A tile without its near infrared picture, or of another size than it, is an error.
    """
    names = ["r", "g", "b", *(["nir"] if nir else [])]
    wanted = images.where(F.col("role").isin("rgb", *(["nir"] if nir else []))).select("stem", "role", "height", "width", "channels", "data")

    def stacked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        stem, of = key[0].as_py(), {}
        for role, *rest in zip(*[table.column(c).to_pylist() for c in ("role", "data", "height", "width", "channels")], strict=True):
            if role in of:
                raise ValueError(f"tile {stem} has two files of one role")
            of[role] = image_array(*rest)
        if "rgb" not in of:
            none = {"stem": pa.array([], pa.string()), **{c: pa.array([], pa.int32()) for c in ("row", "col", *names)}}
            return pa.table(none)
        if nir and "nir" not in of:
            raise ValueError(f"no near infrared picture matches the tile {stem}")
        rgb = of["rgb"] if of["rgb"].shape[2] > 1 else np.repeat(of["rgb"], 3, axis=2)
        planes = [rgb[:, :, k] for k in range(3)] + ([of["nir"][:, :, 0]] if nir else [])
        if len({p.shape for p in planes}) > 1:
            raise ValueError(f"tile {stem} has pictures of unlike size")
        row, col = np.indices(planes[0].shape).reshape(2, -1).astype(np.int32)
        return pa.table({"stem": pa.array([stem] * len(row)), "row": row, "col": col, **{c: p.ravel().astype(np.int32) for c, p in zip(names, planes, strict=True)}})

    return wanted.groupBy("stem").applyInArrow(stacked, f"{_CELLS}, " + ", ".join(f"{c} int" for c in names))
