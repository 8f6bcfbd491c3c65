"""Folders of TIFF rasters as a Python data source: a row for each header, or for each pixel, of the bands asked for.

The driver lists the folders below the root and no files; a partition is one folder (or a share of its files), and its task
lists and reads them. The option ``labels``, or a filter on ``label``, the folder, leaves partitions out. Headers are read by ranges of a few
kilobytes; pixels of rasters that keep bands apart are read strip by strip, for the bands asked for alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from tilewright.sources import tiff
from tilewright.sources.files import Ranges, store_of

HEADERS = (
    "path string, label string, stem string, file_bytes long, read_bytes long, samples int, height int, width int, dtype string, epsg int, x double, y double, "
    "x_resolution double, y_resolution double, left double, bottom double, right double, top double, nodata double"
)
PIXELS = "path string, label string, stem string, band string, row int, col int, value float, valid boolean"
SUFFIXES = (".tif", ".tiff")


@dataclass
class Share(InputPartition):
    """The files of one folder whose names fall to this share."""

    folder: str
    part: int
    parts: int

    def __init__(self, folder: str, part: int, parts: int) -> None:
        super().__init__((folder, part))
        self.folder, self.part, self.parts = folder, part, parts


class RasterReader(DataSourceReader):
    """Plans shares of folders and reads them."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.parts = options["path"], int(options.get("parts", "1"))
        self.bands = [b for b in options.get("bands", "").split(",") if b]
        self.scale = float(options.get("value_scale", "1"))
        self.pixels = options.get("content", "headers") == "pixels"
        if self.parts < 1 or self.scale <= 0:
            raise ValueError("parts and value_scale must be positive")
        if self.pixels and not self.bands:
            raise ValueError("pixels need the names of the bands, in the order of the files")
        chosen = [b for b in options.get("select", "").split(",") if b]
        if set(chosen) - set(self.bands):
            raise ValueError(f"unknown bands {sorted(set(chosen) - set(self.bands))}")
        self.chosen = chosen or self.bands
        self.labels: set[str] | None = set(json.loads(options["labels"])) if "labels" in options else None

    def partitions(self) -> list[InputPartition]:
        store, inner = store_of(self.path)
        below = store.get_file_info(pafs.FileSelector(inner))
        folders = sorted(x.base_name for x in below if x.type == pafs.FileType.Directory and not x.base_name.startswith(("_", ".")))
        if any(x.type == pafs.FileType.File and x.base_name.lower().endswith(SUFFIXES) for x in below):
            folders.append("")
        if self.labels is not None:
            first = {(label or "").split("/")[0] for label in self.labels}
            folders = [f for f in folders if f in first]
        return [Share(f, k, self.parts) for f in folders for k in range(self.parts)]

    def _files(self, share: Share) -> Iterator[tuple[pafs.FileSystem, pafs.FileInfo, str]]:
        store, inner = store_of(self.path)
        root = f"{inner}/{share.folder}" if share.folder else inner
        for info in sorted(store.get_file_info(pafs.FileSelector(root, recursive=bool(share.folder))), key=lambda x: x.path):
            mine = zlib.crc32(info.base_name.encode()) % share.parts == share.part
            if info.type == pafs.FileType.File and info.base_name.lower().endswith(SUFFIXES) and mine:
                label = info.path[len(inner) + 1 :].rpartition("/")[0]
                if self.labels is None or label in self.labels:
                    yield store, info, label

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return  # Spark asks once for nothing where no folder is left
        yield from (self._pixels if self.pixels else self._headers)(partition)

    def _headers(self, share: Share) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        fields = [(name, kinds[kind]) for name, kind in (x.split() for x in HEADERS.split(", "))]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

        for store, info, label in self._files(share):
            ranges = Ranges(store, info.path)
            try:
                head = tiff.header_at(ranges, light=True)
                said = (*head.shape, head.dtype, head.epsg, *(head.centre or (None, None)), *(head.resolution or (None, None)), *(head.bounds or (None,) * 4), head.nodata)
            except (ValueError, KeyError) as error:
                raise ValueError(f"could not read the header of {info.path}: {error}") from error
            finally:
                ranges.close()
            rows.append((info.path, label, info.base_name.rpartition(".")[0], info.size, ranges.taken, *said))
            if len(rows) == 4096:
                yield batch()
                rows.clear()
        yield batch()

    def _pixels(self, share: Share) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIXELS.split(", ")]
        for store, info, label in self._files(share):
            ranges = Ranges(store, info.path)
            try:
                head = tiff.header_at(ranges)
                if head.shape[0] != len(self.bands):
                    raise ValueError(f"{head.shape[0]} bands where {len(self.bands)} are expected")
                which = [self.bands.index(b) for b in self.chosen]
                image = tiff.pixels_at(ranges, head, which)
            except (ValueError, KeyError, zlib.error) as error:
                raise ValueError(f"could not read {info.path}: {error}") from error
            finally:
                ranges.close()
            n, (rows, cols) = image[0].size, np.indices(image[0].shape).reshape(2, -1)
            stem = info.base_name.rpartition(".")[0]
            for band, plane in zip(self.chosen, image, strict=True):
                valid = np.ones(n, bool) if head.nodata is None else plane.ravel() != head.nodata
                value = plane.ravel().astype(np.float32) / np.float32(self.scale)
                if not np.isfinite(value[valid]).all():
                    raise ValueError(f"{info.path} has values that are not finite in {band}")
                same = [pa.array([x] * n, pa.string()) for x in (info.path, label, stem, band)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(value), pa.array(valid)], names)


class PruningReader(RasterReader):
    """A reader that Spark may hand filters; a session that does not hand any refuses it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and tuple(f.attribute) == ("label",):
                self.labels = wanted if self.labels is None else self.labels & wanted
            yield f  # a label may be a folder further down, so Spark still filters


class Rasters(DataSource):
    """``spark.read.format("rasters")`` with ``content`` headers or pixels, ``parts``, ``bands``, ``select``, ``value_scale`` and ``labels`` (a JSON list).

    Filters are taken only under ``pushdown``, as Spark refuses such readers where it is not to hand any.
    """

    @classmethod
    def name(cls) -> str:
        return "rasters"

    def schema(self) -> str:
        return PIXELS if self.options.get("content", "headers") == "pixels" else HEADERS

    def reader(self, schema: StructType) -> RasterReader:
        options = dict(self.options)
        return (PruningReader if options.get("pushdown") == "true" else RasterReader)(options)


def read_rasters(spark: SparkSession, root: str, labels: Iterable[str] | None = None, **options: str) -> DataFrame:
    """Headers, or with ``content="pixels"`` pixels, of the rasters below ``root``; of those of ``labels`` alone if given.

    Where ``spark.sql.python.filterPushdown.enabled`` is set, as ``build_session`` does, filters on ``label`` leave folders
    unread as well; in any other session Spark filters what was read.
    """
    spark.dataSource.register(Rasters)
    options["pushdown"] = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    if labels is not None:
        options["labels"] = json.dumps(sorted(labels))
    return spark.read.format("rasters").options(**options).load(root)
