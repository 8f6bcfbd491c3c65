"""A reader of plain TIFF rasters: headers for catalogs, pixels for tables; striped or tiled, plain, deflated or LZW."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geo

# Fixed values of the TIFF and GeoTIFF formats: sizes of field types, tags, and keys of coordinate systems.
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
PROJECTED, GEOGRAPHIC = 3072, 2048


@dataclass(frozen=True)
class Header:
    """What a raster says of itself."""

    tags: dict[int, tuple]
    order: str

    def one(self, tag: int, default: object = None) -> object:
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def shape(self) -> tuple[int, int, int]:
        return int(self.one(SAMPLES, 1)), int(self.one(HEIGHT)), int(self.one(WIDTH))

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
        return found.get(PROJECTED) or found.get(GEOGRAPHIC)

    @property
    def resolution(self) -> tuple[float, float] | None:
        scale = self.tags.get(PIXEL_SCALE)
        return (float(scale[0]), float(scale[1])) if scale else None

    @property
    def centre(self) -> tuple[float, float] | None:
        """``x, y`` of the raster's middle in its own coordinates."""
        tie, scale = self.tags.get(TIEPOINT), self.tags.get(PIXEL_SCALE)
        if not tie or not scale:
            return None
        _, height, width = self.shape
        return tie[3] + (width / 2 - tie[0]) * scale[0], tie[4] - (height / 2 - tie[1]) * scale[1]

    @property
    def bounds(self) -> tuple[float, float, float, float] | None:
        """``left, bottom, right, top`` in the raster's own coordinates."""
        tie, scale = self.tags.get(TIEPOINT), self.tags.get(PIXEL_SCALE)
        if not tie or not scale:
            return None
        _, height, width = self.shape
        left, top = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        return left, top - height * scale[1], left + width * scale[0], top

    @property
    def dtype(self) -> str:
        """The kind of its values, as ``uint16`` or ``float32``."""
        kind = {1: "uint", 2: "int", 3: "float"}.get(int(self.one(FORMAT, 1)), "unknown")
        return f"{kind}{int(self.one(BITS, 8))}"

    @property
    def nodata(self) -> float | None:
        told = self.tags.get(NODATA)
        return float(told[0].split(b"\0")[0]) if told else None


def header_at(read: Callable[[int, int], bytes], light: bool = False) -> Header:
    """The first directory of a TIFF file of which ``read(place, length)`` gives bytes; anything else is an error.

    ``light`` leaves out where the pixels lie, which may be long lists.
    """
    start = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or len(start) < 8 or struct.unpack(f"{order}H", start[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(f"{order}I", start[4:8])[0]
    tags: dict[int, tuple] = {}

    def unpacked(form: str, raw: bytes) -> tuple:
        if len(raw) < struct.calcsize(order + form):
            raise ValueError("a TIFF file that ends within its header")
        return struct.unpack(order + form, raw)

    (entries,) = unpacked("H", read(at, 2))
    for k in range(entries):
        tag, kind, count = unpacked("HHI", read(at + 2 + 12 * k, 8))
        if light and tag in (STRIPS, STRIP_BYTES, TILES, TILE_BYTES):
            continue
        letter, size = _SIZES.get(kind, ("B", 1))
        begin = at + 10 + 12 * k
        if size * count > 4:
            (begin,) = unpacked("I", read(begin, 4))
        raw = read(begin, size * count)
        tags[tag] = (raw,) if letter == "s" else unpacked(letter * count, raw)
    if WIDTH not in tags or HEIGHT not in tags:
        raise ValueError("a TIFF file without its size")
    return Header(tags, order)


def read_header(data: bytes) -> Header:
    """The first directory of a TIFF file held in memory."""
    return header_at(lambda at, n: data[at : at + n])


def unpacked_lzw(data: bytes) -> bytes:
    """The bytes of a strip packed by LZW: codes of 9 to 12 bits, highest bit first, that widen one code early."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, width, before = list(first), [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = list(first), 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("a strip whose LZW codes are broken")
        now = table[code] if code < len(table) else before + before[:1]
        out.append(now)
        if before:
            table.append(before + now[:1])
        before = now
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


def pixels_at(read: Callable[[int, int], bytes], head: Header, bands: list[int] | None = None) -> np.ndarray:
    """The raster as ``[bands, rows, columns]``; where bands lie apart, only the strips of those asked for are read."""
    samples, height, width = head.shape
    letter = {1: "u", 2: "i", 3: "f"}[int(head.one(FORMAT, 1))]
    kind = np.dtype(f"{head.order}{letter}{int(head.one(BITS, 8)) // 8}")
    packed, apart = int(head.one(COMPRESSION, 1)), int(head.one(PLANAR, 1)) == 2
    if packed not in (1, 5, 8, 32946):
        raise ValueError(f"compression {packed} is not supported")
    tiled = TILES in head.tags
    deep, across = (int(head.one(TILE_HEIGHT)), int(head.one(TILE_WIDTH))) if tiled else (min(height, int(head.one(ROWS, height))), width)
    starts, sizes = head.tags[TILES if tiled else STRIPS], head.tags[TILE_BYTES if tiled else STRIP_BYTES]
    planes, each = (samples, 1) if apart else (1, samples)
    wanted = list(range(samples)) if bands is None else bands
    out = np.zeros((samples, height, width), kind.newbyteorder("="))
    per_row = -(-width // across)
    per_plane = per_row * -(-height // deep)
    for nth, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        plane, place = divmod(nth, per_plane) if planes > 1 else (0, nth)
        if planes > 1 and plane not in wanted:
            continue
        raw = read(start, size)
        if len(raw) < size:
            raise ValueError("a TIFF file that ends within its pixels")
        raw = raw if packed == 1 else unpacked_lzw(raw) if packed == 5 else zlib.decompress(raw)
        top, left = place // per_row * deep, place % per_row * across
        block = np.frombuffer(raw, kind).reshape(-1, across, each).astype(out.dtype)
        if int(head.one(PREDICTOR, 1)) == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        rows, cols = min(deep, height - top, len(block)), min(across, width - left)
        out[plane * each : (plane + 1) * each, top : top + rows, left : left + cols] = block[:rows, :cols].transpose(2, 0, 1)
    return out[wanted]


def read_pixels(data: bytes) -> np.ndarray:
    """The raster of a file held in memory, as ``[bands, rows, columns]``."""
    read = lambda at, n: data[at : at + n]
    return pixels_at(read, header_at(read))


def tiff_bytes(image: np.ndarray, epsg: int | None = None, origin: tuple[float, float] = (0.0, 0.0), resolution: tuple[float, float] = (1.0, 1.0), nodata: float | None = None) -> bytes:
    """A TIFF file of ``[bands, rows, columns]``, a deflated strip for each band; ``origin`` is the upper left corner."""
    bands, rows, cols = image.shape
    strips = [zlib.compress(np.ascontiguousarray(plane).astype(image.dtype.newbyteorder("<")).tobytes()) for plane in image]
    starts = np.cumsum([8, *map(len, strips)]).tolist()
    fields: list[tuple[int, str, list]] = [
        (WIDTH, "I", [cols]), (HEIGHT, "I", [rows]), (BITS, "H", [image.dtype.itemsize * 8] * bands), (COMPRESSION, "H", [8]), (STRIPS, "I", starts[:-1]),
        (SAMPLES, "H", [bands]), (ROWS, "I", [rows]), (STRIP_BYTES, "I", list(map(len, strips))), (PLANAR, "H", [2]), (FORMAT, "H", [{"u": 1, "i": 2, "f": 3}[image.dtype.kind]] * bands),
    ]
    if epsg is not None:
        fields += [
            (PIXEL_SCALE, "d", [*resolution, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, *origin, 0.0]),
            (GEO_KEYS, "H", [1, 1, 0, 1, GEOGRAPHIC if epsg == 4326 else PROJECTED, 0, 1, epsg]),
        ]
    if nodata is not None:
        fields.append((NODATA, "s", [f"{nodata:g}".encode() + b"\0"]))
    kinds = {letter: kind for kind, (letter, _) in _SIZES.items() if len(letter) == 1}
    at = starts[-1] + starts[-1] % 2
    entries, extra, free = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, letter, values in sorted(fields):
        raw = values[0] if letter == "s" else struct.pack(f"<{letter * len(values)}", *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", free + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack("<HHI", tag, kinds[letter], len(raw) if letter == "s" else len(values)) + place
    head = b"II" + struct.pack("<HI", 42, at)
    return head + b"".join(strips).ljust(at - 8, b"\0") + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")


_HEADERS = "path string, samples int, height int, width int, epsg int, x double, y double, x_resolution double, y_resolution double, nodata double"


def scan_headers(spark: SparkSession, root: str, pattern: str = "*.tif*") -> DataFrame:
    """A row for each raster below ``root`` from its header; files are read where they lie, in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _HEADERS.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                head = read_header(content.as_py())
                rows.append((path.as_py(), *head.shape, head.epsg, *(head.centre or (None, None)), *(head.resolution or (None, None)), head.nodata))
            kinds = [pa.string(), *[pa.int32()] * 4, *[pa.float64()] * 5]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return _files(spark, root, pattern).mapInArrow(run, _HEADERS)


def position(epsg: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """``latitude, longitude`` of a position in degrees or in a UTM zone; null in other systems."""
    zone, north = epsg % 100, epsg < 32700
    utm = epsg.between(32601, 32660) | epsg.between(32701, 32760)
    latitude, longitude = geo.utm_to_wgs84(x, y, zone, north)
    return F.when(epsg == 4326, y).when(utm, latitude), F.when(epsg == 4326, x).when(utm, longitude)


def tile_records(headers: DataFrame, dataset: str, shape: tuple[int, int, int]) -> DataFrame:
    """``tile_id, label, path, epsg, x, y, latitude, longitude, ...`` of scanned rasters: the label is the folder, the id ``dataset:folder/stem``.

    A raster of another shape is an error when it is read. Folders below folders count where the scan tells of ``label``.
    """
    label = F.col("label") if "label" in headers.columns else F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    fits = (F.col("samples") == shape[0]) & (F.col("height") == shape[1]) & (F.col("width") == shape[2])
    checked = F.when(fits, F.concat(F.lit(f"{dataset}:"), label, F.lit("/"), stem)).otherwise(
        F.raise_error(F.concat(F.lit("a raster of another shape: "), F.col("path"))).cast("string")
    )
    # Degrees have no resolution in metres.
    metres = lambda c: F.when(F.col("epsg") != 4326, F.col(c)).alias(c)
    latitude, longitude = position(F.col("epsg"), F.col("x"), F.col("y"))
    return headers.select(
        checked.alias("tile_id"), label.alias("label"), "path", "epsg", "x", "y", latitude.alias("latitude"), longitude.alias("longitude"),
        metres("x_resolution"), metres("y_resolution"), "nodata",
    )


def pixel_table(spark: SparkSession, root: str, bands: tuple[str, ...], value_scale: float = 1.0, pattern: str = "*.tif*") -> DataFrame:
    """``path, band, row, col, value`` of every raster below ``root``, values divided by ``value_scale``; others than finite ones are errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                image = read_pixels(content.as_py()).astype(np.float32) / np.float32(value_scale)
                if len(image) != len(bands) or not np.isfinite(image).all():
                    raise ValueError(f"{path.as_py()} has {len(image)} bands or values that are not finite")
                n, (rows, cols) = image[0].size, np.indices(image[0].shape).reshape(2, -1)
                for band, plane in zip(bands, image, strict=True):
                    columns = [pa.array([path.as_py()] * n), pa.array([band] * n), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(plane.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "band", "row", "col", "value"])

    return _files(spark, root, pattern).mapInArrow(run, "path string, band string, row int, col int, value float")
