"""Rasters, catalogs, artifacts, sinks, encoders and draws, against plain loops and with what must be refused."""

import hashlib
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import augment, encoders, evaluation, raster, splits, statistics, views
from tilewright.sources import catalog, readers, sinks, tiff


def tiff_bytes(image, packed=False, big=False, strip=3, geo=True):
    """A TIFF file of ``[bands, rows, columns]``, bands interleaved, in strips."""
    o = ">" if big else "<"
    bands, rows, cols = image.shape
    body = [image[:, r : r + strip].transpose(1, 2, 0).astype(image.dtype.newbyteorder(o)).tobytes() for r in range(0, rows, strip)]
    body = [zlib.compress(b) if packed else b for b in body]
    tags = [(256, 3, [cols]), (257, 3, [rows]), (258, 3, [image.dtype.itemsize * 8] * bands), (259, 3, [8 if packed else 1]), (277, 3, [bands]), (278, 3, [strip]), (279, 4, [len(b) for b in body]), (339, 3, [{"u": 1, "f": 3}[image.dtype.kind]] * bands)]
    if geo:
        tags += [(33550, 12, [10.0, 20.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 500000.0, 4000000.0, 0.0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, 32632])]
    tags.append((273, 4, [0] * len(body)))
    tags.sort()
    at = 8 + sum(map(len, body))
    starts = [8 + sum(map(len, body[:k])) for k in range(len(body))]
    extra, entries, free = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        values = starts if tag == 273 else values
        raw = struct.pack(o + {3: "H", 4: "I", 12: "d"}[kind] * len(values), *values)
        field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(o + "I", free + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack(o + "HHI", tag, kind, len(values)) + field
    return (b"MM" if big else b"II") + struct.pack(o + "HI", 42, at) + b"".join(body) + struct.pack(o + "H", len(tags)) + entries + struct.pack(o + "I", 0) + extra


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.float32])
def test_tiff_round_trip(packed, big, kind):
    image = (np.random.default_rng(2).random((3, 7, 5)) * 200).astype(kind)
    data = tiff_bytes(image, packed, big)
    assert np.array_equal(tiff.read_pixels(data), image)
    head = tiff.read_header(data)
    assert head.shape == (3, 7, 5) and head.epsg == 32632 and head.resolution == (10.0, 20.0) and head.centre == (500025.0, 3999930.0)
    with pytest.raises(ValueError):
        tiff.read_header(b"no")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tiles")
    for label in ("Forest", "River"):
        (root / label).mkdir()
        for k in range(2):
            image = np.arange(2 * 4 * 4, dtype=np.uint16).reshape(2, 4, 4) + 100 * k
            (root / label / f"{label}_{k}.tif").write_bytes(tiff_bytes(image, packed=bool(k)))
    return root


def test_scans_of_rasters(spark, folder):
    records = tiff.tile_records(tiff.scan_headers(spark, str(folder)), "made", (2, 4, 4)).orderBy("tile_id").collect()
    assert [r.tile_id for r in records] == ["made:Forest/Forest_0", "made:Forest/Forest_1", "made:River/River_0", "made:River/River_1"]
    assert records[0].label == "Forest" and records[0].x_resolution == 10.0
    with pytest.raises(Exception, match="another shape"):
        tiff.tile_records(tiff.scan_headers(spark, str(folder)), "made", (3, 4, 4)).collect()
    cells = tiff.pixel_table(spark, str(folder), ("B01", "B02"), 2.0)
    assert cells.count() == 4 * 32
    one = cells.where(F.col("path").endswith("River_1.tif") & (F.col("band") == "B02") & (F.col("row") == 1) & (F.col("col") == 2)).first()
    assert one.value == (16 + 6 + 100) / 2


def test_inventory_is_of_relative_paths(spark, folder):
    files = catalog.inventory(spark, str(folder))
    want = hashlib.sha256()
    for path in sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names):
        stat = os.stat(folder / path)
        want.update(f"{path}\0{stat.st_size}\0{stat.st_mtime_ns // 1_000_000 * 1_000_000}\n".encode())
    assert catalog.inventory_digest(files).first().fingerprint == want.hexdigest()


def test_catalogs_refuse(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x/a.tif"), ("b", "x/b.tif")], "tile_id string, relative_path string")
    about = {"dataset": "d", "source_fingerprint": "f", "bands": ["B01"], "expected_shape": [1, 2, 2]}
    catalog.write_catalog(rows, str(tmp_path / "c"), about)
    assert catalog.read_catalog(spark, str(tmp_path / "c"), about).count() == 2
    for wrong, error in (({"source_fingerprint": "g"}, catalog.StaleCatalog), ({"bands": ["B02"]}, catalog.StaleCatalog), ({"dataset": "e"}, ValueError)):
        with pytest.raises(error):
            catalog.read_catalog(spark, str(tmp_path / "c"), about | wrong)
    for k, bad in enumerate(("/x/a.tif", "../a.tif", "x/../a.tif", "file:///a.tif")):
        with pytest.raises(Exception, match="unsafe path"):
            catalog.write_catalog(spark.createDataFrame([("a", bad)], rows.schema), str(tmp_path / f"bad{k}"), about)
    with pytest.raises(Exception, match="already exists"):
        catalog.write_catalog(rows, str(tmp_path / "c"), about)


def test_artifacts_refuse(spark, tmp_path):
    kind = "tile_id string, row long, split string, embedding array<double>"
    good = [("a", 0, "train", [1.0, 0.0]), ("b", 1, "test", [0.0, 1.0])]
    catalog.write_embeddings(spark.createDataFrame(good, kind), str(tmp_path / "a"))
    assert [r.tile_id for r in catalog.read_embeddings(spark, str(tmp_path / "a")).collect()] == ["a", "b"]
    for k, bad in enumerate((("b", 2, "test", [0.0, 1.0]), ("b", 1, "other", [0.0, 1.0]), ("b", 1, "test", [0.0, 2.0]), ("a", 1, "test", [0.0, 1.0]), ("b", 1, "test", [1.0]))):
        with pytest.raises(ValueError):
            catalog.write_embeddings(spark.createDataFrame([good[0], bad], kind), str(tmp_path / f"bad{k}"))
    rows = spark.createDataFrame([("01", "g1", "train"), ("1", "g2", "test")], "tile_id string, group_id string, split string")
    catalog.write_splits(rows, str(tmp_path / "s"))
    assert {r.tile_id for r in catalog.read_splits(spark, str(tmp_path / "s"), rows, grouped=True).collect()} == {"01", "1"}
    with pytest.raises(ValueError):
        catalog.read_splits(spark, str(tmp_path / "s"), rows.limit(1), grouped=True)
    crossing = spark.createDataFrame([("a", "g", "train"), ("b", "g", "test")], rows.schema)
    catalog.write_splits(crossing, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        catalog.read_splits(spark, str(tmp_path / "x"), grouped=True)


def test_split_filter_and_lookups_refuse(spark):
    rows = spark.createDataFrame([(x,) for x in "abc"], "tile_id string")
    given = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train"), ("d", "test")], "tile_id string, split string")
    with pytest.raises(ValueError, match="assignments without a row"):
        splits.rows_for_split(rows, given, "train")
    assert {r.tile_id for r in splits.rows_for_split(rows, given, "train", allow_extra=True).collect()} == {"a", "c"}
    with pytest.raises(ValueError, match="rows without"):
        splits.rows_for_split(rows, given.where("tile_id <> 'a'"), "train", allow_extra=True)
    with pytest.raises(ValueError, match="share"):
        splits.require_apart(rows, given, "tile_id", "the two share ids")
    with pytest.raises(ValueError, match="unknown tile_id"):
        catalog.lookup(given, rows, "tile_id")
    with pytest.raises(ValueError, match="not those expected"):
        catalog.gallery_records(rows, given, given)


def test_stems_and_flags_refuse(spark):
    files = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    assert catalog.stem_roles(files("a/rgb/1.jpg", "a/nir/1.jpg"), ("rgb", "nir")).count() == 1
    with pytest.raises(ValueError):
        catalog.stem_roles(files("a/rgb/1.jpg"), ("rgb", "nir"))
    with pytest.raises(ValueError):
        catalog.stem_roles(files("a/rgb/1.jpg", "b/rgb/1.png", "a/nir/1.jpg"), ("rgb", "nir"))
    flag = lambda text, required: spark.createDataFrame([(text,)], "x string").select(catalog.parsed_flag(F.col("x"), "flag", required).alias("f")).first().f
    assert flag(" TRUE", True) is True and flag(None, False) is None
    for text, required in (("yes", False), (None, True)):
        with pytest.raises(Exception, match="must be true or false"):
            flag(text, required)


def test_caches_are_reused_only_under_their_manifest(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert not catalog.reuse_or_build(spark, str(tmp_path / "c"), {"f": 1}, build)[1]
    assert catalog.reuse_or_build(spark, str(tmp_path / "c"), {"f": 1}, build)[1]
    assert not catalog.reuse_or_build(spark, str(tmp_path / "c"), {"f": 2}, build)[1] and len(calls) == 2


def test_a_write_that_broke_off_can_be_run_again(spark, tmp_path, monkeypatch):
    """A failure at each step of a write: what was there stays readable, and the same write then succeeds."""
    rows = spark.createDataFrame([("a", "x/a.tif"), ("b", "x/b.tif")], "tile_id string, relative_path string")
    about = {"dataset": "d", "source_fingerprint": "f", "bands": ["B01"], "expected_shape": [1, 2, 2]}
    good = spark.createDataFrame([("a", 0, "train", [1.0, 0.0])], "tile_id string, row long, split string, embedding array<double>")
    broken = rows.withColumn("relative_path", F.raise_error(F.lit("a lost disk")).cast("string"))
    where = lambda name: str(tmp_path / name)
    with pytest.raises(Exception, match="a lost disk"):
        catalog.write_catalog(broken, where("c"), about)
    real, calls = catalog.commits.commit_text, []

    def failing(*args, **kwargs):
        calls.append(args[1])
        raise OSError("the driver went away")

    monkeypatch.setattr(catalog.commits, "commit_text", failing)
    for write in (lambda: catalog.write_catalog(rows, where("c"), about), lambda: catalog.write_embeddings(good, where("e")), lambda: catalog.reuse_or_build(spark, where("r"), {"f": 1}, lambda: spark.range(3))):
        with pytest.raises(OSError):
            write()
    monkeypatch.setattr(catalog.commits, "commit_text", real)
    assert len(calls) == 3
    catalog.write_catalog(rows, where("c"), about)
    catalog.write_embeddings(good, where("e"))
    assert catalog.read_catalog(spark, where("c"), about).count() == 2 and catalog.read_embeddings(spark, where("e")).count() == 1
    kept, reused = catalog.reuse_or_build(spark, where("r"), {"f": 1}, lambda: spark.range(3))
    assert not reused and kept.count() == 3
    monkeypatch.setattr(catalog.commits, "commit_text", failing)
    with pytest.raises(OSError):  # new rows of the same number are there, but the old manifest does not name them
        catalog.reuse_or_build(spark, where("r"), {"f": 2}, lambda: spark.range(10, 13))
    monkeypatch.setattr(catalog.commits, "commit_text", real)
    again, reused = catalog.reuse_or_build(spark, where("r"), {"f": 1}, lambda: spark.range(3))
    assert reused and sorted(r.id for r in again.collect()) == [0, 1, 2]
    for f in (2, 3):
        catalog.reuse_or_build(spark, where("r"), {"f": f}, lambda f=f: spark.range(f))
    assert len(catalog.commits.folders(spark, where("r"), "rows-")) == 2 and kept.schema == again.schema
    with pytest.raises(ValueError, match="already exists"):
        catalog.write_embeddings(good, where("e"))


def test_a_batch_of_judgments_that_broke_off_is_not_read(spark, tmp_path):
    judged = spark.createDataFrame([("q", 1, "a", "relevant")], "query_id string, rank int, tile_id string, judgment string")
    name = sinks.append_judgments(judged, str(tmp_path / "j"))
    sinks.append_judgments(judged.withColumn("rank", F.lit(2)), str(tmp_path / "j"), "two")
    os.remove(tmp_path / "j" / "batch-two" / "_SUCCESS")
    assert [r["rank"] for r in readers.read_judgments(spark, str(tmp_path / "j")).collect()] == [1]
    sinks.append_judgments(judged.withColumn("rank", F.lit(2)), str(tmp_path / "j"), "two")
    assert sorted(r["rank"] for r in readers.read_judgments(spark, str(tmp_path / "j")).collect()) == [1, 2] and len(name) == 16


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("q", 1, "a", 0.5, ["x", "y"])], "query_id string, rank int, tile_id string, score double, labels array<string>")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first().labels == '["x","y"]'
    folder = sinks.write_search(rows, str(tmp_path), "a query", "cosine", 5)
    assert os.path.basename(folder) == hashlib.sha256(b"a query").hexdigest()[:12] + "_cosine_top5"
    judged = spark.createDataFrame([("q", 1, "a", "relevant")], "query_id string, rank int, tile_id string, judgment string")
    for _ in range(2):  # a repeated append adds nothing
        sinks.append_judgments(judged, str(tmp_path / "judged"))
    assert readers.read_judgments(spark, str(tmp_path / "judged")).count() == 1
    sinks.append_judgments(judged, str(tmp_path / "judged"), "again")
    with pytest.raises(ValueError, match="repeat a key"):
        readers.read_judgments(spark, str(tmp_path / "judged"))
    sinks.append_judgments(judged.select("query_id", "rank", "tile_id"), str(tmp_path / "undecided"))
    with pytest.raises(ValueError, match="unknown decision"):
        readers.read_judgments(spark, str(tmp_path / "undecided"))
    places = spark.createDataFrame([("b", "B"), ("a", "A")], "place_id string, name string")
    sinks.write_gazetteer(places, str(tmp_path / "places"))
    assert [r.place_id for r in spark.read.json(str(tmp_path / "places")).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.write_gazetteer(places.union(places), str(tmp_path / "twice"))
    bands = spark.createDataFrame([("B01", 1.5)], "band string, mean double")
    sinks.write_audit(bands, spark.createDataFrame([("x", 3)], "label string, n int"), {"ok": True}, str(tmp_path / "audit"))
    assert "| B01 | 1.5 |" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "audit" / "report")).collect())
    sinks.write_spectral_audit(rows, rows, rows, {"n": 1}, str(tmp_path / "spectral"))
    presets = spark.createDataFrame([("cnn", "rgb", "r1")], "architecture string, modality string, run_id string")
    sinks.write_selection(presets, str(tmp_path / "selection"), {"seed": 1})
    assert '"cnn"' in spark.read.text(str(tmp_path / "selection")).first().value
    assert sinks.checked_download(b"x", hashlib.sha256(b"x").hexdigest()) == b"x"
    with pytest.raises(ValueError):
        sinks.checked_download(b"y", hashlib.sha256(b"x").hexdigest())


def test_view_draws_are_the_generator_s(spark):
    tiles = spark.createDataFrame([(f"t{k}",) for k in range(50)], "tile_id string")
    got = {(r.tile_id, r.view): (r.quarter_turns, r.flipped) for r in augment.view_draws(tiles, 7, 3).collect()}
    for tile in ("t0", "t31", "t49"):
        for view in (0, 1):
            generator = random.Random(int.from_bytes(hashlib.sha256(f"7:3:{tile}:{view}".encode()).digest()[:8], "little"))
            assert got[tile, view] == (generator.randrange(4), bool(generator.randrange(2)))
    assert augment.view_draws(tiles, 7, 3, fixed_views=True).exceptAll(augment.view_draws(tiles, 7, 0)).count() == 0
    pixels = spark.createDataFrame([("a", r, c, r == 0, r * 4 + c) for r in range(4) for c in range(4)], "tile_id string, row int, col int, valid boolean, cell int")
    plane = np.arange(16).reshape(4, 4)
    for view, frame in {v: augment.paired_views(pixels, 4, 7, 1).where(f"view = {v}").collect() for v in (0, 1)}.items():
        want = np.rot90(plane, frame[0].quarter_turns)
        want = want[:, ::-1] if frame[0].flipped else want
        assert all(want[r.row, r.col] == r.cell and r.valid == (r.cell < 4) for r in frame) and len(frame) == 16, view
    augment.check_collated(pixels)
    with pytest.raises(ValueError):
        augment.check_collated(pixels.union(pixels.withColumn("tile_id", F.lit("b")).limit(3)))


def test_convolutional_encoder_against_loops():
    rng = np.random.default_rng(4)
    w = {"mean": rng.normal(size=2), "deviation": rng.random(2) + 0.5, "project": rng.normal(size=(5, 8)), "offset": rng.normal(size=5)}
    before = 2
    for k in range(3):
        w |= {f"kernel_{k}": rng.normal(size=(8, before, 3, 3)), f"scale_{k}": rng.normal(size=8), f"shift_{k}": rng.normal(size=8)}
        before = 8
    images, valid = rng.normal(size=(2, 2, 9, 8)), rng.random((2, 9, 8)) > 0.2
    got = encoders.Convolutional(w)(images, valid)
    for n in range(2):
        x = [[[(images[n, b, i, j] - w["mean"][b]) / w["deviation"][b] if valid[n, i, j] else 0.0 for j in range(8)] for i in range(9)] for b in range(2)]
        for k in range(3):
            rows, cols = len(x[0]), len(x[0][0])
            out = []
            for o in range(8):
                plane = [[sum(w[f"kernel_{k}"][o, c, a, b] * x[c][i + a - 1][j + b - 1] for c in range(len(x)) for a in range(3) for b in range(3) if 0 <= i + a - 1 < rows and 0 <= j + b - 1 < cols) for j in range(0, cols, 2)] for i in range(0, rows, 2)]
                flat = [v for line in plane for v in line]
                mean = sum(flat) / len(flat)
                var = sum((v - mean) ** 2 for v in flat) / len(flat)
                scaled = [[(v - mean) / math.sqrt(var + 1e-5) * w[f"scale_{k}"][o] + w[f"shift_{k}"][o] for v in line] for line in plane]
                out.append([[v / (1 + math.exp(-v)) for v in line] for line in scaled])
            x = out
        pooled = [sum(map(sum, p)) / (len(p) * len(p[0])) for p in x]
        raw = [sum(w["project"][d, c] * pooled[c] for c in range(8)) + w["offset"][d] for d in range(5)]
        assert np.allclose(got[n], np.array(raw) / math.sqrt(sum(v * v for v in raw)))


def test_transformer_encoder_against_loops():
    rng = np.random.default_rng(5)
    wide, heads, patch, bands, places = 6, 2, 2, 1, 5
    w = {"mean": np.zeros(bands), "deviation": np.ones(bands), "patch": rng.normal(size=(wide, bands * 4)), "patch_offset": rng.normal(size=wide), "class_token": rng.normal(size=(1, 1, wide)), "places": rng.normal(size=(1, places, wide))}
    for name, shape in (("norm1", wide), ("norm1_shift", wide), ("qkv", (3 * wide, wide)), ("qkv_offset", 3 * wide), ("out", (wide, wide)), ("out_offset", wide), ("norm2", wide), ("norm2_shift", wide), ("up", (8, wide)), ("up_offset", 8), ("down", (wide, 8)), ("down_offset", wide)):
        w[f"{name}_0"] = rng.normal(size=shape)
    w |= {"norm": rng.normal(size=wide), "norm_shift": rng.normal(size=wide), "project": rng.normal(size=(3, wide)), "offset": rng.normal(size=3)}
    image = rng.normal(size=(1, bands, 4, 4))
    got = encoders.Transformer(w, patch, heads, 1)(image)[0]

    def normed(x, a, b):
        mean = sum(x) / len(x)
        var = sum((v - mean) ** 2 for v in x) / len(x)
        return [(v - mean) / math.sqrt(var + 1e-6) * p + q for v, p, q in zip(x, a, b, strict=True)]

    linear = lambda m, x, o: [sum(a * b for a, b in zip(row, x, strict=True)) + c for row, c in zip(m, o, strict=True)]
    tokens = [list(w["class_token"][0, 0])]
    for i in (0, 2):
        for j in (0, 2):
            tokens.append(linear(w["patch"], [image[0, 0, i + a, j + b] for a in (0, 1) for b in (0, 1)], w["patch_offset"]))
    tokens = [[a + b for a, b in zip(t, p, strict=True)] for t, p in zip(tokens, w["places"][0], strict=True)]
    qkv = [linear(w["qkv_0"], normed(t, w["norm1_0"], w["norm1_shift_0"]), w["qkv_offset_0"]) for t in tokens]
    mixed = [[0.0] * wide for _ in tokens]
    each = wide // heads
    for h in range(heads):
        part = lambda t, k, h=h: t[k * wide + h * each : k * wide + (h + 1) * each]
        for n, t in enumerate(qkv):
            e = [math.exp(sum(a * b for a, b in zip(part(t, 0), part(u, 1), strict=True)) / math.sqrt(each)) for u in qkv]
            for d in range(each):
                mixed[n][h * each + d] = sum(x / sum(e) * part(u, 2)[d] for x, u in zip(e, qkv, strict=True))
    tokens = [[a + b for a, b in zip(t, linear(w["out_0"], m, w["out_offset_0"]), strict=True)] for t, m in zip(tokens, mixed, strict=True)]
    out = []
    for t in tokens:
        hidden = linear(w["up_0"], normed(t, w["norm2_0"], w["norm2_shift_0"]), w["up_offset_0"])
        hidden = [v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in hidden]
        out.append([a + b for a, b in zip(t, linear(w["down_0"], hidden, w["down_offset_0"]), strict=True)])
    raw = linear(w["project"], normed(out[0], w["norm"], w["norm_shift"]), w["offset"])
    assert np.allclose(got, np.array(raw) / math.sqrt(sum(v * v for v in raw)))


def test_band_alignment(spark):
    kind = "tile_id string, row int, col int, valid boolean, value double"
    fine = spark.createDataFrame([("a", r, c, not (r < 2 and c < 2), float(10 * r + c)) for r in range(4) for c in range(4)], kind)
    same = spark.createDataFrame([("a", r, c, True, 1.0) for r in range(2) for c in range(2)], kind)
    coarse = spark.createDataFrame([("a", 0, 0, True, 7.0)], kind)
    got = {(r.row, r.col): r for r in raster.on_grid({"fine": (fine, 10.0), "same": (same, 20.0), "coarse": (coarse, 40.0)}, 20.0).collect()}
    assert len(got) == 4 and not got[0, 0].valid and got[0, 0].fine == 0.0
    assert got[1, 1].valid and got[1, 1].fine == (22 + 23 + 32 + 33) / 4 and got[1, 1].coarse == 7.0
    wide = spark.createDataFrame([("a", 0, 0, True, 0.0), ("a", 0, 1, True, 4.0)], kind)
    line = {r.col: r.value for r in raster.refined(wide, 2, "value").where("row = 0").collect()}
    assert [line[c] for c in range(4)] == [0.0, 1.0, 3.0, 4.0]


def test_further_summaries(spark):
    rows = spark.createDataFrame([("q1", 1, "a", "x", "x,y", "relevant"), ("q1", 2, "b", "x", "y", "uncertain"), ("q1", 3, "c", "x", "y", "not_relevant"), ("q2", 1, "d", "x", "", "uncertain")], "query_id string, rank int, tile_id string, target_label string, labels string, judgment string")
    got = evaluation.judgment_summary(rows, 4).first()
    assert (got.status, got.macro_precision_lower, got.macro_precision_upper, got.agreement_on_definite) == ("complete", pytest.approx(1 / 6), pytest.approx((2 / 3 + 1) / 2), 1.0)
    assert evaluation.judgment_summary(rows.limit(0), 4).first().status == "partial"
    with pytest.raises(Exception, match="invalid judgment"):
        evaluation.judgment_summary(rows.withColumn("judgment", F.lit("maybe")), 4).collect()
    flat = spark.createDataFrame([("B", 5.0), ("B", 5.0)], "band string, value double")
    assert statistics.plain_moments(flat).first().sd == pytest.approx(1e-6)
    assert statistics.dataset_summary(spark.createDataFrame([], "asset_status string, timestamp timestamp")).first().date_start is None


def test_audits_and_radiometry(spark, tmp_path):
    head = ",".join(readers.AUDIT)
    (tmp_path / "good.csv").write_text(f'{head}\nq,"a, text",x,1,t,0.5,"a,b",,p\nq,a,x,2,t,0.5,,f,p\n')
    assert [(r.labels, r.field_id, r.query_text) for r in readers.read_audit(spark, str(tmp_path / "good.csv")).orderBy("rank").collect()] == [("a,b", "", "a, text"), ("", "f", "a")]
    for name, text in (("short", "query_id,rank\nq,1\n"), ("empty", head + "\n"), ("twice", f"{head}\n" + "q,a,x,1,t,0.5,,f,p\n" * 2)):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(ValueError):
            readers.read_audit(spark, str(tmp_path / f"{name}.csv"))
    items = spark.createDataFrame([({"B03": '{"eo:bands": [{"name": "x"}], "raster:bands": [{"scale": 1, "nodata": 0}, {"scale": 2}]}', "B04": "{}"},), ({"B03": '{"raster:bands": []}'},)], "assets map<string,string>")
    assert {r.field: r.n for r in readers.radiometry_counts(items).collect()} == {"eo:bands": 1, "raster:bands": 1, "scale": 2, "offset": 0, "unit": 0, "nodata": 1}


def pixels_of(png):
    """The pixels of a PNG whose lines are unfiltered."""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, head = 8, b"", None
    while at < len(png):
        size, kind = struct.unpack(">I", png[at : at + 4])[0], png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        assert struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        head, data, at = (struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head), data + (body if kind == b"IDAT" else b""), at + 12 + size
    depth = {2: 3, 6: 4}[head[3]]
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(head[1], -1)[:, 1:].reshape(head[1], head[0], depth)


def test_views(spark):
    cells = [("a", r, c, (r, c) != (1, 1), float(r), float(c), 5.0, 0.1 * r) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(cells, "tile_id string, row int, col int, valid boolean, b03 double, b04 double, b08 double, b11 double")
    image = pixels_of(views.previews(df, ("b03", "b04", "b08"), 4).first().png)
    for k, plane in enumerate((np.repeat(np.arange(4.0), 4), np.tile(np.arange(4.0), 4), np.full(16, 5.0))):
        keep = np.arange(16) != 5
        low, high = np.percentile(plane[keep], (2, 98))
        high = high if high > low else low + 1
        assert np.array_equal(image[:, :, k].ravel(), np.rint(np.clip((plane - low) / (high - low), 0, 1) * 255).astype(np.uint8))
    maps = spark.createDataFrame([("a", 0, 0, -1.0, 0.0, None), ("a", 0, 1, 1.0, 9.0, None), ("b", 0, 0, 1.0, 1.0, None), ("b", 0, 1, 1.0, 1.0, 0.5)], "tile_id string, row int, col int, ndwi double, mndwi double, ndvi double")
    shown = {r.tile_id: pixels_of(r.png) for r in views.index_views(maps, "ndwi", 2).collect()}
    assert shown["a"][0, 0].tolist() == [165, 0, 38, 255] and shown["a"][0, 1].tolist() == [49, 54, 149, 255] and shown["a"][1, 0].tolist() == [0] * 4
    pairs = spark.createDataFrame([("a", "b")], "before_id string, after_id string")
    change = views.change_views(pairs, maps, "ndwi", 2).first()
    assert (change.before_id, change.after_id) == ("a", "b")
    assert pixels_of(change.png)[0].tolist() == [[49, 54, 149, 255], [255, 255, 191, 255]]
    assert pixels_of(views.change_views(pairs, maps, "ndvi", 2).first().png)[0].tolist() == [[0] * 4] * 2
    with pytest.raises(KeyError):
        views.index_views(maps, "other", 2)


def test_exports_and_summaries_tell_of_time_sequence_sensor_and_bands(spark):
    tiles = spark.createDataFrame([("a", "x", "2024-01-02 03:04:05", "s1"), ("b", "y", None, None)], "tile_id string, label string, timestamp string, sequence_id string")
    tiles = tiles.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    ranked = spark.createDataFrame([("a", 1, "b", 0.123456789)], "query_id string, rank int, tile_id string, score double")
    got = catalog.export_neighbours(ranked, tiles)
    assert got.columns == ["query_id", "query_label", "rank", "tile_id", "neighbour_label", "score", "query_timestamp", "neighbour_timestamp", "query_sequence", "neighbour_sequence"]
    assert tuple(got.first()) == ("a", "x", 1, "b", "y", "0.12345679", "2024-01-02T03:04:05", "", "s1", "")
    assert catalog.export_neighbours(ranked, tiles.select("tile_id", "label")).columns[-1] == "score"
    scenes = spark.createDataFrame([("available", None)], "asset_status string, timestamp timestamp")
    row = statistics.dataset_summary(scenes, "a sensor", ("B01", "B02")).first()
    assert (row.sensor, row.bands, row.catalog_scenes) == ("a sensor", ["B01", "B02"], 1) and "sensor" not in statistics.dataset_summary(scenes).columns


def test_runs_tell_how_many_queries_they_asked(spark, tmp_path):
    folder = tmp_path / "p" / "r1"
    folder.mkdir(parents=True)
    (folder / "result.json").write_text('{"architecture": "cnn", "modality": "rgb", "seed": 1, "gallery_count": 5, "test_query_count": 7}')
    for name in readers.SIBLINGS:
        (folder / name).write_bytes(b"x")
    row = readers.read_runs(spark, str(tmp_path)).first()
    assert (row.run_id, row.gallery_count, row.test_query_count) == ("p/r1", 5, 7)


def test_scene_catalog_asks_for_each_asset_once(spark):
    """Scenes and assets against plain loops; scenes are dealt once for the pairing and what is absent, and paths once each."""
    r, bands = random.Random(5), ("B03", "B11", "B12")
    sources, labels, files = [], [], []
    for k in range(60):
        folder = None if k % 13 == 0 else f"s/{k}"
        assets = {b: (f"img/{b}.tif" if k % 2 else f"{b}.tif",) for b in bands if r.random() < 0.8}
        sources.append((str(k), f"1996_01_0{k % 7 + 1}", [1.0, 2.0, 3.0, 4.0], {"datetime": "unknown"}, assets, folder))
        labels.append((str(k), f"1996_01_0{k % 7 + 1}", {"FLOODING": "true"}))
        files += [f"s/{k}/{href}" for href, in assets.values() if r.random() < 0.7]
    keys = "sequence_id string, date string, "
    first = spark.createDataFrame(sources, keys + "bbox array<double>, properties map<string,string>, assets map<string,struct<href:string>>, folder string").withColumn("id", F.col("sequence_id"))
    second = spark.createDataFrame(labels, keys + "properties map<string,string>")
    listing = spark.createDataFrame([(f,) for f in files * 2], "path string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalog.scene_catalog(first, second, listing, bands)
        got = {row.sequence_id: row for row in found.collect()}
        plan = found._jdf.queryExecution().sparkPlan().toString()
        executed = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(got) == len(sources)
    for k, _, _, _, assets, folder in sources:
        paths = {b: f"{folder}/{assets[b][0]}" if folder and b in assets else None for b in bands}
        missing = [b for b in bands if paths[b] not in files]
        assert got[k].missing_bands == missing and got[k].asset_status == ("missing" if missing else "available")
        assert {one.band: one.path for one in got[k].assets} == paths
    assert plan.count("Join") <= 3 and executed.count("Exchange hashpartitioning") <= 5, executed
    unsafe = first.where("sequence_id = '1'").withColumn("folder", F.lit("s/.."))
    with pytest.raises(Exception, match="unsafe path"):
        catalog.scene_catalog(unsafe, second.where("sequence_id = '1'"), listing, bands).collect()


@pytest.mark.parametrize("path, safe", [("a/b.tif", True), ("a..b/..c", True), ("..", False), ("a/..", False), ("a\\..\\b", False), ("../a", False), ("/a", False), ("C:a", False), ("s3://a", False), ("a/..\n", True)])
def test_safe_paths(spark, path, safe):
    rows = spark.createDataFrame([(path,)], "path string").select(catalog.safe_path(F.col("path")).alias("path"))
    if safe:
        assert rows.first().path == path
    else:
        with pytest.raises(Exception, match="unsafe path"):
            rows.collect()


def test_pairs_say_what_is_wrong_in_one_pass(spark):
    """Keys that repeat, lack a partner or hold a null, on either side; all four questions are one aggregate."""
    rows = lambda *keys: spark.createDataFrame([(k, d) for k, d in keys], "k string, d int")
    good = rows(("a", 1), ("b", 2))
    assert sorted(tuple(r) for r in catalog.pair_items(good, good, "k", "d").collect()) == [("a", 1), ("b", 2)]
    assert catalog.pair_items(rows(), rows(), "k", "d").count() == 0
    for first, second, said in (
        (rows(("a", 1), ("a", 1)), rows(("a", 1)), "source items repeat"), (rows(("a", 1)), rows(("a", 1), ("a", 1)), "label items repeat"),
        (good, rows(("a", 1)), "source items lack"), (rows(("a", 1)), good, "label items lack"), (rows(("a", None)), rows(("a", None)), "source items lack"),
    ):
        with pytest.raises(ValueError, match=said):
            catalog.pair_items(first, second, "k", "d")
