"""Rasters, pictures and named files: what is written is read, in part where a part is asked for, and faults are named."""

import json
import os
import pickle
import tracemalloc
import weakref

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_artifacts import tiff_bytes as interleaved

from tilewright.operators import views
from tilewright.sources import files, images, rasters, tiff


def packed_lzw(data):
    """Codes of 9 to 12 bits, highest bit first, that widen one code early."""
    table, out, width = {bytes([k]): k for k in range(256)}, [(256, 9)], 9
    size, held = 258, b""
    for k in range(len(data)):
        one = data[k : k + 1]
        if held + one in table:
            held += one
            continue
        out.append((table[held], width))
        table[held + one] = size
        size += 1
        width = 12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9
        if size == 4094:
            out.append((256, width))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        held = one
    out += [(table[held], width)] if held else []
    size += bool(held)
    width = 12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9
    bits = "".join(f"{code:0{w}b}" for code, w in [*out, (257, width)])
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


@pytest.mark.parametrize("n", [0, 1, 300, 5000, 40_000])
def test_lzw_round_trip(n):
    for data in (b"ab" * n, np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes(), bytes(n), np.random.default_rng(n).integers(0, 3, n).astype(np.uint8).tobytes()):
        assert tiff.unpacked_lzw(packed_lzw(data)) == data
    with pytest.raises(ValueError, match="broken"):
        tiff.unpacked_lzw(b"\xff\xff\xff")


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.int16, np.float32])
def test_written_rasters_read_back(kind):
    image = (np.random.default_rng(3).random((3, 6, 5)) * 100).astype(kind)
    data = tiff.tiff_bytes(image, 32633, (500.0, 900.0), (20.0, 10.0), 7)
    head = tiff.read_header(data)
    assert (head.shape, head.epsg, head.bounds, head.nodata, head.resolution) == ((3, 6, 5), 32633, (500.0, 840.0, 600.0, 900.0), 7.0, (20.0, 10.0))
    assert head.dtype == str(np.dtype(kind)) and np.array_equal(tiff.read_pixels(data), image)
    for cut in (3, 9, len(data) - 3):
        with pytest.raises(ValueError):
            tiff.read_header(data[:cut])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("rasters")
    r = np.random.default_rng(4)
    for label in ("Forest", "River", "Sea/Deep"):
        (root / label).mkdir(parents=True)
        for k in range(3):
            image = r.integers(0, 1000, (4, 96, 96)).astype(np.uint16)
            (root / label / f"t{k}.tif").write_bytes(tiff.tiff_bytes(image, 32632 if k else 4326, (9.0, 48.0) if not k else (500_000.0, 5_000_000.0), (0.001, 0.001) if not k else (10.0, 10.0), 5))
    (root / "Forest" / "notes.txt").write_text("no raster")
    (root / "Sea" / "Deep" / "t9.TIF").write_bytes(interleaved(r.integers(0, 9, (4, 5, 6)).astype(np.uint16), packed=True, big=True))
    return root


def test_headers_by_ranges(spark, folder):
    rows = rasters.read_rasters(spark, str(folder)).collect()
    assert sorted((r.label, r.stem) for r in rows) == sorted([(x, f"t{k}") for x in ("Forest", "River", "Sea/Deep") for k in range(3)] + [("Sea/Deep", "t9")])
    large = [r for r in rows if r.file_bytes > 10_000]
    assert len(large) == 9 and sum(r.read_bytes for r in large) < 0.3 * sum(r.file_bytes for r in large) and all(r.read_bytes <= 2 * files.BLOCK for r in rows)
    for r in rows:
        head = tiff.read_header(open(r.path, "rb").read())
        assert (r.samples, r.height, r.width) == head.shape and (r.epsg, r.dtype, r.nodata) == (head.epsg, head.dtype, head.nodata)
        assert (r.left, r.bottom, r.right, r.top) == head.bounds and (r.x, r.y) == head.centre
    shared = rasters.read_rasters(spark, f"file://{folder}", parts="3").select("path").collect()
    assert sorted(r.path for r in shared) == sorted(r.path for r in rows)


def test_header_reads_do_not_grow_with_the_file(spark, tmp_path):
    (tmp_path / "a").mkdir()
    image = np.random.default_rng(1).integers(0, 60_000, (6, 400, 400)).astype(np.uint16)
    (tmp_path / "a" / "big.tif").write_bytes(tiff.tiff_bytes(image, 32632))
    r = rasters.read_rasters(spark, str(tmp_path)).first()
    assert r.read_bytes < 0.05 * r.file_bytes


def test_labels_leave_folders_unread(spark, folder):
    whole = rasters.read_rasters(spark, str(folder), parts="2")
    count = lambda df: df.rdd.getNumPartitions()
    assert count(whole) == 6 and count(whole.where("label = 'Forest'")) == 2 and count(whole.where("label IN ('Forest', 'Sea/Deep')")) == 4
    assert {r.label for r in whole.where("label = 'Sea/Deep'").collect()} == {"Sea/Deep"} and whole.where("label = 'Sea'").count() == 0
    assert whole.where("label = 'Forest' AND stem = 't1'").count() == 1


def test_records_have_positions(spark, folder):
    flat = rasters.read_rasters(spark, str(folder)).where("height = 96")
    records = {r.tile_id: r for r in tiff.tile_records(flat, "made", (4, 96, 96)).collect()}
    degrees, metres = records["made:Sea/Deep/t0"], records["made:Sea/Deep/t1"]
    assert (degrees.latitude, degrees.longitude, degrees.x_resolution) == (pytest.approx(47.952), pytest.approx(9.048), None)
    assert metres.x_resolution == 10.0 and metres.latitude == pytest.approx(45.149, abs=0.01) and metres.longitude == pytest.approx(9.0061, abs=1e-3)
    with pytest.raises(Exception, match="another shape"):
        tiff.tile_records(rasters.read_rasters(spark, str(folder)), "made", (4, 96, 96)).collect()


def test_pixels_of_chosen_bands(spark, folder):
    read = rasters.read_rasters(spark, str(folder), content="pixels", bands="a,b,c,d", select="c,a", value_scale="10")
    one = read.where("label = 'River' AND stem = 't1'")
    image = tiff.read_pixels((folder / "River" / "t1.tif").read_bytes())
    for r in one.where("row % 17 = 3 AND col % 13 = 5").collect():
        raw = image["abcd".index(r.band), r.row, r.col]
        assert r.value == np.float32(raw) / np.float32(10) and r.valid == (raw != 5)
    assert {r.band for r in one.select("band").distinct().collect()} == {"a", "c"} and one.count() == 2 * 96 * 96
    for wrong, said in (({}, "names of the bands"), ({"bands": "a,b", "select": "z"}, "unknown bands"), ({"bands": "a,b"}, "4 bands where 2"), ({"bands": "a", "parts": "0"}, "positive")):
        with pytest.raises(Exception, match=said):
            rasters.read_rasters(spark, str(folder), content="pixels", **wrong).count()


def test_a_broken_raster_is_named(spark, tmp_path):
    (tmp_path / "x").mkdir()
    good = tiff.tiff_bytes(np.ones((1, 4, 4), np.uint16))
    (tmp_path / "x" / "broken.tif").write_bytes(good[:40])
    with pytest.raises(Exception, match="could not read the header of .*broken.tif"):
        rasters.read_rasters(spark, str(tmp_path)).count()
    (tmp_path / "x" / "broken.tif").write_bytes(b"no raster at all")
    with pytest.raises(Exception, match="broken.tif: not a TIFF file"):
        rasters.read_rasters(spark, str(tmp_path)).count()


def saved(spark, path, kind, pixels, form="png"):
    """A picture by the JVM's own writer; ``pixels`` are rows of 0xRRGGBB."""
    jvm = spark.sparkContext._jvm
    picture = jvm.java.awt.image.BufferedImage(len(pixels[0]), len(pixels), kind)
    for y, row in enumerate(pixels):
        for x, v in enumerate(row):
            picture.setRGB(x, y, v)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    assert jvm.javax.imageio.ImageIO.write(picture, form, jvm.java.io.File(path))


RGB, GRAY, GRAY16, BITS = 1, 10, 11, 12


@pytest.fixture
def field(spark, tmp_path):
    """Two tiles of agricultural pictures: one inside its field, one whose water lies outside."""
    white = 0xFFFFFF
    for stem, inside in (("one", white), ("two", 0)):
        saved(spark, f"{tmp_path}/images/rgb/{stem}.jpg", RGB, [[0x204060] * 8] * 8, "jpg")
        saved(spark, f"{tmp_path}/images/nir/{stem}.png", GRAY, [[0x808080 if (x, y) == (2, 1) else 0 for x in range(8)] for y in range(8)])
        saved(spark, f"{tmp_path}/masks/{stem}.png", BITS, [[inside if x == 5 else white for x in range(8)] for _ in range(8)])
        saved(spark, f"{tmp_path}/boundaries/{stem}.png", GRAY, [[white] * 8] * 8)
        for category in images.ANOMALIES:
            on = {"water": (5, 3), "drydown": (1, 1) if stem == "one" else None}.get(category)
            saved(spark, f"{tmp_path}/labels/{category}/{stem}.png", GRAY if category != "drydown" else BITS, [[white if (x, y) == on else 0 for x in range(8)] for y in range(8)])
    return tmp_path


def test_pictures_to_pixels_and_labels(spark, field):
    read = images.with_roles(images.read_images(spark, str(field)))
    assert {r.stem: r.labels for r in images.mask_labels(read).collect()} == {"one": ["drydown", "water"], "two": []}
    cells = images.image_pixels(read)
    assert cells.columns == ["stem", "row", "col", "r", "g", "b", "nir"] and cells.count() == 128
    at = {(r.row, r.col): r for r in cells.where("stem = 'one'").collect()}
    assert at[1, 2].nir > 0 and at[2, 1].nir == 0
    assert all(abs(v - w) <= 3 for v, w in zip((at[4, 4].r, at[4, 4].g, at[4, 4].b), (0x20, 0x40, 0x60), strict=True))
    assert images.image_pixels(read, nir=False).columns == ["stem", "row", "col", "r", "g", "b"]


def test_incomplete_and_broken_pictures(spark, field):
    read = lambda: images.with_roles(images.read_images(spark, str(field)))
    os.remove(field / "labels" / "endrow" / "two.png")
    with pytest.raises(Exception, match=r"tile two lacks the masks \['endrow'\]"):
        images.mask_labels(read()).collect()
    saved(spark, str(field / "labels" / "endrow" / "two.png"), GRAY, [[0] * 4] * 4)
    with pytest.raises(Exception, match="tile two has pictures of unlike size"):
        images.mask_labels(read()).collect()
    os.remove(field / "images" / "nir" / "two.png")
    with pytest.raises(Exception, match="no near infrared picture matches the tile two"):
        images.image_pixels(read()).collect()
    (field / "labels" / "endrow" / "two.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    with pytest.raises(Exception, match="could not decode .*endrow/two.png"):
        images.mask_labels(read()).collect()
    saved(spark, str(field / "labels" / "endrow" / "two.png"), GRAY16, [[0x800000] * 8] * 8)
    with pytest.raises(ValueError, match="sixteen bits.*endrow/two.png"):
        read()
    (field / "labels" / "endrow" / "two.png").write_bytes(views.png_bytes(np.zeros((8, 8, 4), np.uint8)))
    saved(spark, str(field / "labels" / "endrow" / "two.jpg"), GRAY, [[0] * 8] * 8, "jpg")
    with pytest.raises(Exception, match="tile two has two files of one role"):
        images.mask_labels(read()).collect()


def rows_of(spark, named):
    return spark.createDataFrame(list(named.items()), "name string, content binary")


def test_files_commit_by_manifest(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert files.committed(path) is None
    files.write_files(rows_of(spark, {"a/x.bin": b"one", "y.bin": b"two" * 1000}), f"file://{path}")
    assert open(f"{path}/a/x.bin", "rb").read() == b"one" and files.committed(path)["files"] == 2 and files.committed(path)["bytes"] == 3003
    assert not [x for x in os.listdir(path) if x.startswith("_staged")]
    with pytest.raises(Exception, match="already holds committed files"):
        files.write_files(rows_of(spark, {"z": b""}), path)
    files.write_files(rows_of(spark, {"a/x.bin": b"new"}), path, overwrite=True)
    assert open(f"{path}/a/x.bin", "rb").read() == b"new" and files.committed(path)["files"] == 1


def test_failed_writes_leave_nothing_and_can_be_repeated(spark, tmp_path):
    for k, (bad, said) in enumerate((({"ok": b"1", "../out": b"2"}, "unsafe"), ({"ok": b"1", "/x": b"2"}, "unsafe"), ({"_COMMITTED": b"2"}, "unsafe"), ({"a:b": b""}, "unsafe"), ({"ok": b"1", "n": None}, "no content"))):
        path = f"{tmp_path}/bad{k}"
        with pytest.raises(Exception, match=said):
            files.write_files(rows_of(spark, bad), path)
        assert files.committed(path) is None and not (os.path.isdir(path) and os.listdir(path))
        files.write_files(rows_of(spark, {"ok": b"good"}), path)
        assert open(f"{path}/ok", "rb").read() == b"good"
    twice = rows_of(spark, {"n": b"1"}).unionByName(rows_of(spark, {"n": b"2"}))
    with pytest.raises(Exception, match="files of one name"):
        files.write_files(twice, f"{tmp_path}/twice")


def test_a_repeated_attempt_counts_once(tmp_path):
    """Of two attempts at one task only the one whose message arrives is seen; a commit that broke off can be run again."""
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([b"1", b"2"], pa.binary())], ["name", "content"])
    writer = files.NamedFilesWriter(str(tmp_path / "w"), False)
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    os.makedirs(tmp_path / "w", exist_ok=True)
    (tmp_path / "w" / "a").write_bytes(b"from a commit that broke off")
    writer.commit([None, kept])
    assert lost.folder != kept.folder and sorted(os.listdir(tmp_path / "w")) == ["_COMMITTED", "a", "b"]
    assert (tmp_path / "w" / "a").read_bytes() == b"1" and json.loads((tmp_path / "w" / "_COMMITTED").read_text())["files"] == 2


def test_ranges_read_what_is_asked(tmp_path):
    data = bytes(range(256)) * 200
    (tmp_path / "f").write_bytes(data)
    ranges = files.Ranges(*files.store_of(str(tmp_path / "f")))
    assert ranges(5, 10) == data[5:15] and ranges.taken == 4096
    assert ranges(4090, 20) == data[4090:4110] and ranges(len(data) - 3, 10) == data[-3:] and ranges(len(data) + 5, 4) == b""
    ranges.close()


@pytest.mark.parametrize("name", ["raster_header_scan", "raster_pixel_read"])
def test_rasters_are_read_in_a_session_without_pushdown(spark, name):
    """Spark's default: it hands no filters to Python sources, and refuses a reader that would take them."""
    from test_oracle import SF, plain

    from tilewright.plans import queries as plans

    con = duckdb.connect()
    for table in ("lineitem", "supplier"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(plans.SQL[name]).df()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        got = plans.QUERIES[name](spark, SF).toPandas()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert len(got) and plain(got, list(want.columns)) == plain(want, list(want.columns))


def test_labels_named_leave_folders_unread_without_pushdown(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        read = rasters.read_rasters(spark, str(folder), labels=["Forest", "Sea/Deep"], parts="2")
        assert read.rdd.getNumPartitions() == 4 and {r.label for r in read.collect()} == {"Forest", "Sea/Deep"}
        assert rasters.read_rasters(spark, str(folder), labels=[]).count() == 0
        whole = rasters.read_rasters(spark, str(folder))
        assert whole.where("label = 'River'").count() == 3
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_pictures_no_role_asks_for_are_not_opened(spark, tmp_path):
    """The role is told by the path, so a broken file of another role is no fault; paths with spaces and signs are as they are."""
    root = tmp_path / "a b+c%20d"
    for folder in ("images/rgb", "images/nir", "masks"):
        (root / folder).mkdir(parents=True)
        (root / folder / "t1.png").write_bytes(views.png_bytes(np.full((3, 2, 3), 7, np.uint8)))
    (root / "masks" / "t1.png").write_bytes(b"no picture")
    read = images.with_roles(images.read_images(spark, str(root), check_depth=False))
    assert sorted(r.role for r in read.select("role").collect()) == ["field", "nir", "rgb"]
    found = images.image_pixels(read).collect()
    assert len(found) == 6 and {(r.stem, r.r, r.g, r.b, r.nir) for r in found} == {("t1", 7, 7, 7, 7)}
    assert len(read.where("role = 'nir'").select("stem", "data").inputFiles()) <= 3 and read.where("role = 'nir'").rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="could not decode"):
        read.where("role = 'field'").select("data").collect()


def test_each_picture_is_decoded_once_for_labels(spark, tmp_path):
    for folder in ("images/rgb", "masks", "boundaries", "labels/x"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "t.png").write_bytes(views.png_bytes(np.full((3, 2, 3), 255, np.uint8)))
    found = images.mask_labels(images.with_roles(images.read_images(spark, str(tmp_path)), ("x",)), ("x",))
    assert [tuple(r) for r in found.collect()] == [("t", ["x"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def batches_of(names):
    return iter([pa.RecordBatch.from_arrays([pa.array(names), pa.array([b"1"] * len(names), pa.binary())], ["name", "content"])])


def test_what_a_commit_holds_does_not_grow_with_files(tmp_path):
    """The driver keeps all messages and commits them: neither is to hold a file's name, nor all moves at once."""
    said, held = [], []
    for n in (1_000, 20_000):
        writer = files.NamedFilesWriter(str(tmp_path / str(n)), False)
        message = writer.write(batches_of([f"part-{k % 7}/{k:06d}" for k in range(n)]))
        said.append(len(pickle.dumps(message)))
        tracemalloc.start()
        writer.commit([message])
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert files.committed(str(tmp_path / str(n)))["files"] == n and sum(len(x) for _, _, x in os.walk(tmp_path / str(n))) == n + 1
    assert said[1] < said[0] + 100 and held[1] < held[0] + 2_000_000


def test_many_lists_of_names_are_merged(tmp_path, monkeypatch):
    """Lists shorter than a task's files and more of them than are open at once; a name of two tasks is still found."""
    monkeypatch.setattr(files, "NAMES_A_LIST", 3)
    monkeypatch.setattr(files, "LISTS_AT_ONCE", 2)
    names = [f"{c}/{k}\n\u00e9" for k in range(9) for c in "cab"]
    writer = files.NamedFilesWriter(str(tmp_path / "w"), False)
    writer.commit([writer.write(batches_of(names[:20])), None, writer.write(batches_of(names[20:])), writer.write(iter([]))])
    assert sorted(x for x in os.listdir(tmp_path / "w")) == ["_COMMITTED", "a", "b", "c"] and all(len(os.listdir(tmp_path / "w" / c)) == 9 for c in "abc")
    writer = files.NamedFilesWriter(str(tmp_path / "v"), False)
    with pytest.raises(ValueError, match="files of one name: .*b/4"):
        writer.commit([writer.write(batches_of(names)), writer.write(batches_of(["d", names[14]]))])
    assert files.committed(str(tmp_path / "v")) is None


def in_shares(spark, monkeypatch, name):
    """The query with about two tiles a share and two shares a round against SQL; how many files each read listed."""
    from test_oracle import SF, plain

    from tilewright.plans import queries as plans

    listed, read = [], images.read_images

    def counted(*args, **kw):
        listed.append(len((out := read(*args, **kw)).inputFiles()))
        return out

    monkeypatch.setattr(images, "TILES_A_SHARE", 2)
    monkeypatch.setattr(images, "SHARES_A_ROUND", 2)
    monkeypatch.setattr(images, "read_images", counted)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = con.sql(plans.SQL[name]).df()
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert len(got) and plain(got, list(want.columns)) == plain(want, list(want.columns))
    return len(want), listed


def test_labels_are_read_a_few_shares_at_a_time(spark, monkeypatch):
    """The driver lists every file of a read, so no read is to list the files of all tiles."""
    tiles, listed = in_shares(spark, monkeypatch, "picture_mask_labels")
    assert len(listed) > 1 and sum(listed) == tiles * (3 + len(images.ANOMALIES)) and max(listed) < sum(listed)


def test_pixels_are_read_a_few_shares_at_a_time_and_of_two_roles(spark, monkeypatch):
    tiles, listed = in_shares(spark, monkeypatch, "picture_pixels")
    assert len(listed) > 1 and sum(listed) == tiles * 2 and max(listed) < sum(listed)


def test_over_shares_of_a_folder_without_shares(spark, field):
    found = images.over_shares(spark, str(field), ("rgb", "field", "boundary", *images.ANOMALIES), images.mask_labels)
    assert {r.stem: r.labels for r in found.collect()} == {"one": ["drydown", "water"], "two": []}


def test_a_round_s_frames_are_gone_before_the_next(spark, tmp_path, monkeypatch):
    """A frame keeps its listing in the driver, and Spark's cache of listings keeps those of frames that are gone."""
    for k in range(3):
        (tmp_path / f"share-0000{k}" / "masks").mkdir(parents=True)
        (tmp_path / f"share-0000{k}" / "masks" / f"t{k}.png").write_bytes(views.png_bytes(np.zeros((2, 2, 3), np.uint8)))
    monkeypatch.setattr(images, "SHARES_A_ROUND", 1)
    before, frames = spark.conf.get(images.LISTINGS_KEPT), []

    def found(read):
        assert not [1 for f in frames if f() is not None] and spark.conf.get(images.LISTINGS_KEPT) == "0"
        frames.append(weakref.ref(read))
        return read.select("stem", "height")

    rows = images.over_shares(spark, str(tmp_path), ("field",), found)
    assert sorted(map(tuple, rows.collect())) == [("t0", 2), ("t1", 2), ("t2", 2)] and len(frames) == 3
    assert spark.conf.get(images.LISTINGS_KEPT) == before
