"""Operators on the hand-made inputs of FIXTURES.md."""

import datetime as dt
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import bootstrap, embed, evaluation, raster, request, search, spectral, splits, statistics
from tilewright.sources import catalog, readers, settings


def vectors(spark, rows):
    return spark.createDataFrame(rows, "tile_id string, embedding array<double>")


def order(df):
    return [r.tile_id for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("metric", search.METRICS)
def test_flat_order(spark, metric):
    rows = vectors(spark, [("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0]), ("d", [-1.0, 0.0])])
    one = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    found = search.top_k(rows, one, 4, metric)
    assert order(found) == ["a", "b", "c", "d"]
    b = found.where("tile_id = 'b'").first().score
    assert b == pytest.approx(0.4**0.5 if metric == "euclidean" else 0.8)


def test_flat_unnormalised_and_ties(spark):
    rows = vectors(spark, [("aligned", [0.7, 0.0]), ("large", [0.9, 0.5])])
    one = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert order(search.top_k(rows, one, 1)) == ["aligned"]
    assert order(search.top_k(rows, one, 1, "inner_product")) == ["large"]
    twins = vectors(spark, [("z", [1.0, 2.0]), ("a", [1.0, 2.0])])
    assert order(search.top_k(twins, one, 2)) == ["a", "z"]
    with pytest.raises(ValueError):
        search.top_k(rows, one, True)
    with pytest.raises(ValueError):
        search.check_vectors(vectors(spark, [("a", [0.0, 0.0])]))
    assert search.top_k(rows.limit(0), one, 3).count() == 0


def test_query_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = vectors(spark, [(f"t{k:02d}", rng.normal(size=4).tolist()) for k in range(40)])
    ask = rows.select(F.col("tile_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, search.top_k(rows, ask, 3).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    assert sorted(map(tuple, search.top_k(rows, ask, 3).collect())) == whole


def slow_top(rows, ask, k, metric):
    out = []
    for name, q in ask:
        q = np.array(q)
        how = {"cosine": lambda v: -float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), "inner_product": lambda v: -float(q @ v), "euclidean": lambda v: float(np.linalg.norm(q - v))}[metric]
        best = sorted((round(how(np.array(v)), 12), t) for t, v in rows if t != name)[:k]
        out += [(name, n, t) for n, (_, t) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", search.METRICS)
def test_equal_vectors_are_cut_in_their_task(spark, metric):
    """Ten thousand equal vectors: a task gives k rows for a query, the smallest ids, whatever the layout."""
    rows = [(f"t{k:05d}", [1.0, 2.0, 3.0]) for k in range(10_000)] + [("x", [3.0, 1.0, 0.5]), ("y", [-1.0, 0.0, 2.0])]
    ask = [(f"t{k:05d}", [1.0, 2.0, 3.0]) for k in range(3)] + [("q", [0.0, 1.0, 1.0])]
    table, asked = vectors(spark, rows).coalesce(1), spark.createDataFrame(ask, "query_id string, embedding array<double>")
    found = search._meet_few(table, asked.collect(), 10, metric, True)
    assert found.count() == 40
    key = lambda df: sorted((r.query_id, r.rank, r.tile_id) for r in df.collect())
    assert key(search.top_k(table, asked, 10, metric)) == slow_top(rows, ask, 10, metric) == key(search.top_k(table.repartition(5), asked, 10, metric))


def test_unusable_vectors_are_errors(spark):
    ask = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    good = [(f"t{k}", [1.0, k / 100]) for k in range(100)]
    for bad, said in (([0.0, 0.0], "zero vector"), ([1.0, float("nan")], "not finite"), ([float("inf"), 1.0], "not finite"), ([1.0, None], "not finite"), ([1.0], "length 1"), (None, "length -1")):
        with pytest.raises(Exception, match=f"bad has a .*{said}"):
            search.top_k(vectors(spark, [*good, ("bad", bad)]), ask, 3).collect()
    with pytest.raises(ValueError, match="query z has a zero vector"):
        search.top_k(vectors(spark, good), spark.createDataFrame([("z", [0.0, 0.0])], ask.schema), 3)
    zero = vectors(spark, [*good, ("zero", [0.0, 0.0])])
    assert search.top_k(zero, ask, 200, "euclidean").count() == 101 and search.top_k(zero, ask, 200, "inner_product").count() == 101
    with pytest.raises(ValueError, match=r"between 1 and the gallery's size \(100\), not 101"):
        search.top_k(vectors(spark, good), ask, 101, strict=True)
    assert search.top_k(vectors(spark, good), ask, 101).count() == 100
    for k in (0, 1.5, True):
        with pytest.raises(ValueError, match="positive integer"):
            search.top_k(zero, ask, k)


def test_many_queries_stay_off_the_driver(spark, monkeypatch):
    """Blocks of queries against blocks of the gallery: one scan, no union, the same rows as one block gives."""
    rng = np.random.default_rng(6)
    rows = [(f"t{k:03d}", rng.normal(size=3).tolist()) for k in range(240)]
    rows += [(f"t{240 + k}", rows[k // 20][1]) for k in range(60)]
    table = vectors(spark, rows).repartition(3)
    ask = table.select(F.col("tile_id").alias("query_id"), "embedding")
    monkeypatch.setattr(search, "QUERY_BLOCK", 64)
    monkeypatch.setattr(search, "GALLERY_BLOCK", 100)
    for metric in search.METRICS:
        found = search.top_k(table, ask, 7, metric)
        assert sorted((r.query_id, r.rank, r.tile_id) for r in found.collect()) == slow_top(rows, rows, 7, metric)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Union" not in plan
    with pytest.raises(Exception, match="bad has a zero vector"):
        search.top_k(table.unionByName(vectors(spark, [("bad", [0.0, 0.0, 0.0])])), ask, 7).collect()


def test_index_values(spark):
    rows = [(0, 0, True, 3.0, 1.0, 1.0, 1.0), (0, 1, True, 1.0, 1.0, 3.0, 1.0), (1, 0, True, 0.0, 0.0, 0.0, 0.0), (1, 1, False, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "row int, col int, valid boolean, b03 double, b04 double, b08 double, b11 double")
    got = {(r.row, r.col): r for r in spectral.index_maps(df).collect()}
    assert (got[0, 0].ndwi, got[0, 0].mndwi, got[0, 0].ndvi) == (0.5, 0.5, 0.0)
    assert got[1, 0].ndwi is None and got[1, 1].ndwi is None


def test_histogram_edges(spark):
    values = [-1.0, -5e-324, 0.0, 0.5, 1.0, 1.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.b for r in df.select(spectral.bin_of(F.col("v"), -1.0, 1.0, 32).alias("b")).collect()]
    want, _ = np.histogram(values[:5], 32, (-1, 1))
    assert got[-1] is None
    assert np.bincount(got[:-1], minlength=32).tolist() == want.tolist()


def test_temporal_pairs(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("a", "0001", day(0)), ("b", "0001", day(10)), ("c", "0001", day(50)), ("d", "1", day(3)), ("e", "1", day(45)), ("x", "1", None)]
    df = spark.createDataFrame(rows, "tile_id string, sequence_id string, timestamp timestamp")
    assert [(r.before_id, r.after_id, r.gap_days) for r in spectral.temporal_pairs(df, 30).collect()] == [("a", "b", 10)]


def test_pattern_metrics(spark):
    ranked = spark.createDataFrame([("q", "water", 1, "a"), ("q", "water", 2, "b"), ("q", "ice", 1, "a"), ("q", "ice", 2, "b")], "query_id string, category string, rank int, tile_id string")
    relevance = spark.createDataFrame([("b", "water"), ("c", "water")], "tile_id string, category string")
    totals = relevance.groupBy("category").agg(F.count("*").alias("relevant"))
    got = {r.category: r for r in evaluation.query_metrics(ranked, relevance, totals, 2).collect()}
    assert (got["water"].precision_at_k, got["water"].recall_at_k, got["water"].ap_at_k) == (0.5, 0.5, 0.25)
    assert (got["ice"].recall_at_k, got["ice"].ap_at_k) == (0.0, 0.0)
    by = evaluation.category_metrics(evaluation.query_metrics(ranked, relevance, totals, 2))
    assert [r.category for r in by.collect()] == ["water"]
    assert evaluation.macro_metrics(by.where("queries > 9")).first().map_at_k is None


def fold(sizes, fractions, seed):
    import hashlib

    total, counts, out = sum(sizes.values()), [0, 0, 0], {}
    order = sorted(sizes, key=lambda g: (-sizes[g], hashlib.sha256(f"{seed}:{g}".encode()).hexdigest()))
    for k, g in enumerate(order):
        empty = [j for j in range(3) if splits.SPLITS[j] not in out.values()]
        options = empty if len(order) - k == len(empty) else [0, 1, 2]
        pick = max(options, key=lambda j: (total * fractions[j] - counts[j], -j))
        out[g] = splits.SPLITS[pick]
        counts[pick] += sizes[g]
    return out


@pytest.mark.parametrize("seed", [1, 8, 17])
def test_grouped_split(spark, seed):
    r = random.Random(seed)
    for sizes in ({"0001": 5, "1": 4, "0002": 3, "0003": 2, "0004": 1}, {f"g{k}": r.randint(1, 9) for k in range(12)}, {"a": 3, "b": 2, "c": 2}):
        rows = [(f"{g}-{k}", g) for g, n in sizes.items() for k in range(n)]
        df = spark.createDataFrame(rows, "tile_id string, group_id string")
        got = {x.group_id: x.split for x in splits.grouped(df, (0.8, 0.1, 0.1), seed).select("group_id", "split").distinct().collect()}
        assert got == fold(sizes, (0.8, 0.1, 0.1), seed)
    with pytest.raises(ValueError):
        splits.grouped(df.where("group_id = 'a'"), (0.8, 0.1, 0.1), seed)


def test_support_groups():
    groups = [(f"s{k}", 2) for k in range(10)]
    labels = {g: {"flood", "no_flood"} for g, _ in groups}
    chosen = splits.support_groups(groups, labels, {"flood", "no_flood"}, 0.3, 17)
    assert len(chosen) == 3
    with pytest.raises(ValueError):
        splits.support_groups(groups, {g: {"flood"} for g, _ in groups}, {"flood", "no_flood"}, 0.3, 17)


def test_masked_moments(spark):
    rows = [("b1", 2.0, True), ("b1", 6.0, True), ("b1", 99.0, False), ("b2", 5.0, True)]
    got = {r.band: (r.mean, r.sd) for r in statistics.masked_moments(spark.createDataFrame(rows, "band string, value double, valid boolean")).collect()}
    assert got == {"b1": (4.0, 2.0), "b2": (5.0, 1e-12)}


def test_band_quantiles(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 500, 997)
    df = spark.createDataFrame([("b", int(v)) for v in values], "band string, value int")
    got = statistics.band_statistics(df).first()
    ranked = np.sort(values)
    for name, p in statistics.QUANTILES.items():
        assert got[name] == ranked[round(p * (len(values) - 1))]
    assert got.sd == pytest.approx(values.std())


def test_bootstrap(spark):
    rows = [("c", f"f{k % 5}", float(k % 7), float(k % 3)) for k in range(60)]
    got = bootstrap.field_intervals(spark.createDataFrame(rows, "category string, field_id string, recall_delta double, map_delta double"), 200, 5).first()
    sums, counts = np.zeros((5, 2)), np.zeros(5, np.int64)
    for _, f, a, b in rows:
        sums[int(f[1])] += (a, b)
        counts[int(f[1])] += 1
    draws = bootstrap.resampled(sums, counts, 200, 5)
    assert got.recall_low == pytest.approx(np.quantile(draws[:, 0], 0.025))
    assert got.map_high == pytest.approx(np.quantile(draws[:, 1], 0.975))


def test_deltas_intervals_and_macro_in_one_report(spark):
    r = random.Random(14)
    kind = "category string, query_id string, recall_at_k double, ap_at_k double"
    first = [(c, f"q{k}", r.random(), r.random()) for c in "xy" for k in range(30)]
    second = [(c, q, a + r.random(), b - r.random()) for c, q, a, b in first if q != "q3"] + [("z", "q1", 0.5, 0.5)]
    fields = [(f"q{k}", f"f{k % 7}") for k in range(30)]
    one, two, of = spark.createDataFrame(first, kind), spark.createDataFrame(second, kind), spark.createDataFrame(fields, "query_id string, field_id string")
    got = {x.category: x for x in bootstrap.field_deltas(one, two, of, 300, 9).collect()}
    assert set(got) == {"x", "y", None} and got[None].macro and got[None].fields is None
    before = {(c, q): (a, b) for c, q, a, b in first}
    for c in "xy":
        deltas = [(a - before[c, q][0], b - before[c, q][1], dict(fields)[q]) for k, q, a, b in second if k == c]
        sums, counts = np.zeros((7, 2)), np.zeros(7, np.int64)
        for a, b, f in deltas:
            sums[int(f[1])] += (a, b)
            counts[int(f[1])] += 1
        draws = bootstrap.resampled(sums, counts, 300, 9)
        want = (len(deltas), np.mean([d[0] for d in deltas]), np.mean([d[1] for d in deltas]), 7, *np.quantile(draws[:, 0], (0.025, 0.975)), *np.quantile(draws[:, 1], (0.025, 0.975)))
        assert tuple(got[c])[2:] == pytest.approx(want)
    assert got[None].recall_delta == pytest.approx((got["x"].recall_delta + got["y"].recall_delta) / 2) and got[None].paired_query_count == 58
    bare = bootstrap.field_deltas(one, two, of, 0).collect()
    assert len(bare) == 3 and all(x.map_low is None for x in bare)
    assert bootstrap.field_deltas(one.limit(0), two, of, 10).count() == 0
    with pytest.raises(Exception, match="no field for the query q29"):
        bootstrap.field_deltas(one, two, of.where("query_id <> 'q29'"), 10).collect()


def test_d4(spark):
    plane = np.arange(16).reshape(4, 4)
    df = spark.createDataFrame([("t", r, c, int(plane[r, c])) for r in range(4) for c in range(4)], "tile_id string, row int, col int, v int")
    seen = set()
    views = raster.d4_views(df, 4).toPandas()
    for (turns, flip), part in views.groupby(["quarter_turns", "flipped"]):
        out = np.zeros((4, 4), int)
        out[part.row, part.col] = part.v
        want = np.rot90(plane, turns)
        assert (out == (np.fliplr(want) if flip else want)).all()
        seen.add(out.tobytes())
    assert len(seen) == 8


def test_coarsened(spark):
    df = spark.createDataFrame([("t", r, c, True, float(r * 4 + c)) for r in range(4) for c in range(4)], "tile_id string, row int, col int, valid boolean, b double")
    got = {(r.row, r.col): r.b for r in raster.coarsened(df, 2, "b").collect()}
    assert got == {(0, 0): 2.5, (0, 1): 4.5, (1, 0): 10.5, (1, 1): 12.5}


def test_null_times_differ(spark):
    df = spark.createDataFrame([(None,), (dt.datetime(2024, 1, 5, 23, 59, 59, 999999),), (dt.datetime(2024, 1, 6),)], "ts timestamp")
    end = dt.date(2024, 1, 5)
    n = lambda *a, **b: df.where(request.within_dates(F.col("ts"), *a, **b)).count()
    assert n(None, None, null_passes=True) == 3 and n(None, None, null_passes=False) == 2
    assert n(None, end, null_passes=True) == 1


def test_boxes_over_the_dateline(spark):
    df = spark.createDataFrame([("in", 175.0, 0.0, 179.0, 1.0), ("out", 0.0, 0.0, 5.0, 1.0), ("null", None, 0.0, 5.0, 1.0)], "id string, w double, s double, e double, n double")
    got = df.where(request.boxes_meet(F.col("w"), F.col("s"), F.col("e"), F.col("n"), (170.0, -5.0, -170.0, 5.0))).collect()
    assert [r.id for r in got] == ["in"]


def test_places(spark):
    rows = [("us", "country", "United States", "United States", ["USA"]), ("us:ga", "admin1", "Georgia", "United States", []), ("ge", "country", "Georgia", "Georgia", []), ("x", "admin1", "Łódź", "Polska", None)]
    df = spark.createDataFrame(rows, "place_id string, level string, name string, country string, aliases array<string>")
    ids = lambda **k: [r.place_id for r in request.find_places(df, **k).collect()]
    assert ids(name="Georgia", level="admin1", country="usa") == ["us:ga"]
    assert ids(name="Georgia", level="admin1", country="Georgia") == []
    assert ids(name="łodz") == ["x"] and ids(name="") == []


def test_query_contract():
    with pytest.raises(ValueError):
        request.Query("flood", "x", start_date=dt.date(2024, 2, 1), end_date=dt.date(2024, 1, 1))
    with pytest.raises(ValueError):
        request.Query.of({"original_query": "x", "intent": "flood", "extra": 1})
    with pytest.raises(ValueError):
        request.Query("visual_similarity", "x").require_supported()
    request.Query("flood", "x", place_name="Georgia", place_level="admin1", place_country="USA", resolved_place_id="us:ga").require_supported()


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "tile_id string, embedding array<double>")
    catalog.write_embeddings(rows, f"file://{tmp_path}/e", run="r")
    assert catalog.read_embeddings(spark, f"file://{tmp_path}/e").count() == 2
    with pytest.raises(Exception):
        catalog.write_embeddings(rows, f"file://{tmp_path}/e")
    with pytest.raises(ValueError):
        catalog.check_embeddings(rows.unionByName(rows))
    given = spark.createDataFrame([("0001", "train"), ("1", "test")], "tile_id string, split string")
    catalog.write_splits(given, f"file://{tmp_path}/s")
    assert sorted(r.tile_id for r in catalog.read_splits(spark, f"file://{tmp_path}/s").collect()) == ["0001", "1"]


def test_stac_and_assets(spark, tmp_path):
    import json

    for name, item in (("a", "src_0001_2019_01_02"), ("b", "other")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "stac.json").write_text(json.dumps({"id": item, "bbox": [0, 0, 1, 1], "properties": {}, "assets": {}}))
    got = catalog.read_stac(spark, f"file://{tmp_path}", r"src_(\d{4})_(\d{4}_\d{2}_\d{2})").collect()
    assert [(r.sequence_id, r.date) for r in got] == [("0001", "2019_01_02")]
    tiles = spark.createDataFrame([("t",), ("u",)], "tile_id string")
    assets = spark.createDataFrame([("t", b) for b in catalog.BANDS], "tile_id string, band string")
    assert {r.tile_id: r.asset_status for r in catalog.missing_bands(tiles, assets).collect()} == {"t": "available", "u": "missing"}
    with pytest.raises(ValueError):
        catalog.pair_items(tiles, tiles.limit(1), "tile_id")
    assert catalog.inventory(spark, f"file://{tmp_path}", "*.json").count() == 2


def test_settings_and_folders():
    good = """
        reproducibility = {seed = 17}
        device = {mode = "auto"}
        outputs = {artifacts_dir = "a", experiments_dir = "/e"}
        dataset = {adapter = "x", root = "r", catalog = "c", expected_count = 3, expected_shape = [2, 8, 8], bands = ["B03", "B11"], value_scale = 10.0}
        split = {manifest = "s", train_fraction = 0.8, validation_fraction = 0.1, test_fraction = 0.1, seed = 17, stratify_by_label = true}
        loader = {batch_size = 4, num_workers = 0, pin_memory = false}
        visualization = {samples = 1, lower_percentile = 2, upper_percentile = 98, composites = {}}
        model = {statistics_csv = "b", embedding_dim = 8, cnn_channels = [8, 16, 32], vit_patch_size = 4, vit_width = 6, vit_depth = 1, vit_heads = 3, vit_mlp_ratio = 4}
        training = {epochs = 1, batch_size = 2, learning_rate = 0.1, weight_decay = 0.0, temperature = 0.1, retrieval_ks = [1, 5]}
        embedding = {models = ["cnn"], checkpoint_filename = "best.pt", batch_size = 1}
    """
    found = settings.load_settings(good, "/root")
    assert found["split"]["seed"] == 17 and found["outputs"] == {"artifacts_dir": "/root/a", "experiments_dir": "/e"}
    for a, b in (
        ("seed = 17}", "seed = 17, more = 1}"), ("{seed = 17}", "{}"), ("0.8", "0.9"), ('"auto"', '"tpu"'), ("[2, 8, 8]", "[3, 8, 8]"), ('"B11"', '"B03"'), ("value_scale = 10.0", "value_scale = 0.0"),
        ("composites = {}", 'composites = {rgb = ["B03", "B11", "B04"]}'), ("upper_percentile = 98", "upper_percentile = 2"), ("vit_patch_size = 4", "vit_patch_size = 3"), ("vit_heads = 3", "vit_heads = 4"),
        ("[8, 16, 32]", "[8, 16, 30]"), ("[1, 5]", "[5, 1]"), ('"best.pt"', '"x/best.pt"'), ('["cnn"]', '["cnn", "cnn"]'), ("num_workers = 0", "num_workers = -1"), ("training = {", "trainings = {"),
    ):
        assert a in good
        with pytest.raises(ValueError):
            settings.load_settings(good.replace(a, b, 1))
    assert readers.result_folder("q", "cosine", 5).endswith("_cosine_top5")


def test_mask_labels(spark):
    rows = [("t", "water", 1, 1, 1), ("t", "weed_cluster", 1, 0, 1), ("u", "drydown", 0, 1, 1)]
    df = spark.createDataFrame(rows, "tile_id string, category string, mask int, field int, boundary int")
    assert {r.tile_id: r.labels for r in readers.mask_labels(df, readers.ANOMALIES).collect()} == {"t": ["water"], "u": []}


def test_runs_and_judgments(spark, tmp_path):
    import json

    for name, smoke in (("a", False), ("b", True)):
        (tmp_path / "x" / name).mkdir(parents=True)
        (tmp_path / "x" / name / "result.json").write_text(json.dumps({"architecture": "cnn", "seed": 1, "smoke": smoke}))
        for sibling in readers.SIBLINGS:
            (tmp_path / "x" / name / sibling).write_bytes(b"x")
    (tmp_path / "x" / "c").mkdir()
    (tmp_path / "x" / "c" / "result.json").write_text(json.dumps({"architecture": "cnn", "seed": 1, "smoke": False}))  # not complete
    assert [r.run_id for r in readers.read_runs(spark, f"file://{tmp_path}").collect()] == ["x/a"]
    line = json.dumps({"query_id": "q", "rank": 1, "tile_id": "t", "judgment": "relevant"}) + "\n"
    (tmp_path / "one.jsonl").write_text(line)
    (tmp_path / "two.jsonl").write_text(line * 2)
    one = readers.read_judgments(spark, f"file://{tmp_path}/one.jsonl")
    audit = spark.createDataFrame([("q", 1, "t"), ("q", 2, "u")], "query_id string, rank int, tile_id string")
    assert [r.tile_id for r in readers.pending(audit, one).collect()] == ["u"]
    with pytest.raises(ValueError):
        readers.read_judgments(spark, f"file://{tmp_path}/two.jsonl")


def test_embed(spark):
    df = spark.createDataFrame([(f"t{k}", [float(k), 1.0, 2.0]) for k in range(5)], "tile_id string, values array<double>")
    got = embed.embed(df, embed.BandMeans(4)).collect()
    assert len(got) == 5 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in got)
    catalog.check_embeddings(spark.createDataFrame(got))


@pytest.mark.parametrize("metric", search.METRICS)
def test_what_a_search_holds_does_not_grow_with_the_block(metric):
    """Scores of a slice of rows are held at once, for each metric; ties at the cut and the order of slices change nothing."""
    r = np.random.default_rng(12)
    rows, queries = r.normal(size=(40_000, 16)), r.normal(size=(256, 16))
    rows[30_000:30_050] = rows[7]
    queries[3] = rows[7]
    tracemalloc.start()
    try:
        found = list(search.best_rows(queries, rows, 5, metric))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20  # one whole product takes 82 MB
    q, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
    whole = queries @ rows.T
    if metric == "euclidean":
        whole = -np.sqrt(np.maximum(0, (queries**2).sum(1)[:, None] + (rows**2).sum(1) - 2 * whole))
    elif metric == "cosine":
        whole /= np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)
    for one in (0, 3, 255):
        best = set(np.argsort(-whole[one])[:5].tolist())
        mine = set(at[q == one].tolist())
        assert best <= mine if one != 3 else True
        assert np.allclose(np.sort(-score[q == one] if metric == "euclidean" else score[q == one])[::-1][:5], np.sort(whole[one])[::-1][:5], atol=1e-6)
    if metric != "inner_product":
        assert {7, *range(30_000, 30_050)} <= set(at[q == 3].tolist())


def test_draws_of_a_bootstrap_take_little_memory():
    """Draws pass a bounded number at a time; the stream of the generator goes on, so the number changes no result."""
    r = np.random.default_rng(8)
    sums, counts = r.normal(size=(12_000, 2)), r.integers(1, 9, 12_000)
    tracemalloc.start()
    try:
        draws = bootstrap.resampled(sums, counts, 200, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 << 20
    drawn = np.random.default_rng(5).integers(0, 12_000, size=(200, 12_000))
    assert np.array_equal(draws, sums[drawn].sum(axis=1) / counts[drawn].sum(axis=1)[:, None])
