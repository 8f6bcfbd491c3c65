"""Temporal pairs over a stream agree with the batch window."""

import datetime as dt

from tilewright.operators import spectral
from tilewright.streaming.pairs import stream_pairs

SCHEMA = "tile_id string, sequence_id string, timestamp timestamp"


def test_stream_matches_batch(spark, tmp_path):
    rows = [(f"t{k:02d}", f"{k % 3:04d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=3 * k)) for k in range(20)]
    for part, chunk in enumerate((rows[:10], rows[10:])):
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = stream_pairs(stream, 30).writeStream.format("memory").queryName("pairs").outputMode("append")
    query = writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(map(tuple, spectral.temporal_pairs(spark.createDataFrame(rows, SCHEMA), 30).select("before_id", "after_id", "sequence_id", "gap_days").collect()))
    assert sorted(map(tuple, spark.table("pairs").collect())) == want and want


def run(spark, folder, chunks, name, **options):
    for part, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{part:02d}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    writer = stream_pairs(stream, 30, **options).writeStream.format("memory").queryName(name).outputMode("append")
    query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


def test_scenes_out_of_order_wait_for_the_watermark(spark, tmp_path):
    rows = [(f"t{k:02d}", f"{k % 3:04d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=3 * k)) for k in range(12)]
    mixed = [rows[k] for k in (2, 0, 1, 5, 3, 4, 7, 6, 9, 8, 10, 11)]
    end = [("end", "zzzz", dt.datetime(2025, 1, 1))]
    got = run(spark, tmp_path, [mixed[:5], mixed[5:9], mixed[9:], end, [("end2", "zzzz", dt.datetime(2026, 1, 1))]], "late_pairs", lateness="20 days")
    want = sorted(map(tuple, spectral.temporal_pairs(spark.createDataFrame(rows, SCHEMA), 30).select("before_id", "after_id", "sequence_id", "gap_days").collect()))
    assert got == want and want


def test_a_late_scene_without_lateness_is_an_error(spark, tmp_path):
    import pytest

    day = dt.datetime(2024, 1, 1)
    with pytest.raises(Exception, match="came after a later one"):
        run(spark, tmp_path, [[("b", "s", day + dt.timedelta(days=5))], [("a", "s", day)]], "wrong_pairs")
