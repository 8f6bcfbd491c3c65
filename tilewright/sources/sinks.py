"""Writers of results: statistics and audits, search results, judgments, selections, gazetteers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.sources.commits import exists
from tilewright.sources.readers import result_folder


def write_json(spark_rows: DataFrame, path: str, about: dict[str, object]) -> None:
    """A small JSON object as one text file; an existing one is an error. ``spark_rows`` lends its session."""
    spark = spark_rows.sparkSession
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def flat(rows: DataFrame) -> DataFrame:
    """``rows`` with nested columns as JSON text, ready for CSV."""
    nested = ("array", "map", "struct")
    return rows.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if k.startswith(nested) else F.col(f"`{c}`") for c, k in rows.dtypes])


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header, nested values as JSON text; an existing folder is an error."""
    flat(rows).write.mode("errorifexists").csv(path, header=True, escape='"')


def write_audit(statistics: DataFrame, classes: DataFrame, summary: dict[str, object], path: str) -> None:
    """Band statistics and class counts as CSV, the summary as JSON, and a report in Markdown of both small tables."""
    write_csv(statistics, f"{path}/band_statistics")
    write_csv(classes, f"{path}/class_counts")
    write_json(statistics, f"{path}/audit", summary)
    lines = ["# Data audit", ""]
    for title, table in (("Bands", statistics), ("Classes", classes)):
        lines += [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
        # One row a band and one a class and split.
        lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in table.orderBy(*table.columns[:2]).collect()] + [""]
    spark = statistics.sparkSession
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/report")


def write_search(results: DataFrame, root: str, query: str, metric: str, k: int) -> str:
    """Results as JSON lines and a summary, in a folder named by query, metric and depth; gives the folder."""
    folder = f"{root}/{result_folder(query, metric, k)}"
    results.write.mode("errorifexists").json(f"{folder}/results")
    write_json(results, f"{folder}/summary", {"query": query, "metric": metric, "k": k, "results": results.sparkSession.read.json(f"{folder}/results").count() if results.columns else 0})
    return folder


def audit_rows(ranked: DataFrame, queries: DataFrame, labels: DataFrame, depth: int = 5) -> DataFrame:
    """The first results of canonical queries for a reader: score to seven places, labels comma-joined.

    ``ranked(query_id, rank, tile_id, score)``, ``queries(query_id, query_text, target_label, canonical)``,
    ``labels(tile_id, labels)``.
    """
    asked = queries.where("canonical").select("query_id", "query_text", "target_label")
    met = ranked.where(F.col("rank") <= depth).join(asked, "query_id").join(labels, "tile_id", "left")
    joined = F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ",")
    return met.select("query_id", "query_text", "target_label", "rank", "tile_id", F.format_string("%.7f", "score").alias("score"), joined.alias("labels"))


def append_judgments(rows: DataFrame, path: str, batch: str | None = None) -> str:
    """Judgments added to those under ``path`` as JSON lines, as a batch that counts once; gives its name.

    A batch is named by its content, if not by ``batch``. One that is there whole is left alone, one that broke off is
    written anew, others are never touched: a repeated append adds nothing.
    """
    if batch is None:
        known = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("x"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("s")).first()
        batch = hashlib.sha256(f"{known.n}:{known.x}:{known.s}".encode()).hexdigest()[:16]
    folder = f"{path}/batch-{batch}"
    if not exists(rows.sparkSession, f"{folder}/_SUCCESS"):
        rows.write.mode("overwrite").json(folder)
    return batch


def write_spectral_audit(measurements: DataFrame, sample: DataFrame, assets: DataFrame, summary: dict[str, object], path: str) -> None:
    """Three CSV tables (nested values as JSON text) and the summary."""
    for name, table in (("measurements", measurements), ("sample", sample), ("assets", assets)):
        write_csv(table, f"{path}/{name}")
    write_json(measurements, f"{path}/summary", summary)


def write_selection(presets: DataFrame, path: str, protocol: dict[str, object]) -> None:
    """The chosen preset of each architecture (a row each) with the protocol, as one JSON object."""
    chosen = {row.architecture: row.asDict() for row in presets.collect()}
    write_json(presets, path, {"protocol": protocol, "presets": chosen})


def write_gazetteer(places: DataFrame, path: str) -> None:
    """Places as gzipped JSON lines in order of id; a repeated id is an error."""
    if not places.groupBy("place_id").count().where("count > 1").isEmpty():
        raise ValueError("the gazetteer repeats an id")
    places.orderBy("place_id").write.mode("errorifexists").json(path, compression="gzip")


def checked_download(content: bytes, sha256: str) -> bytes:
    """``content`` if its digest is the one pinned for it."""
    if hashlib.sha256(content).hexdigest() != sha256:
        raise ValueError("the content does not match its pinned checksum")
    return content


def evidence_urls(tile: Column) -> dict[str, Column]:
    """Where a tile's preview and index map are served."""
    return {"preview_url": F.concat(F.lit("/api/tiles/"), tile, F.lit("/preview")), "index_url": F.concat(F.lit("/api/tiles/"), tile, F.lit("/indices/mndwi"))}
