"""Queries over the driver's tables, one for each operator of the subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import centroids, conversations, embedding_forest, extraction, licenses, mixing, neighbours, packing, quality, scoring, secrets, simhash, sql, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("print")).alias("fingerprint"), "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by way of the blob ledger: a rule joins the two of an earlier scan, whose pairs are not scanned again."""
    docs = _table(spark, sf_dir, "documents")
    earlier = {kind: version for kind, version in secrets.RULES.items() if kind != "access"}
    _, ledger = secrets.scan_secrets(docs, None, earlier)
    findings, _ = secrets.scan_secrets(docs, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    said = findings.withColumn("said", secrets.named(F.col("spans")))
    return said.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2("said", 256).alias("base_sha256"),
        F.col("said").alias("spans"),
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken")
    )


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return scoring.score(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    folder = warc.archive_folder(spark)
    manifest = warc.write_archive(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(manifest, folder, with_blocks=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    found = quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("row.doc_id").alias("doc_id"), *quality.BASE, "base_failed", "kept")


def op11_kd_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster of eight after ten rounds."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=8, width=64, rounds=10, seed=3)


def op12_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    return embedding_forest.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after the damage that ids choose."""
    turns = _table(spark, sf_dir, "conversations")
    return conversations.repair(turns, conversations.damaged(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_source_mix": op3_source_mix,
    "op4_context_mixing": op4_context_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_learned_partitions": op6_learned_partitions,
    "op7_main_text": op7_main_text,
    "op8_retrieval_packing": op8_retrieval_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc_archive": op10_warc_archive,
    "op11_kd_centroids": op11_kd_centroids,
    "op12_projection_forest": op12_projection_forest,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op2_secret_scan": sql.OP2,
    "op3_source_mix": sql.OP3,
    "op10_warc_archive": sql.OP10,
    "op11_kd_centroids": sql.OP11,
    "op12_projection_forest": sql.OP12,
    "op13_conversation_repair": sql.OP13,
}
