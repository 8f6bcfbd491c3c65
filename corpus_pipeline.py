"""The corpus pipeline: quality rules, near-duplicates, secrets, source mix and packing, each stage a table.

A stage takes ``(spark, docs, sf_dir)`` and returns documents for the next; the last returns packed pieces. Every stage
works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import mixing, packing, quality, resemblance, secrets, simhash
from tilewright.llm.queries import VOCABULARY
from tilewright.scratch import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_documents(docs, labels).select(*COLUMNS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components by SimHash, fingerprints within 4 bits being linked, joined where Jaccard similarities of 0.8 or more link them further."""
    by_simhash = materialize(simhash.near_duplicates(docs).select("doc_id", "digest", "root"), "simhash-components")
    return resemblance.near_duplicates(docs, by_simhash)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash as op1 links, or by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return simhash.one_of_each(docs, near_duplicates).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secrets.redacted_documents(docs).select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack_documents(docs, VOCABULARY, with_ids=False)


STAGES = [
    ("quality rules", reject_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_to_targets),
    ("packing", pack_windows),
]

#: The decision list is learned and texts are tokenized, which SQL cannot say; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's table is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nth, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if nth < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{nth}")
    return docs
