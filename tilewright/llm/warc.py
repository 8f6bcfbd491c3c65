r"""A deterministic sharded WARC writer and its reader.

Records are ordered by id. Shard borders are every ``SHARD_RECORDS``-th id of that order, found by counting, so they do
not depend on sampling or on the cluster. A shard's task writes its records, one gzip member each, and rolls to the next
file when ``ROLL_BYTES`` of compressed data are reached. Headers, lengths and digests are made anew from the payloads;
record ids and dates follow from the content, so equal input gives equal bytes.

Files appear under temporary names that hold the attempt. Each task returns the manifest rows of what it wrote; only
files named there are renamed, by one more pass of tasks, and the manifest is written last. A lost executor's attempt
leaves at most a temporary file, which the commit sweeps away with the folder.

Payloads of at least ``LEAST_PAYLOAD`` bytes that repeat are ``revisit`` records without content; the one with the
smallest id is the ``response``.

Defined cases: null html is an empty payload; null url is written as an empty target; rows with a null id come last, in
a shard range of their own, and answer for others only where no row with an id has the payload; of rows that repeat an id
and a payload one is the response and the others revisit it; an empty table writes an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions.text import filled
from tilewright.llm.sized import checked
from tilewright.scratch import fresh_path, materialize

SHARD_RECORDS = 4096
ROLL_BYTES = 16 << 20
LEAST_PAYLOAD = 100
MOST_TASKS = 20_000
_PIECE = 1 << 14
DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"
MANIFEST = "shard long, part long, name string, temporary string, records long, bytes long, sha256 string"


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, record_type, refers_to``.

    The response of each payload is found on digests alone, summed before they are dealt; a payload that a third of all
    pages share is one row of that table.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), filled(F.col("url")).alias("url"), filled(F.col("html")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    narrow = rows.select("page_id", "digest", F.octet_length("payload").alias("long"))
    seen = narrow.where(F.col("long") >= LEAST_PAYLOAD).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("n")
    )
    seen = materialize(
        seen.where("n > 1").select(F.col("digest").alias("of_digest"), "first_id"), "warc-repeats"
    )
    met = rows.join(checked(seen, 120), rows["digest"] == seen["of_digest"], "left")
    revisit = F.col("of_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return met.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def shard_borders(pages: DataFrame, every: int = SHARD_RECORDS) -> list[int]:
    """The ids at which shards after the first begin: one number for ``every`` records, the only thing collected.

    Ids are ranked by sorting them in ranges and adding up the ranges' counts; ranks do not depend on where ranges end.
    """
    ids = pages.select(F.col("page_id").cast("long").alias("page_id")).where("page_id IS NOT NULL")
    ranged = ids.repartitionByRange("page_id").sortWithinPartitions("page_id")
    placed = materialize(
        ranged.select("page_id", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("nth")),
        "warc-ranks",
    ).withColumn("nth", F.col("nth").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ranks = placed.join(F.broadcast(counts.select("range", "before")), "range")
    at = ranks.where((F.col("before") + F.col("nth")) % every == 0).where(F.col("before") + F.col("nth") > 0)
    return sorted({r.page_id for r in at.select("page_id").collect()})


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record. Digests are written as base 32 SHA-256 of the full payload, for revisits too."""
    label = base64.b32encode(bytes.fromhex(digest)).decode().rstrip("=")
    name = lambda number: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{number}").urn
    block = b"" if kind == "revisit" else payload
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{label}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{name(refers_to)}>",
            f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}",
        ]
    return "\r\n".join(head).encode() + _END + block + _END


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:  # piece by piece, so what follows a member is never copied with it
            piece = view[at : at + _PIECE]
            if not piece:
                raise ValueError("the file ends inside a record")
            parts.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        record = b"".join(parts)
        head, _, rest = record.partition(_END)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        long = int(fields["Content-Length"])
        if rest[long:] != _END:
            raise ValueError(f"record {fields.get('WARC-Record-ID')} does not end where its length says")
        yield fields, rest[:long]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _gzip(record: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(record) + made.flush()


def write_archive(pages: DataFrame, folder: str, every: int = SHARD_RECORDS, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder`` and return the committed manifest.

    ``folder`` is a URI of a store that all executors reach. The manifest, Parquet in ``folder/manifest``, is what makes
    the archive complete; names are ``part-<shard>-<n>.warc.gz``.
    """
    spark = pages.sparkSession
    borders = np.array(shard_borders(pages, every), np.int64)
    nulls = len(borders) + 1

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.full(len(ids), nulls, np.int64)
        out[known] = np.searchsorted(borders, ids[known].astype("int64").to_numpy(), side="right")
        return pd.Series(out)

    rows = with_revisits(pages).withColumn("shard", shard_of("page_id"))
    order = ["shard", F.col("page_id").asc_nulls_last(), "digest", "record_type", "url"]
    tasks = min(len(borders) + 2, MOST_TASKS)
    dealt = rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions(*order)  # a shard a task

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(f"{root}/temporary", recursive=True)
        attempt = uuid.uuid4().hex
        made: list[tuple] = []
        out, shard, part, temporary, records, size, digest = None, None, 0, "", 0, 0, hashlib.sha256()

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((shard, part, f"part-{shard:08d}-{part:05d}.warc.gz", temporary, records, size, digest.hexdigest()))
                out = None

        last = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard or size >= roll_bytes:
                    close()
                    part = 0 if row["shard"] != shard else part + 1
                    shard, records, size, digest = row["shard"], 0, 0, hashlib.sha256()
                    temporary = f"temporary/{shard:08d}-{part:05d}-{attempt}"
                    out = store.open_output_stream(f"{root}/{temporary}", compression=None)
                kind, refers = row["record_type"], row["refers_to"]
                same = (row["page_id"], row["digest"])
                if kind == "response" and same == last and len(row["payload"]) >= LEAST_PAYLOAD:
                    kind, refers = "revisit", row["page_id"]  # a repeated row revisits its like
                last = same
                data = _gzip(record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], kind, refers))
                out.write(data)
                digest.update(data)
                records, size = records + 1, size + len(data)
        close()
        names = ["shard", "part", "name", "temporary", "records", "bytes", "sha256"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*made, strict=True) if made else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if store.get_file_info(f"{root}/{row['temporary']}").type == fs.FileType.File:  # else a lost attempt moved it
                    store.move(f"{root}/{row['temporary']}", f"{root}/{row['name']}")
            yield batch

    written = materialize(dealt.mapInArrow(write, MANIFEST), "warc-written")
    written.mapInArrow(commit, MANIFEST).write.parquet(f"{folder}/manifest")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/temporary")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return spark.read.schema(written.schema).parquet(f"{folder}/manifest")


_READ = "page_id long, url string, block binary, block_bytes long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archive(manifest: DataFrame, folder: str, with_blocks: bool = True) -> DataFrame:
    """A row for each record of the files that the manifest names.

    Each file is checked against its digest. A response's payload is measured and digested anew; a revisit has what its
    headers say of the full payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        number = lambda x: int(x) if x else None
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{root}/{row['name']}", compression=None) as file:
                    data = file.read()
                if hashlib.sha256(data).hexdigest() != row["sha256"]:
                    raise ValueError(f"{row['name']} is not what the manifest says")
                out: list[tuple] = []
                for fields, block in read_records(data):
                    label = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    said = base64.b32decode(label + "=" * (-len(label) % 8)).hex()
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha256(block).hexdigest() != said:
                        raise ValueError(f"record {fields['WARC-Record-ID']} is not what its digest says")
                    long = int(fields["X-Payload-Length"]) if revisit else len(block)
                    out.append((
                        number(fields["X-Page-ID"]), fields["WARC-Target-URI"], block if with_blocks else None, len(block), long, said,
                        fields["WARC-Type"], number(fields.get("X-Refers-To-Page-ID")),
                    ))
                    if len(out) == 512:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    # By number: left to itself Spark would merge these few small rows, and so the reading of all files, into one task.
    return manifest.repartition(max(1, min(manifest.count(), MOST_TASKS)), "name").mapInArrow(read, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in _READ.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def archive_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return fresh_path(spark, "warc")
