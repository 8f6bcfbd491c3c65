"""Tables that cut lineage, written to the shared folder the cluster names in ``spark.checkpoint.dir``.

A scratch table survives lost executors: it is plain Parquet in storage that every executor reads. Where the setting is
absent (tests on one machine) a temporary folder takes its place. Tables go when the driver's process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: executors of {master} need a shared folder for scratch tables")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tilewright-"))
        found = _LOCAL[0]
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed when the innermost ``temporary`` block or the process ends."""
    path = f"{shared_dir(spark)}/tilewright-{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    atexit.register(remove_path, spark, path)
    return path


class temporary:  # noqa: N801  reads as a statement
    """Scratch tables written inside the block go when it ends, but for those written by ``keep``.

    What leaves the block must not read the others: give out kept tables, or frames over them and over inputs.
    """

    def __enter__(self) -> temporary:
        _OPEN.append([])
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written to outlive this block (but not one around it)."""
        held = _OPEN.pop()
        try:
            return materialize(df, name)
        finally:
            _OPEN.append(held)

    def __exit__(self, *_: object) -> None:
        spark = SparkSession.getActiveSession()
        for path in _OPEN.pop():
            if spark is not None:
                remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete ``path``, if the session still lives."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads it, so later stages neither recompute nor lose it; ``options`` go to the writer."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
