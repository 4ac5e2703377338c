"""Helpers shared by the training-data operators: tables, staged tables, partition counts, batches of texts."""

from __future__ import annotations

import contextlib
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark frees a write's shuffle files when the write ends: what is staged doesn't need them.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of whole texts in an Arrow batch, where the session has Spark's default.
_BATCH, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Whole texts are long rows, so the session's Arrow batches become smaller, unless they were set."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, TEXT_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="headway-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here leaves no shuffle files behind."""
    was = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, was)


def stage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with freeing(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, whatever else the table has; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, by which buckets are counted."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def release() -> None:
    """Give freed memory back: workers are kept for later tasks, and what they hold adds up."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def freed(f: Callable) -> Callable:
    """A function of Arrow tables that gives back, after each group, the memory it freed."""

    def run(*tables: pa.Table) -> pa.Table:
        try:
            return f(*tables)
        finally:
            release()

    # what Spark reads the kind of function from
    run.__signature__ = inspect.signature(f)
    run.__annotations__ = dict(f.__annotations__)
    return run


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 256, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows and bytes of a text column at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        total = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right"))
            end = min(max(end, at + 1), at + rows)
            yield b.slice(at, end - at)
            at = end
    release()
