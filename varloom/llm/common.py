"""Helpers that the operators share: scratch tables, batches, running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles at a time; bounds a worker's memory.
CHUNK_BYTES = 4 << 20

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch for Python while a scratch table is written: both sides hold a batch
#: about twice, so batches of documents stay small.
BATCH_ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Where that is unset a temporary
    one is set, but only in a session whose tasks run on this machine (such as a test's)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="varloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first longer form of it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_whole_rows(df: DataFrame, run) -> DataFrame:
    """``df.mapInArrow(run, df.schema)`` for columns of any name; ``run`` goes by place."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


class Scratch:
    """Tables written to the shared folder to cut lineage; lost executors then
    recompute no more than the stage since the last table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.held: dict[str, str] = {}

    def table(self, df: DataFrame, name: str = "t", batch_rows: int = BATCH_ROWS) -> DataFrame:
        """Write ``df``; its shuffle files go as soon as the write ends.  Python gets
        at most ``batch_rows`` rows at a time."""
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        with _writing(self.spark, batch_rows):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.held[path] = name
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any longer."""
        self._remove(df._scratch_path)

    def drop_named(self, *names: str) -> None:
        """Remove the tables of these names."""
        for held in [p for p, name in self.held.items() if name in names]:
            self._remove(held)

    def _remove(self, held: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(held)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.held.pop(held, None)


@contextmanager
def _writing(spark: SparkSession, batch_rows: int):
    wanted = {CLEANUP: "true", BATCH: str(batch_rows)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text_chunks(batch: pa.RecordBatch, column: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each (one
    document at least, however long)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def byte_buffer(batch: pa.RecordBatch, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array, and the offsets of each (nulls
    are empty)."""
    arr = batch.column(column)
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def running_sums(df: DataFrame, group: list[str], chunk: str, value: Column, before: str) -> DataFrame:
    """One row per (group, chunk) with ``before``, the sum of ``value`` over the
    chunks of the group that come earlier.  With chunks of about the square root of
    a group, neither this window nor one over a chunk holds a hot group whole."""
    sums = df.groupBy(*group, chunk).agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, chunk, F.coalesce(F.sum("_v").over(w), F.lit(0)).alias(before))
