"""Extra: new calls appended to a stored table as they arrive.

Each micro-batch becomes sites by position within its own files, so readers prune by
the same statistics; blocks are renumbered by the next rewrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from varloom.functions import stats


def append(calls: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stream long calls (all cells of a site in one batch) into ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        # A batch has a folder of its own, so one that is run again replaces itself.
        wide = stats.to_wide(batch).repartitionByRange("cidx", "pos").sortWithinPartitions("cidx", "pos", "vid")
        wide.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")

    writer = calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The appended sites."""
    return spark.read.parquet(path).drop("batch")
