"""Row numbers within a contig without one task holding it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stretch of positions whose rows are numbered together.
STRETCH = 1 << 16


def numbered(df: DataFrame, group: str, pos: str, ties: list[str], name: str = "row", stretch: int = STRETCH) -> DataFrame:
    """``name``: the row's number from 0 within ``group`` by ``pos``, then ``ties``."""
    cut = df.withColumn("_part", F.floor(F.col(pos) / stretch))
    counts = cut.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(pos, *ties)) - 1
    joined = cut.withColumn("_inside", inside).join(starts, F.col(group).eqNullSafe(F.col("_g")) & F.col("_part").eqNullSafe(F.col("_p")))
    return joined.withColumn(name, F.col("_start") + F.col("_inside")).select(*df.columns, name)
