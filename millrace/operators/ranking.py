"""Numbering of rows in a global order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import pinned

_ROW_BITS = (1 << 33) - 1


def numbered(df: DataFrame, *order: Column | str, name: str = "rank", start: int = 0) -> DataFrame:
    """Adds ``name``: place of the row in the order, from ``start``.

    The sorted rows are checkpointed, so range, place within the range and rows before it agree whenever
    they are read; only one count for each range goes through a single task.
    """
    kept = pinned(df.orderBy(*order))
    placed = kept.withColumn("_mr_part", F.spark_partition_id()).withColumn("_mr_at", F.monotonically_increasing_id().bitwiseAND(_ROW_BITS))
    counts = kept.groupBy(F.spark_partition_id().alias("_mr_part")).agg(F.count(F.lit(1)).alias("_mr_n"))
    before = Window.orderBy("_mr_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_mr_part", F.coalesce(F.sum("_mr_n").over(before), F.lit(0)).alias("_mr_before"))
    return placed.join(offsets, "_mr_part").withColumn(name, (F.col("_mr_before") + F.col("_mr_at") + start).cast("bigint")).select(*df.columns, name)
