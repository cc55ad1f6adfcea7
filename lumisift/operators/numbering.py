"""Consecutive numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def numbered(df: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """Adds ``name``: first, first + 1 ... in the given total order.

    Rows are range-partitioned and sorted apart; only one row per partition takes part in
    the running sum of partition sizes.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_k": F.monotonically_increasing_id()})
    t = cut(parts, "numbered")
    sizes = t.groupBy("_part").agg(F.count("*").alias("n"), F.min("_k").alias("k0"))
    start = sizes.select("_part", "k0", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_start"))
    return t.join(F.broadcast(start), "_part").select(*df.columns, (F.col("_start") + F.col("_k") - F.col("k0") + first).cast("long").alias(name))
