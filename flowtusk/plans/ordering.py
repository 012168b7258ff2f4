"""Positions and running totals in a total order, without an unpartitioned window.

The rows are range-partitioned and sorted, which splits any key, however hot, evenly. The
sorted rows are stored with their partition number; the sizes of the partitions, one row each,
give every partition its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtusk.plans.storage import store

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _with_offsets(stored: DataFrame, amount) -> DataFrame:
    """Attach `__offset`, the total amount of all earlier partitions."""
    sums = stored.groupBy("__part").agg(F.sum(amount).cast("bigint").alias("__sum"))
    # One row per shuffle partition, so a single task can order them and broadcasting is bounded.
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    return stored.join(F.broadcast(offsets), "__part")


def with_global_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the order of `order`. Runs one job."""
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("__slot", F.monotonically_increasing_id())
              .withColumn("__part", F.shiftright("__slot", _SLOT_BITS)))
    stored = store(placed, "ordered")
    row = F.col("__slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (_with_offsets(stored, F.lit(1))
            .withColumn(name, F.col("__offset") + row)
            .drop("__slot", "__part", "__offset"))


def with_running_total(df: DataFrame, order: Sequence[str], amount: str, name: str = "before") -> DataFrame:
    """Add the total of `amount` over all rows that sort earlier. Runs one job."""
    placed = (df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    stored = store(placed, "ranged")
    earlier = (Window.partitionBy("__part").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, -1))
    return (_with_offsets(stored, F.col(amount))
            .withColumn(name, F.col("__offset") + F.coalesce(F.sum(amount).over(earlier), F.lit(0)))
            .drop("__part", "__offset"))
