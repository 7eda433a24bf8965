"""Running sums over groups of any size: no group is ever one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.runtime import Stored

#: Rows that a task sorts at most, by intent; the number of ranges follows the rows.
RANGE_ROWS = 500_000


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, rows: int, out: str = "before") -> DataFrame:
    """df with, in out, the sum of value over the rows of its group that come before it in order.

    Rows are range-sorted by (group, order) and written; each range is summed on its own, and the sums of
    the ranges (as many rows as ranges and groups) are added up in between. order must be total within a
    group for a repeatable result; rows that tie in all of it come in an arbitrary, kept order.
    """
    ranges = max(4, -(-rows // RANGE_ROWS))
    ranged = Stored(df.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()).withColumn("_tie", F.monotonically_increasing_id()), "ranges").df
    local = Window.partitionBy("_range", *group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *group).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *group, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    summed = ranged.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    return summed.join(offsets, ["_range", *group]).withColumn(out, F.col("_local") + F.col("_offset")).drop("_range", "_tie", "_local", "_offset", "_total")
