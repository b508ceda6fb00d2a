"""Positions in a global order without a global window.

The rows are dealt to ranges of the order by sampled bounds, so ranges are even whatever the keys look
like, and sorted within each. A row's place in its range comes with the sort; what stands before the
range is a prefix sum over one row a range. The dealt rows are written to the shared folder once: a
second evaluation could sample other bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row of the partition below


def ranked(df: DataFrame, order: Sequence[str | Column], rank_col: str = "_rank") -> DataFrame:
    """df with ``rank_col``: the 0-based position of each row in ``order`` (nulls first unless it says
    otherwise). Rows that are equal in it stand next to each other in any order.

    Runs a job: the rows are written, sorted by range."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = written(dealt, "ranked").withColumn("__part", F.shiftright("__id", _ROW_BITS))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # one small row a range, and no more ranges than shuffle partitions: safe to broadcast
    return rows.join(F.broadcast(offsets), "__part").withColumn(rank_col, place.cast("long")).drop("__id", "__part", "__before")
