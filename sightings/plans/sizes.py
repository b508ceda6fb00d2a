"""Broadcast hints that depend on a size that was looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 100_000
MAX_BYTES = 8 << 20


def known_bytes(df: DataFrame) -> int:
    """The optimizer's estimate for df; very large where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized_broadcast(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small, else as it is.

    Where the optimizer knows a size below its own threshold it decides by itself and nothing runs.
    Otherwise at most ``max_rows`` + 1 rows are counted, with the length of their text; only a side that
    stays within both bounds is hinted."""
    spark = df.sparkSession
    threshold = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if known_bytes(df) <= threshold:
        return df
    width = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
