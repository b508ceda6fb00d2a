"""Ordered building blocks that split a key into blocks of its order.

Many operators of the reference walk one camera's frames in time order (failure counters, species
changes, cooldowns, visits). A window partitioned by ``source`` alone would put a whole camera - a
third of all rows, perhaps - into one task. Here a key is cut into blocks of its order, for instance
six hours of time: ordinary windows run within (key, block), one summary row per (key, block) carries
totals forward, and a join on (key, block) brings them back. There is one path for every size, it is
all lazy (building a query runs no job), and nulls in keys or order form a group of their own that
sorts first, as in Spark's windows.

* ``ordered_scan``: ranks, running sums and maxima, previous rows.
* rules that walk a key's rows with a state: ``plans.blocks``.
* ``cooldown_flags`` (``plans.cooldown``): the greedy "emit when at least C seconds since the last emission" rule.
* ``exact_rank_threshold``: the k-th smallest 64-bit hash from one bounded histogram and one small fetch,
  for exact-size splits without a global sort.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cooldown import cooldown_flags  # noqa: F401

BLOCK_S = 6 * 3600.0


def time_block(time_col: str, seconds: float = BLOCK_S) -> Column:
    """The block of a time in epoch seconds."""
    return F.floor(F.col(time_col) / F.lit(float(seconds)))


def _keyed(df: DataFrame, keys: Sequence[str], blocks: Sequence[Column]) -> DataFrame:
    """Adds __key and __blk, structs that are never null and equal if their fields are (null = null)."""
    names = [f"k{i}" for i in range(len(keys))]
    key = F.struct(F.lit(0).alias("z"), *[F.col(k).alias(n) for k, n in zip(keys, names)])
    blk = F.struct(F.lit(0).alias("z"), *[b.alias(f"b{i}") for i, b in enumerate(blocks)])
    return df.withColumns({"__key": key, "__blk": blk})


def _local(order: Sequence[str]):
    w = Window.partitionBy("__key", "__blk").orderBy(*order)
    return w, w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _dropped(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    blocks: Sequence[Column],
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lags: Mapping[str, str] | None = None,
    rank_col: str = "_rank",
) -> DataFrame:
    """Per key and in ascending ``order`` (a total order, nulls first), add

    * ``rank_col``: 0-based position of the row inside its key,
    * each ``sums[name]``: inclusive running sum,
    * each ``maxes[name]``: inclusive running max,
    * each ``lags[name] = col``: ``col`` of the previous row of the same key (null on the first).

    ``blocks`` cut a key's order: expressions that ascend with it, most significant first. A key's
    summary has one row per block and stands in one task; the rows themselves never do.
    """
    sums, maxes, lags = dict(sums or {}), dict(maxes or {}), dict(lags or {})
    w, w_run = _local(order)
    local = _keyed(df, keys, blocks).withColumns({
        "__pos": F.row_number().over(w), "__last": F.lead(F.lit(1)).over(w).isNull(),
        **{f"__s_{n}": F.sum(e).over(w_run) for n, e in sums.items()},
        **{f"__m_{n}": F.max(e).over(w_run) for n, e in maxes.items()},
        **{f"__l_{n}": F.lag(c).over(w) for n, c in lags.items()},
    })
    ends = local.where("__last").select(
        "__key", "__blk", "__pos", *[f"__s_{n}" for n in sums], *[f"__m_{n}" for n in maxes],
        F.struct(F.lit(0).alias("z"), *[F.col(c).alias(n) for n, c in lags.items()]).alias("__end"))
    per_key = Window.partitionBy("__key").orderBy("__blk")
    before = per_key.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        "__key", "__blk", F.coalesce(F.sum("__pos").over(before), F.lit(0)).alias("__off"),
        *[F.sum(f"__s_{n}").over(before).alias(f"__cs_{n}") for n in sums],
        *[F.max(f"__m_{n}").over(before).alias(f"__cm_{n}") for n in maxes],
        F.lag("__end").over(per_key).alias("__prev"))
    out = local.join(carry, ["__key", "__blk"])
    return _dropped(out.withColumns({
        rank_col: (F.col("__off") + F.col("__pos") - 1).cast("long"),
        **{n: F.when(F.col(f"__cs_{n}").isNull(), F.col(f"__s_{n}")).otherwise(
            F.col(f"__cs_{n}") + F.coalesce(F.col(f"__s_{n}"), F.lit(0))) for n in sums},
        **{n: F.greatest(F.col(f"__cm_{n}"), F.col(f"__m_{n}")) for n in maxes},
        **{n: F.when(F.col("__pos") == 1, F.col(f"__prev.{n}")).otherwise(F.col(f"__l_{n}")) for n in lags},
    }))


def exact_rank_threshold(df: DataFrame, hash_col: str, tie_col: str, rank: Callable[[int], int], fetch: int = 1 << 17):
    """The ``(hash, tie, copies)`` of 0-based rank ``rank(n)`` of the n rows under ``(hash_col, tie_col)`` order: rows of
    equal hash and tie are alike, and ``copies`` of them lie before the cut. None when it is n or more.

    One scan counts the rows by the upper 16 bits of the signed 64-bit hash (at most 65,536 counts, whose sum is n),
    a second fetches the one bucket that holds the rank, some n / 65,536 rows, grouped by hash and tie. Only where
    that bucket has more than ``fetch`` rows it is counted by the next 16 bits first. One hash value isn't divided
    further; its distinct ties (colliding hashes) are few.
    """
    h, cond, remaining, left = F.col(hash_col), F.lit(True), None, None
    for shift in (48, 32, 16, 0):
        bucket = F.shiftright(h, shift)
        counts = df.where(cond).groupBy(bucket.alias("b")).count().orderBy("b").collect()  # <= 65,536 rows
        if remaining is None:
            n = sum(row["count"] for row in counts)
            remaining = rank(n)
            if remaining >= n:
                return None
        for row in counts:
            if remaining < row["count"]:
                cond, left = cond & (bucket == F.lit(row["b"])), row["count"]
                break
            remaining -= row["count"]
        if left <= fetch:
            break
    ties = df.where(cond).groupBy(h.alias("h"), F.col(tie_col).alias("t")).count().orderBy("h", "t")
    for row in ties.toLocalIterator():
        if remaining < row["count"]:
            return row["h"], row["t"], remaining
        remaining -= row["count"]
    raise AssertionError("the ranks of the bucket counts and of its rows differ")
