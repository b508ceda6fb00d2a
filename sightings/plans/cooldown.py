"""The greedy rule "emit when at least C seconds since the last emission", over blocks of time.

Each row points to the first later row that is far enough from it to emit next. Within a block the
pointers are found by binary search for all rows at once, and following them by pointer doubling takes
as many rounds as the logarithm of the number of emissions. What a block needs from those before it
is the time of the last emission, and that matters to its first ``cooldown`` seconds only: so a block
is summed up by the rows that could be its first emission, each with the last emission that follows
from it. These few entries are chained per key, and then each block is marked from its true start.

Three passes over Arrow batches of rows that Spark has sorted by (key, block, time): no call per group,
memory for one block at a time, and rows travel once (both passes over rows read one exchange).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def first_far(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, since: np.ndarray, gap: np.ndarray, strict: bool) -> np.ndarray:
    """For each range [lo, hi) of ascending times, the first place whose time is ``gap`` after ``since``; hi if none."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        waited = t[mid] - since[open_]
        far = waited > gap[open_] if strict else waited >= gap[open_]
        hi[open_[far]] = mid[far]
        lo[open_[~far]] = mid[~far] + 1
    return lo


def next_rows(t: np.ndarray, end: np.ndarray, gap: np.ndarray, strict: bool) -> np.ndarray:
    """The row that emits next after each one; ``end`` of its group if none."""
    return first_far(t, np.arange(1, len(t) + 1), end, t, gap, strict)


def last_reached(following: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The last emission if the row itself emits."""
    at = np.where(following < end, following, np.arange(len(end)))
    while not np.array_equal(further := at[at], at):
        at = further
    return at


def marked(first: np.ndarray, following: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All rows that are reached from the rows ``first``."""
    n = len(end)
    jump = np.append(np.where(following < end, following, n), n)
    out = np.zeros(n + 1, bool)
    out[first] = True
    while (jump < n).any():
        out[jump[np.flatnonzero(out)]] = True
        jump = jump[jump]
    return out[:n]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups (a group begins where ``__pos`` is 1), first row of each group, end of each row's group."""

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        first = np.flatnonzero(table["__pos"].to_numpy() == 1)
        ends = np.append(first[1:], table.num_rows)
        return table, first, np.repeat(ends, ends - first)

    waiting: list[pa.RecordBatch] = []
    for b in batches:
        begins = np.flatnonzero(b["__pos"].to_numpy() == 1)
        at = int(begins[-1]) if len(begins) else -1
        if at > 0 or (at == 0 and waiting):
            yield cut([*waiting, b.slice(0, at)] if at else waiting)
            waiting = [b.slice(at)]
        elif b.num_rows:
            waiting.append(b)
    if waiting:
        yield cut(waiting)


def _summarise(strict: bool):
    entry = pa.list_(pa.struct([("t", pa.float64()), ("last", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, end in whole_groups(batches):
            t, gap = table["__t"].to_numpy(), table["__c"].to_numpy()
            last = t[last_reached(next_rows(t, end, gap, strict), end)]
            early = t <= table["__begin"].to_numpy() + gap
            use = np.concatenate([[True], early[:-1]])  # rows within a cooldown of the start, and the one after
            use[first] = True
            offsets = np.append(np.concatenate([[0], np.cumsum(use)])[first], use.sum()).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(t[use]), pa.array(last[use])], fields=list(entry.value_type))
            heads = table.take(pa.array(first)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [*(heads[c].chunk(0) for c in ("__key", "__blk", "__c")), pa.ListArray.from_arrays(pa.array(offsets), entries)],
                names=["__key", "__blk", "__c", "entries"])

    return run


def _chain(strict: bool):
    """The last emission before each block, from its key's blocks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            starts, lists = [], b["entries"]
            t, reached = (lists.flatten().field(k).to_numpy() for k in (0, 1))
            bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            for i, (at, gap) in enumerate(zip(b["__at"].to_pylist(), b["__c"].to_pylist())):
                if at == 1:
                    last = None
                starts.append(last)
                lo, hi = bounds[i], bounds[i + 1]
                if last is not None:
                    lo = bisect_left(t, True, lo, hi, key=lambda x: x - last > gap if strict else x - last >= gap)
                if lo < hi:
                    last = float(reached[lo])
            yield pa.RecordBatch.from_arrays([b["__key"], b["__blk"], pa.array(starts, pa.float64())], names=["__key", "__blk", "__last"])

    return run


def _mark(columns: list[str], out_col: str, strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, end in whole_groups(batches):
            t, gap = table["__t"].to_numpy(), table["__c"].to_numpy()
            since = table["__last"].take(pa.array(first))
            since = np.where(since.is_null().to_numpy(), -np.inf, since.fill_null(0).to_numpy())
            start = first_far(t, first, end[first], since, gap[first], strict)
            emit = marked(start[start < end[first]], next_rows(t, end, gap, strict), end)
            made = table.select(columns).append_column(out_col, pa.array(emit))
            yield from made.to_batches()

    return run


def cooldown_flags(df: DataFrame, keys: list[str], time_col: str, tie_col: str, cooldown_s: float | Column, *,
                   strict: bool = False, out_col: str = "emit", block_s: float = 6 * 3600.0) -> DataFrame:
    """Greedy cooldown per key, in ``(time_col, tie_col)`` order.

    The first row of a key emits; a later row emits when ``time - last emitted time >= cooldown``
    (``>`` when ``strict``). A row without a time has no place in the order: it never emits and
    leaves the clock alone. ``cooldown_s`` may be a column that is constant within a key. Null keys are
    keys of their own.
    """
    cool = F.lit(float(cooldown_s)) if isinstance(cooldown_s, (int, float)) else cooldown_s.cast("double")
    block = F.floor(F.col(time_col) / F.lit(float(block_s)))
    rows = df.where(F.col(time_col).isNotNull()).withColumns({
        # a struct is never null, and equal to another if all its fields are (null = null)
        "__key": F.struct(F.lit(0).alias("z"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]),
        "__blk": block, "__begin": block * F.lit(float(block_s)), "__t": F.col(time_col).cast("double"), "__c": cool})
    in_block = Window.partitionBy("__key", "__blk").orderBy("__t", tie_col)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = f"__key {kinds['__key']}, __blk {kinds['__blk']}"
    summed = rows.withColumn("__pos", F.row_number().over(in_block)).mapInArrow(
        _summarise(strict), f"{head}, __c double, entries array<struct<t:double,last:double>>")
    per_key = Window.partitionBy("__key")
    chained = summed.withColumns({"__at": F.row_number().over(per_key.orderBy("__blk")), "__of": F.count(F.lit(1)).over(per_key)})
    starts = chained.where("__of > 1").drop("__of").mapInArrow(_chain(strict), f"{head}, __last double").where("__last is not null")
    begun = rows.join(starts, ["__key", "__blk"], "left").withColumn("__pos", F.row_number().over(in_block))
    schema = StructType([*df.schema.fields, StructField(out_col, BooleanType())])
    flagged = begun.mapInArrow(_mark(df.columns, out_col, strict), schema)
    return flagged.unionByName(df.where(F.col(time_col).isNull()).withColumn(out_col, F.lit(False)))
