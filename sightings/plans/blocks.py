"""Ordered rules over a key, in blocks of time, with state handed from block to block.

A rule that walks a camera's rows in order is given as three small functions:

* ``summarise(rows)``: what a block does to any state that may reach it, as a short JSON value,
* ``advance(state, summary)``: the state after the block (``state`` None: nothing before it),
* ``finish(rows, state)``: the new columns of a block's rows, given the state before it.

Rows are dealt to tasks by (key, block) and sorted by Spark; both passes over them read that one exchange, so
what comes before is computed once. Summaries, one short value a block, are chained per key. A task holds
the rows of one block at a time, however long a key's history is. It is all lazy.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .cooldown import whole_groups

BLOCK_S = 24 * 3600.0
_NO_TIME = -(1 << 62)  # the block of rows without a time, before all others


def blockwise(df: DataFrame, key: str, time_col: str, tie_col: str, fields: str, summarise: Callable[[pa.Table], Any],
              advance: Callable[[Any, Any], Any], finish: Callable[[pa.Table, Any], list], block_s: float = BLOCK_S) -> DataFrame:
    """df with the columns ``fields`` (DDL) that ``finish`` makes. Rows stand in (time, tie) order; those without a
    time come first, in a block of their own. A null key is a key of its own."""
    block = F.coalesce(F.floor(F.col(time_col) / F.lit(float(block_s))), F.lit(_NO_TIME))
    rows = df.withColumns({"__key": F.to_json(F.struct(F.col(key)), {"ignoreNullFields": "false"}), "__blk": block})
    in_block = Window.partitionBy("__key", "__blk").orderBy(time_col, tie_col)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, end in whole_groups(batches):
            found = [json.dumps(summarise(table.slice(a, end[a] - a))) for a in first.tolist()]
            heads = table.select(["__key", "__blk"]).take(pa.array(first)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(heads[c].chunk(0) for c in heads.column_names), pa.array(found)], names=["__key", "__blk", "summary"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            states = []
            for at, summary in zip(b["__at"].to_pylist(), b["summary"].to_pylist()):
                state = None if at == 1 else state
                states.append(None if state is None else json.dumps(state))
                state = advance(state, json.loads(summary))
            yield pa.RecordBatch.from_arrays([b["__key"], b["__blk"], pa.array(states, pa.string())], names=["__key", "__blk", "__state"])

    columns, new = df.columns, StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, end in whole_groups(batches):
            states, made = table["__state"].take(pa.array(first)).to_pylist(), [[] for _ in kinds]
            for a, state in zip(first.tolist(), states):
                for parts, kind, values in zip(made, kinds, finish(table.slice(a, end[a] - a), None if state is None else json.loads(state))):
                    parts.append(values if isinstance(values, pa.Array) else pa.array(values, kind))
            out = table.select(columns)
            for name, kind, parts in zip(new.names, kinds, made):
                out = out.append_column(name, pa.chunked_array(parts, kind).combine_chunks())
            yield from out.to_batches()

    summed = rows.withColumn("__pos", F.row_number().over(in_block)).mapInArrow(sums, "__key string, __blk bigint, summary string")
    per_key = Window.partitionBy("__key").orderBy("__blk")
    states = summed.withColumn("__at", F.row_number().over(per_key)).mapInArrow(chain, "__key string, __blk bigint, __state string")
    begun = rows.join(states, ["__key", "__blk"], "left").withColumn("__pos", F.row_number().over(in_block))
    return begun.mapInArrow(done, StructType([*df.schema.fields, *new.fields]))
