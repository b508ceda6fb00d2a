"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightings.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut there, and a
    lost executor costs one re-read instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def add_columns(df: DataFrame, compute: Callable[[pa.RecordBatch], list], fields: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of df (all, if not given) as they are, and new ones from each Arrow batch.

    ``fields`` is the DDL of the new columns; they replace kept ones of the same name."""
    new = StructType.fromDDL(fields)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    schema = StructType([*(df.schema[c] for c in kept), *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [c if isinstance(c, pa.Array) else pa.array(c) for c in compute(b)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *made], names=[*kept, *new.names])

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of each Arrow batch that ``keep`` marks, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.asarray(keep(b), dtype=bool)))

    return df.mapInArrow(run, df.schema)


def held_out(modulus: int, remainder: int):
    """crc32 of the decimal doc_id, modulo ``modulus``, equals ``remainder`` (null id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def unit_hash(*cols, seed: int = 0):
    """A uniform number in [0, 1) that depends on the columns only."""
    return (F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of ``n`` nodes under the links (a[i], b[i]).

    Hooking to the smaller root and pointer jumping, all vectorised."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """Components of an undirected graph given as (a, b) bigints; returns (node, root).

    root is the smallest node that can be reached. Alternating large-star and small-star rounds:
    each is a map-side combined minimum per node and one join, written to the shared folder. No
    node's neighbours are gathered, so a hub costs no more than its links. Nodes without links
    don't appear. Null ends are left out.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        if large:
            linked = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            linked = both.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                low.select("a", F.col("m").alias("b")))
        return linked.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    cur = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur, before = stage(cur, label), None
    while (now := state(cur)) != before and now[0]:
        before = now
        cur = stage(star(star(cur, True), False), label)
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
