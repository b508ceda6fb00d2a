"""Embedding near-duplicates by quantised tile products with error bounds (operator 8).

Vectors are scaled to length one and quantised to int8, each with its own scale s, so that
x = s q + e with the error's length |e| known exactly. For two vectors
    x.y = s_x s_y (q_x.q_y) + r,   |r| <= |e_x| + |e_y| + |e_x| |e_y|,
so a quantised product bounds the cosine from both sides. Tiles of quantised vectors are multiplied
whole (as float32, in which sums of int8 products up to dimension 2^24 / 127^2 are exact; longer
vectors are multiplied in slices), and only pairs whose upper bound reaches the threshold are
recomputed in double precision. No pair at or above the threshold is missed, none below it is kept.

Equal vectors collapse first, map-side: thousands of copies are one vector with a count. Distinct
vectors fall into groups by hash, and each pair of groups is one task of bounded size; a task skips
tiles whose vectors all lie too far apart (the angle between their means less the two radii). A task
emits link counts per vector and a spanning forest of its links, never its pairs, so a dense cluster
costs no more rows than it has vectors. Cosine similarity at a fixed threshold has no exact
subquadratic join in many dimensions, so products grow with the square of the distinct vectors; the
rows that are shuffled grow with their number times the number of groups.

Rules for odd rows: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing and are their own component; vectors of different lengths don't link; repeated vec_ids
each get a row; a null vec_id takes part and is never the smallest of a component unless alone; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.llm.common import connected_components, local_components, stage

THRESHOLD = 0.95
GROUP_ROWS = 8192
TILE = 1024
_EXACT = (1 << 24) // (127 * 127)  # dimensions whose int8 products sum exactly in float32


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, error lengths) of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127.0
    code = np.rint(x / scale[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(x - code * scale[:, None], axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], _EXACT):
        out += a[:, k:k + _EXACT].astype(np.float32) @ b[:, k:k + _EXACT].astype(np.float32).T
    return out


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of unit vectors x[i], y[j] with a cosine of at least ``threshold``; within x
    (i < j) if y is None."""
    other = x if y is None else y
    qa, sa, ea = quantise(x)
    qb, sb, eb = (qa, sa, ea) if y is None else quantise(y)
    angle = np.arccos(min(1.0, threshold)) + 1e-6

    def cones(v):
        out = []
        for at in range(0, len(v), tile):
            part = v[at:at + tile]
            mid = part.mean(axis=0)
            size = np.linalg.norm(mid)
            mid = mid / size if size > 1e-9 else part[0]
            out.append((mid, float(np.arccos(np.clip(part @ mid, -1, 1)).max())))
        return out

    ca, cb = cones(x), cones(other)
    found_i, found_j = [], []
    for m, a in enumerate(range(0, len(x), tile)):
        for n, b in enumerate(range(0, len(other), tile)):
            if y is None and b < a:
                continue
            if np.arccos(np.clip(ca[m][0] @ cb[n][0], -1, 1)) > angle + ca[m][1] + cb[n][1]:
                continue
            p, q = slice(a, a + tile), slice(b, b + tile)
            near = _product(qa[p], qb[q]) * sa[p, None]
            near *= sb[None, q]
            i, j = np.nonzero(near + (ea[p, None] + eb[None, q] + ea[p, None] * eb[None, q]) + 1e-9 >= threshold)
            i, j = i + a, j + b
            if y is None:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 16):  # these few in full precision
                u, v = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
                ok = np.einsum("ij,ij->i", x[u], other[v]) >= threshold
                found_i.append(u[ok])
                found_j.append(v[ok])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def link_stats(distinct: DataFrame, threshold: float, group_rows: int) -> DataFrame:
    """From distinct vectors (key, copies, unit): rows (key, links, other): link counts by parts, and
    links to other keys that span each part's components."""
    n = distinct.count()
    groups = max(1, -(-n // group_rows))
    mine = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")
    placed = distinct.withColumn("g", mine).select(
        "key", "copies", "unit", "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h")).select(
        "key", "copies", "unit", "g", F.least("g", "h").alias("p"), F.greatest("g", "h").alias("q"))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        parts = []
        pdf = pdf.sort_values("key", ignore_index=True)
        widths = pdf["unit"].map(len)
        for _, same in pdf.groupby(widths.to_numpy()):
            key, copies = same["key"].to_numpy(), same["copies"].to_numpy(np.int64)
            x = np.stack(same["unit"].to_numpy())
            left = (same["g"] == p).to_numpy()
            if p == q:
                i, j = tile_links(x, None, threshold)
            elif left.all() or not left.any():
                continue
            else:
                a, b = np.flatnonzero(left), np.flatnonzero(~left)
                i, j = tile_links(x[a], x[b], threshold)
                i, j = a[i], b[j]
            count = np.bincount(i, copies[j], len(key)) + np.bincount(j, copies[i], len(key))
            root = local_components(len(key), i, j)
            some = np.flatnonzero(count)
            parts.append(pd.DataFrame({"key": key[some], "links": count[some].astype(np.int64), "other": key[root[some]]}))
        return pd.concat(parts) if parts else pd.DataFrame({"key": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})

    return placed.groupBy("p", "q").applyInPandas(task, "key bigint, links bigint, other bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = F.array_max(F.transform("v", lambda c: F.abs(c)))
    usable = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & finite & (top > 0), F.lit(False))
    # -0.0 equals 0.0 and has the same key; scaling by the largest component first keeps squares finite
    plain = F.when(usable, F.transform("v", lambda c: F.when(c == 0, 0.0).otherwise(c)))
    rows = stage(rows.select("vec_id", plain.alias("v")), "embedding-rows")
    good = rows.filter("v is not null")
    scaled = F.transform("v", lambda c: c / F.array_max(F.transform("v", lambda d: F.abs(d))))
    # a vector is named by two hashes of its components
    named = good.select("vec_id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), "v")
    firsts = named.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("v").alias("v"))
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, c: a + c * c))
    distinct = firsts.withColumn("s", scaled).withColumn("n", length).select(
        F.xxhash64("h1", "h2").alias("key"), "h1", "h2", "copies", "first_id", F.transform("s", lambda c: c / F.col("n")).alias("unit"))
    distinct = stage(distinct, "embedding-distinct")
    stats = stage(link_stats(distinct.select("key", "copies", "unit"), threshold, group_rows), "embedding-links")
    comp = connected_components(stats.select(F.col("key").alias("a"), F.col("other").alias("b")), "embedding-components")
    counted = stats.groupBy("key").agg(F.sum("links").alias("links"))
    known = distinct.select("key", "h1", "h2", "copies", "first_id").join(counted, "key", "left").join(
        comp.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = known.groupBy("root").agg(F.min("first_id").alias("least"))
    known = known.join(least, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "least")
    marked = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("v").isNotNull(), F.hash("v")).alias("h2"))
    component = F.when(F.col("n").isNotNull(), F.col("least")).otherwise(F.col("vec_id"))
    return marked.join(known, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))


def op8(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)


OP8_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.r AS x, b.r AS y FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
comp AS (SELECT reach.x AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x),
n AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.r = v.r LEFT JOIN n ON n.r = v.r
"""
