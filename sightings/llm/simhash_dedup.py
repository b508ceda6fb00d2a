"""SimHash near-duplicates by a binary trie self-join (operator 10).

Fingerprints are computed in one pass over the texts, without a shuffle. Equal fingerprints collapse
first (map-side combined), so the join sees each distinct fingerprint once and thousands of copies
cost one trie path. The trie's top levels are spread over tasks: a node is a prefix of ``b`` bits,
and two nodes meet in one task only if their prefixes differ in at most the budget. There the two
subtrees are walked together level by level, the differing bits add up, and a node pair over the
budget is pruned. Node pairs with over 4 ``node_limit`` fingerprints are split ``_STEP`` levels
further, again and again down to all 64 bits, where a pair of nodes has two fingerprints at most.

Rules for odd rows: a null or blank text has fingerprint zero, which links like any other; a null
doc_id takes part and is never the smallest unless all of its component are null; repeated rows each
get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.llm.common import add_columns, connected_components, fresh_names, local_components, stage

NODE_LIMIT = 1 << 13
_LEAF = 16  # node pairs with at most this many fingerprint pairs are compared directly
_FRONTIER = 1 << 20  # node pairs walked at a time
_BLOCK = 1 << 16  # node pairs compared at a time
_HELD = 1 << 20  # links kept before they are reduced to a star per component
_STEP = 4  # levels by which overfull node pairs are split


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words."""
    import xxhash

    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    width = min(shingle, len(words))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.fromiter((digest(joined[s:e - 1], seed) for s, e in zip(starts[lo:hi], ends[lo + width - 1:hi + width - 1])),
                        "<u8", hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the 64 bits as a signed bigint."""
    return add_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"),
                       lambda b: [_fp_column(b, shingle, seed)], "fp bigint", ["doc_id"])


def _fp_column(b: pa.RecordBatch, shingle: int, seed: int) -> np.ndarray:
    return np.array([fingerprint_of(t, shingle, seed) for t in b["text"].to_pylist()], dtype=np.uint64).view(np.int64)


def trie_join(a: np.ndarray, b: np.ndarray, same: bool, depth: int, budget: int, reduce=None,
              places: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with a[i] and b[j] at most ``budget`` bits apart.

    ``places`` are other numbers for the rows of a and b. With ``reduce`` the pairs found so far are
    replaced by reduce(i, j) whenever there are many. a and b are sorted distinct uint64, each below one trie node of ``depth`` bits. With ``same``
    (a is b) every pair comes once, with i < j."""
    start = int(np.bitwise_count(a[0] ^ b[0]) if depth == 64 else np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - depth)) if depth else 0)
    if start > budget:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_i, found_j = [], []

    held = 0

    def compare(f: np.ndarray) -> None:
        nonlocal held
        wide = f[3] - f[2]
        size = (f[1] - f[0]) * wide
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        w = np.repeat(wide, size)
        i, j = np.repeat(f[0], size) + k // w, np.repeat(f[2], size) + k % w
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        found_i.append(places[0][i[near]] if places else i[near])
        found_j.append(places[1][j[near]] if places else j[near])
        held += len(found_i[-1])
        if reduce and held > _HELD:
            less = reduce(np.concatenate(found_i), np.concatenate(found_j))
            found_i[:], found_j[:], held = [less[0]], [less[1]], 0

    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counts(at: int):
        if at not in ones:
            bit = np.uint64(63 - at)
            ca = np.concatenate([[0], np.cumsum((a >> bit) & np.uint64(1), dtype=np.int64)])
            ones[at] = (ca, ca if same else np.concatenate([[0], np.cumsum((b >> bit) & np.uint64(1), dtype=np.int64)]))
        return ones[at]

    todo = [(depth, np.array([[0], [len(a)], [0], [len(b)], [start]], np.int64))]
    while todo:
        at, f = todo.pop()
        if f.shape[1] > _FRONTIER:
            half = f.shape[1] // 2
            todo += [(at, f[:, :half]), (at, f[:, half:])]
            continue
        small = (f[1] - f[0]) * (f[3] - f[2]) <= _LEAF if at < 64 else np.ones(f.shape[1], bool)
        if small.any():
            near = f[:, small]
            for lo in range(0, near.shape[1], _BLOCK):
                compare(near[:, lo:lo + _BLOCK])
            f = f[:, ~small]
        if not f.shape[1]:
            continue
        ca, cb = counts(at)
        am, bm = f[1] - (ca[f[1]] - ca[f[0]]), f[3] - (cb[f[3]] - cb[f[2]])
        twin = (f[0] == f[2]) & (f[1] == f[3]) if same else np.zeros(f.shape[1], bool)
        kids = []
        for x in (0, 1):
            for y in (0, 1):
                alo, ahi = (f[0], am) if x == 0 else (am, f[1])
                blo, bhi = (f[2], bm) if y == 0 else (bm, f[3])
                err = f[4] + (x != y)
                keep = (alo < ahi) & (blo < bhi) & (err <= budget)
                if (x, y) == (1, 0):
                    keep &= ~twin
                kids.append(np.stack([alo, ahi, blo, bhi, err])[:, keep])
        todo.append((at + 1, np.concatenate(kids, axis=1)))
    return (np.concatenate(found_i) if found_i else np.zeros(0, np.int64),
            np.concatenate(found_j) if found_j else np.zeros(0, np.int64))


def links(distinct: DataFrame, budget: int = 2, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (a, b) that join each component of the distinct fingerprints ``fp`` (bigint).

    Each task reduces the pairs it finds to a star per component, so a dense neighbourhood gives
    at most one row per fingerprint and task, with the same components."""
    bits = min(24, max(0, (max(distinct.count(), 1) - 1) // node_limit).bit_length())
    limit = 4 * node_limit
    start = distinct.select("fp", F.lit(0).cast("bigint").alias("u"), F.lit(0).cast("bigint").alias("v"))
    placed, found = _split(start, 0, bits, budget), []
    nodes = distinct.groupBy(_node(bits).alias("u")).count().agg(F.max("count")).first()[0]
    deeper = bool(nodes) and 2 * nodes > limit
    while deeper:
        own = F.count(F.when(_node(bits) == F.col("u"), 1))
        sizes = placed.groupBy("u", "v").agg(F.count("*").alias("n"), own.alias("own")).filter(
            F.when(F.col("u") == F.col("v"), F.col("n") > 1).otherwise((F.col("own") > 0) & (F.col("own") < F.col("n"))))
        sizes = stage(sizes.select("u", "v", ((F.col("n") > limit) & F.lit(bits < 64)).alias("full")), "simhash-sizes")
        full, rest = sizes.filter("full").select("u", "v"), sizes.filter("not full").select("u", "v")
        found.append(_walked(placed.join(F.broadcast(full), ["u", "v"], "left_anti").join(rest, ["u", "v"], "left_semi"), bits, budget))
        deeper = not full.isEmpty()
        if deeper:
            step = min(_STEP, 64 - bits)
            placed = stage(_split(placed.join(F.broadcast(full), ["u", "v"], "left_semi"), bits, step, budget), "simhash-deeper")
            bits += step
    if not found:
        return _walked(placed, bits, budget)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _node(bits: int):
    return F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("bigint")


def _split(placed: DataFrame, bits: int, step: int, budget: int) -> DataFrame:
    """(fp, u, v) of node pairs of ``bits`` levels dealt out to the pairs ``step`` levels below, within the budget."""
    masks = [(sum(1 << i for i in c), k) for k in range(min(budget, step) + 1) for c in combinations(range(step), k)]
    apart = F.col("u").bitwiseXOR(F.col("v"))
    mask = F.explode(F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(k).alias("k")) for m, k in masks])).alias("mask")
    return (placed.select("fp", apart.alias("apart"), mask)
            .filter(F.bit_count("apart") + F.col("mask.k") <= budget)
            .select("fp", _node(bits + step).alias("u"),
                    _node(bits + step).bitwiseXOR(F.shiftleft("apart", step)).bitwiseXOR(F.col("mask.m")).alias("v"))
            .select("fp", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def _walked(placed: DataFrame, bits: int, budget: int) -> DataFrame:
    """The links of each node pair's fingerprints, a star per component."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(pdf["fp"].to_numpy().view(np.uint64))
        ends = pdf[["u", "v"]].iloc[0].to_numpy().view(np.uint64)
        nodes = fp >> np.uint64(64 - bits) if bits else np.zeros(len(fp), np.uint64)
        left, right = (np.flatnonzero(nodes == x) for x in ends)

        def star(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            root = local_components(len(fp), i, j)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            return moved, root[moved]

        i = j = np.zeros(0, np.int64)
        if len(left) and len(right):
            i, j = star(*trie_join(fp[left], fp[right], bool(ends[0] == ends[1]), bits, budget, star, (left, right)))
        return pd.DataFrame({"a": fp[i].view(np.int64), "b": fp[j].view(np.int64)})

    return placed.groupBy("u", "v").applyInPandas(walk, "a bigint, b bigint")


def _classes(fps: DataFrame, budget: int, node_limit: int) -> DataFrame:
    """(fp, root, component_id) per distinct fingerprint; root is the smallest linked fingerprint."""
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    comp = connected_components(links(distinct.select("fp"), budget, node_limit), "simhash-links")
    rooted = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = 2, seed: int = 42,
                       node_limit: int = NODE_LIMIT) -> DataFrame:
    """One row per document: doc_id, fp, root (its class), component_id (smallest doc_id that links reach)."""
    fps = stage(fingerprints(docs, shingle, seed), "simhash-fp")
    return fps.join(_classes(fps, budget, node_limit), "fp").select("doc_id", "fp", "root", "component_id")


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns: the fingerprint as 16 lower-case hex digits."""
    return simhash_components(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """The documents without near-duplicates: of each component a row with its smallest doc_id.

    All columns of ``docs`` pass through. The ids that go are far fewer than those that stay, so an anti
    join on them selects the rows; texts move only if the ids that go are many. Rows whose doc_id stands
    on several rows, one of which stays, are told apart by fingerprinting them again."""
    found = simhash_components(docs, shingle, budget, seed)
    id_, fp, root = fresh_names(docs, "_id", "_fp", "_root")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = found.groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("rows"), F.count(F.when(stays, 1)).alias("kept"))
    apart = stage(ids.filter("kept = 0 or rows > 1"), "simhash-apart")
    same_id = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_))
    once = docs.join(apart.select(id_), same_id, "left_anti")
    again = apart.filter("kept > 0").select(id_)
    if again.isEmpty():
        return once
    rows = add_columns(docs.join(again, same_id, "left_semi"), lambda b: [_fp_column(b, shingle, seed)], f"{fp} bigint")
    roots = found.filter(stays).select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("doc_id").alias(id_)).distinct()
    picked = rows.join(roots, (rows[fp] == roots[fp]) & same_id).dropDuplicates([root])
    return once.unionByName(picked.select(*[rows[c] for c in docs.columns]))
