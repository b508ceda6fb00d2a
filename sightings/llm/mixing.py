"""Mixing sources to target weights by pivotal dependent rounding (operator 7).

Only DataFrame functions: no Python runs on the executors.

Every document of a source is wanted ``r = target / source size`` times, so it is taken
``floor(r)`` times for sure and once more with probability ``p = r - floor(r)``. The pivotal method
rounds these fractions dependently: two fractional documents trade words (one gains what the other
loses) until one of them becomes integral, the direction drawn so that each expectation stays as it
is. Words, not counts, are traded, so a source's total of words never moves while two fractional
documents remain. A reduction tree does this at scale: documents fall into buckets of about
``fan_in`` per source, each bucket leaves at most one fractional document, and the residuals are
bucketed again, until every source has at most one left, which is rounded by a coin. So a source's
taken words differ from its target by less than its largest last residual document.

Buckets are keyed by (source, hash), so a source with a third of all rows is spread like any other.

Rules for odd rows: a null or blank text has size 0 and takes nothing; a null source is a source of
its own, last in order; rows that repeat (same doc_id, source and size) are numbered and rounded one
by one; a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightings.llm.common import stage, unit_hash

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
FAN_IN = 64
_WORD = r"[^\x20\x09-\x0D]+"
_TINY = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and n, the number of the row among equal ones."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source",
                       F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("bigint").alias("size"))
    same = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    return same.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source: shares of all words by weight.

    A target stops at ``max_copies`` times its source; the excess goes to the others by weight until
    none is above. That fixpoint is ``min(cap, level * weight)`` for one level, found from running
    sums over the sources in the order in which they reach their caps. One row per source only."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    whole = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.select("source", "source_size", (F.row_number().over(order) - 1).alias("rank"))
    weighed = ranked.select(
        "source", "source_size", "rank",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * float(max_copies)).alias("cap"))
    # the level if exactly the sources before this one are capped; it holds if this one isn't
    tried = weighed.select("*", ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                                 / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"))
    holds = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                         F.struct((F.col("cap") / F.col("weight")).alias("reach"), "rank", "level"))).over(whole)
    leveled = tried.withColumn("held", holds["level"])
    return leveled.select("source", "source_size", F.least(
        "cap", F.coalesce("held", F.lit(float("inf"))) * F.col("weight")).alias("target"))


_ITEM = "struct<doc_id:bigint,source:string,size:bigint,n:bigint,p:double>"
_DONE = "array<struct<doc_id:bigint,source:string,size:bigint,n:bigint,up:int>>"


def _let(value, body):
    """body(value) with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _round_bucket(items, seed: int):
    """The items of a bucket folded to a struct of cur (its residual item or null) and done."""

    def settled(x, p):
        return F.struct(x["doc_id"].alias("doc_id"), x["source"].alias("source"), x["size"].alias("size"),
                        x["n"].alias("n"), F.round(p).cast("int").alias("up"))

    def open_(x, p):
        return F.struct(x["doc_id"].alias("doc_id"), x["source"].alias("source"), x["size"].alias("size"),
                        x["n"].alias("n"), p.alias("p"))

    def integral(p):
        return (p < _TINY) | (p > 1 - _TINY)

    def merge(acc, x):
        c = acc["cur"]
        reach = F.struct(  # words c can gain from x, words it can give, and the coin
            F.least((1 - c["p"]) * c["size"], x["p"] * x["size"]).alias("gain"),
            F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"]).alias("give"),
            unit_hash(c["doc_id"], c["n"], x["doc_id"], x["n"], c["source"], seed=seed).alias("coin"))

        def trade(r):
            return F.when(r["coin"] * (r["gain"] + r["give"]) < r["give"], r["gain"]).otherwise(-r["give"])

        def settle(v):
            pc, px = v["pc"], v["px"]
            return F.when(integral(pc) & integral(px), F.struct(
                F.lit(None).cast(_ITEM).alias("cur"), F.concat(acc["done"], F.array(settled(c, pc), settled(x, px))).alias("done"))
            ).when(integral(pc), F.struct(
                open_(x, px).alias("cur"), F.concat(acc["done"], F.array(settled(c, pc))).alias("done"))
            ).otherwise(F.struct(
                open_(c, pc).alias("cur"), F.concat(acc["done"], F.array(settled(x, px))).alias("done")))

        traded = _let(_let(reach, trade), lambda m: F.struct(
            (c["p"] + m / c["size"]).alias("pc"), (x["p"] - m / x["size"]).alias("px")))
        return F.when(c.isNull(), F.struct(x.alias("cur"), acc["done"].alias("done"))).otherwise(_let(traded, settle))

    start = F.struct(F.lit(None).cast(_ITEM).alias("cur"), F.array().cast(_DONE).alias("done"))
    return F.aggregate(items, start, merge)


def rounded(items: DataFrame, fan_in: int = FAN_IN, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, n, up) for fractional items (doc_id, source, size, n, p), 0 < p < 1."""
    parts, level = [], 0
    cur = stage(items, "mix-items")
    while True:
        count = cur.groupBy("source").agg(F.count("*").alias("m"))
        most = count.agg(F.max("m")).first()[0] or 0
        if most <= 1:
            break
        keyed = cur.join(count.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        bucket = F.pmod(F.xxhash64(F.lit(level), "doc_id", "n", "size"), F.ceil(F.col("m") / fan_in)).alias("bucket")
        folded = keyed.select(bucket, F.col("source").alias("s"), F.struct("doc_id", "source", "size", "n", "p").alias("x")) \
            .groupBy("s", "bucket").agg(F.sort_array(F.collect_list("x")).alias("items")) \
            .select(_round_bucket(F.col("items"), seed * 1000 + level).alias("r"))
        folded = stage(folded, "mix-level")
        parts.append(folded.select(F.explode("r.done").alias("d")).select("d.*"))
        cur = folded.filter("r.cur is not null").select("r.cur.*")
        level += 1
    coin = unit_hash("doc_id", "n", "source", seed=seed * 1000 + 999)
    out = cur.select("doc_id", "source", "size", "n", (coin < F.col("p")).cast("int").alias("up"))
    for p in parts:
        out = out.unionByName(p)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES,
        fan_in: int = FAN_IN, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, n, source_size, target, copies, taken."""
    rows = stage(sized(docs), "mix-sizes")
    per_source = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies), "mix-targets")
    named = per_source.withColumnRenamed("source", "s").withColumn(
        "r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    wanted = rows.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumns({
        "base": F.least(F.floor(F.col("r") + _TINY), F.lit(max_copies)).cast("bigint"),
        "p": F.col("r") - F.floor(F.col("r") + _TINY)})
    fractional = wanted.filter((F.col("size") > 0) & (F.col("p") > _TINY)).select("doc_id", "source", "size", "n", "p")
    ups = rounded(fractional, fan_in, seed).select(
        F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("n").alias("k"), "up")
    same = (F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s"))
            & (F.col("size") == F.col("z")) & (F.col("n") == F.col("k")))
    copies = F.when(F.col("size") > 0, F.col("base") + F.coalesce("up", F.lit(0))).otherwise(0)
    return wanted.join(ups, same, "left").select(
        "doc_id", "source", "size", "n", "source_size", "target", copies.cast("bigint").alias("copies"),
        (copies * F.col("size")).cast("bigint").alias("taken"))


def op7(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")

