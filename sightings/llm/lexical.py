"""Ranked lexical search with pipelined term partitioning (operator 11).

The terms of the index are divided among owners by how common they are, the rarest first. Items
travel in bundles through the owners: an owner adds the integer contributions of its postings to the
bundle's sparse accumulators (item, document, score) and hands the bundle on; a posting goes to its
owner only. A bundle is split by blocks of documents (hash of the row, about ``BLOCK_DOCS`` rows), so
that neither a posting list nor a bundle meets in one task: each step is a cogroup of accumulators
and postings by (bundle, block).

Common terms touch nearly all documents but add little. After each owner, each item's ``k``-th best
score so far is a lower bound of what the final ``k``-th has. An accumulator that can't reach it with
all that the later owners can add at most goes; and if a document that has nothing yet can't, no new
ones are begun. Bounds are exact: scores only grow, and a term adds at most its highest contribution.

1. Documents are tokenised once; postings of terms that items hold are written out (uid, term, tf
   and the document's length n). The empty term stands for the document itself, and counts N and L.
2. df and the highest contribution by term give weights, owners and bounds.
3. One cogroup an owner; its accumulators are written out.
4. The k best candidates of each item, ties by doc_id.

Nothing here is gathered by item or by term: the largest group is a block's postings of one owner.

Rules for odd rows: a null text has no terms; documents and items are rows, so repeated ids are
ranked on their own (equal scores and ids in any order); null doc_ids come last among equal scores;
an item without terms, or without a document above 0, has no rows; empty tables give no rows; other
columns are not used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightings.llm.common import stage

TOP = 10
#: Share of all documents up to which a term belongs to each owner but the last.
OWNERS = (1 / 200, 1 / 40, 1 / 14)
BUNDLE_ITEMS = 256
BLOCK_DOCS = 2048

_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and whatever is not ASCII."""
    return text.encode().translate(_TABLE).split() if text else []


def term_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, n, term, tf) of each row of df with a term, and one row a text for the empty term with tf 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words(t.as_py()) for t in b["text"]]
            counts = [Counter(w) for w in found]
            terms = [[b"", *c] for c in counts]
            yield pa.RecordBatch.from_arrays(
                [b[key], pa.array([len(w) for w in found], pa.int64()), pa.array(terms, pa.list_(pa.binary())),
                 pa.array([[1, *c.values()] for c in counts], pa.list_(pa.int64()))], names=[key, "n", "terms", "tfs"])

    kind = df.schema[key].dataType.simpleString()
    lists = df.select(key, "text").mapInArrow(run, f"{key} {kind}, n bigint, terms array<binary>, tfs array<bigint>")
    return lists.filter("n > 0").select(key, "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(
        key, "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))


def impact(n_docs: int, n_words: int):
    """The weightless contribution of a posting, in whole numbers."""
    m = F.lit(25) + F.expr(f"(75 * n * {n_docs}L) div {n_words}L")
    return F.expr("1000000000 * tf") , F.lit(1000) * F.col("tf") + F.lit(8) * m


_STATE = "bundle int, block int, items array<bigint>, docs array<bigint>, scores array<bigint>, top_items array<bigint>, top_scores array<bigint>"
_STATE_ARROW = pa.schema([("bundle", pa.int32()), ("block", pa.int32()), *((c, pa.list_(pa.int64())) for c in (
    "items", "docs", "scores", "top_items", "top_scores"))])


def owner_step(k: int):
    """One owner's work on one bundle and block."""

    def flat(column: pa.ChunkedArray, *names: str) -> list[np.ndarray]:
        values = column.combine_chunks().flatten()
        return [values.field(n).to_numpy() for n in names]

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        item, rest, after, bar = flat(left["limits"], "item", "rest", "after", "bar")
        order = np.argsort(item)
        item, rest, after, bar = item[order], rest[order], after[order], bar[order]
        acc_item, acc_doc, acc_score = (left[c].combine_chunks().flatten().to_numpy() for c in ("items", "docs", "scores"))
        docs = np.unique(np.concatenate([acc_doc, right["uid"].to_numpy()]))
        score = np.zeros((len(item), len(docs)), np.int64)
        at = np.searchsorted(item, acc_item)
        stays = acc_score + rest[at] >= bar[at]
        score[at[stays], np.searchsorted(docs, acc_doc[stays])] = acc_score[stays]
        opens = rest >= bar
        by_term = np.argsort(right["term"].to_numpy(), kind="stable")
        terms, adds = right["term"].to_numpy()[by_term], right["add"].to_numpy()[by_term]
        doc_of = np.searchsorted(docs, right["uid"].to_numpy()[by_term])
        who, term, times = flat(left["entries"], "item", "term", "times")
        rows = np.searchsorted(item, who).tolist()
        for row, i, j, t in zip(rows, np.searchsorted(terms, term).tolist(), np.searchsorted(terms, term, "right").tolist(), times.tolist()):
            if i == j:
                continue
            line, d = score[row], doc_of[i:j]
            line[d] += adds[i:j] * t if opens[row] else np.where(line[d] > 0, adds[i:j] * t, 0)
        score[(score + after[:, None]) < bar[:, None]] = 0
        r, d = np.nonzero(score)
        found = score[r, d]
        # the k best of each item within this block
        best = np.lexsort((-found, r))
        first = np.searchsorted(r[best], np.arange(len(item)))
        top = best[np.arange(len(best)) - first[r[best]] < k]
        row = [left["bundle"][0].as_py()], [left["block"][0].as_py()], [item[r]], [docs[d]], [found], [item[r[top]]], [found[top]]
        return pa.table([pa.array(x, f.type) for x, f in zip(row, _STATE_ARROW)], schema=_STATE_ARROW)

    return step


def bars(state: DataFrame, k: int) -> DataFrame:
    """Each item's k-th best score so far, for items that have as many."""
    best = state.select(F.explode(F.arrays_zip("top_items", "top_scores")).alias("t")).select(
        F.col("t.top_items").alias("item"), F.col("t.top_scores").alias("bar"))
    w = Window.partitionBy("item").orderBy(F.desc("bar"))
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") == k).select("item", "bar")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, owners: tuple[float, ...] = OWNERS,
           bundle_items: int = BUNDLE_ITEMS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The k best rows of docs (doc_id, text) for each row of items (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    items = stage(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "lexical-items")
    item_terms = stage(term_rows(items, "item").filter("term <> x''").select("item", "term", F.col("tf").alias("times")), "lexical-item-terms")
    vocabulary = stage(item_terms.select("term").distinct().withColumn("id", F.monotonically_increasing_id())
                       .unionByName(spark.createDataFrame([(bytearray(), -1)], "term binary, id bigint")), "lexical-vocabulary")
    keyed = docs.select(F.struct("uid", "doc_id").alias("key"), "text")
    postings = stage(term_rows(keyed, "key").join(vocabulary, "term").select(
        "key.uid", F.when(F.col("id") < 0, F.col("key.doc_id")).alias("doc_id"), "n", F.col("id").alias("term"), "tf"), "lexical-postings")
    whole = postings.filter("term < 0")
    n_docs, n_words, n_items = (*whole.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first(), items.count())
    n_words, n_blocks, n_bundles = max(n_words, 1), -(-n_docs // block_docs) or 1, -(-n_items // bundle_items) or 1

    top, bottom = impact(n_docs, n_words)
    listed = postings.filter("term >= 0").withColumn("top", top).withColumn("bottom", bottom).withColumn("impact", F.expr("top div bottom"))
    owner = F.lit(len(owners))
    for number, share in reversed(list(enumerate(owners))):
        owner = F.when(F.col("df") <= share * n_docs, number).otherwise(owner)
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    terms = stage(listed.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
                  .select("term", weight.alias("w"), (weight * F.col("most")).alias("most"), owner.cast("int").alias("owner")), "lexical-terms")

    bundle = F.pmod(F.xxhash64("item"), F.lit(n_bundles)).cast("int").alias("bundle")
    entries = stage(item_terms.join(vocabulary, "term").select("item", bundle, F.col("id").alias("term"), "times").join(terms, "term"), "lexical-entries")
    wanted = entries.select("bundle", "term", "w", "owner").distinct()

    def limits(number: int, bar: DataFrame | None) -> DataFrame:
        """Each bundle's items: what this and the later owners add at most, the later ones alone, and the bar."""
        sums = entries.groupBy("bundle", "item").agg(
            *(F.coalesce(F.sum(F.when(F.col("owner") >= o, F.col("most") * F.col("times"))), F.lit(0)).alias(c)
              for o, c in ((number, "rest"), (number + 1, "after"))))
        sums = sums.withColumn("bar", F.lit(0)) if bar is None else sums.join(bar, "item", "left").fillna(0, "bar")
        return sums.groupBy("bundle").agg(F.collect_list(F.struct("item", "rest", "after", F.col("bar").cast("bigint").alias("bar"))).alias("limits"))

    state = bar = None
    for number in range(len(owners) + 1):
        mine = entries.filter(F.col("owner") == number).groupBy("bundle").agg(F.collect_list(F.struct("item", "term", "times")).alias("entries"))
        sent = limits(number, bar).join(mine, "bundle", "left").select(
            "bundle", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "limits", "entries")
        if state is not None:
            sent = sent.unionByName(state.drop("top_items", "top_scores"), allowMissingColumns=True)
        else:
            sent = sent.selectExpr("*", *(f"cast(null as array<bigint>) {c}" for c in ("items", "docs", "scores")))
        adds = listed.join(wanted.filter(F.col("owner") == number), "term").select(
            F.col("bundle").alias("to_bundle"), F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int").alias("to_block"),
            "uid", "term", (F.col("w") * F.col("impact")).alias("add"))
        state = stage(sent.groupBy("bundle", "block").cogroup(adds.groupBy("to_bundle", "to_block")).applyInArrow(owner_step(k), _STATE),
                      f"lexical-owner-{number}")
        bar = stage(bars(state, k), "lexical-bars")

    reached = state.select(F.explode(F.arrays_zip("items", "docs", "scores")).alias("a")).select(
        F.col("a.items").alias("item"), F.col("a.docs").alias("uid"), F.col("a.scores").alias("score"))
    reached = reached.join(bar, "item", "left").filter("bar is null or score >= bar").join(whole.select("uid", "doc_id"), "uid")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "uid")
    ranked = reached.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark),
total AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nl FROM d WHERE len(w) > 0),
it AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS t FROM b) x GROUP BY ALL),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) x
       WHERE t IN (SELECT t FROM it) GROUP BY ALL),
wt AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * df + 1))) AS BIGINT) AS w
       FROM (SELECT t, count(*) AS df FROM tf GROUP BY t) x, total),
hit AS (SELECT i, item_id, r, doc_id,
               CAST(sum(times * wt.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nl)))) AS BIGINT) AS score
        FROM tf JOIN wt USING (t) JOIN it USING (t), total GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank,
                  doc_id, score FROM hit WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
