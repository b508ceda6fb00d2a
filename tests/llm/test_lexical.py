"""Ranked lexical search (operator 11) against a plain version."""

import math
import random
import re
from collections import Counter

import pytest

from sightings.llm import lexical as L
from tests.llm.util import docs


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, items, k=10):
    """All (item_id, rank, score) and, per item, the doc_ids by score."""
    texts = [(d, Counter(tokens(t))) for d, t in rows]
    full = [(d, c) for d, c in texts if c]
    n, total = len(full), sum(sum(c.values()) for _, c in full)
    df = Counter(t for _, c in full for t in c)
    out = []
    for item, text in items:
        want, found = tokens(text), []
        for d, c in full:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in want if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        found.sort()
        out += [(str(item), i + 1, None if f[1] else f[2], -f[0]) for i, f in enumerate(found[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def corpus(n, seed, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]


def test_odd_texts_and_ties(spark):
    rows = [(1, "The CAT sat"), (2, "the cat sat"), (3, None), (4, ""), (5, "..."), (6, "the"), (7, "Élan ÉLAN élan"), (8, "a_b a-b\x00c"),
            (None, "the cat"), (9, "the cat the cat"), (9, "the cat the cat"), (10, "日本 語 cat"), (11, "x" * 5000 + " cat"), (12, "cat " * 3000)]
    items = [(1, "the cat"), (2, "Élan"), (3, None), (4, "zzz"), (5, "cat cat CAT the"), (None, "日本"), (6, "a b C"), (7, "the cat"), (7, "sat")]
    assert result(L.op11(docs(spark, rows), items_of(spark, items))) == brute(rows, items)


@pytest.mark.parametrize("owners", [(), (1 / 200, 1 / 40, 1 / 14), (0.02, 0.05, 0.1, 0.2, 0.5)])
def test_pipeline_of_owners(spark, owners):
    rows, items = corpus(700, 3), corpus(40, 4)
    got = L.search(docs(spark, rows), items_of(spark, items), owners=owners, bundle_items=7, block_docs=50)
    assert result(got) == brute(rows, items)


def test_fewer_than_k_and_many_equal_copies(spark):
    rows = [(i, "same text for all of them") for i in range(300)] + [(1000, "other words")]
    items = [(1, "same text"), (2, "other"), (3, "of them other")]
    got = L.search(docs(spark, rows), items_of(spark, items), block_docs=16)
    assert result(got) == brute(rows, items)
    assert [r[2] for r in sorted(result(got), key=lambda r: (r[0], r[1])) if r[0] == "1"] == [*range(10)]


def test_accumulators_are_pruned(spark):
    """With the bar of the rare terms, documents that hold only common words never get an accumulator."""
    rows = [(i, "common words here") for i in range(2000)] + [(5000 + i, f"common rare{i % 4} unusual") for i in range(60)]
    items = [(j, f"common words rare{j} unusual") for j in range(4)]
    assert result(L.search(docs(spark, rows), items_of(spark, items), block_docs=200)) == brute(rows, items)


def test_odd_tables(spark):
    some, none = docs(spark, [(1, "a b")]), docs(spark, [(1, "a")]).filter("false")
    assert L.op11(none, items_of(spark, [(1, "a")])).collect() == []
    assert L.op11(some, items_of(spark, [(1, "a")]).filter("false")).collect() == []
    wide = some.selectExpr("*", "1 as uid", "'x' as term", "2 as item", "3 as score", "4 as key")
    assert result(L.op11(wide, items_of(spark, [(3, "A")]).selectExpr("*", "5 as item", "6 as doc_id"))) == brute([(1, "a b")], [(3, "A")])
