import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightings.llm import decontamination as dc
from tests.llm.util import DOC_SCHEMA, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, n=13):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        size = min(n, len(w))
        for s in range(len(w) - size + 1):
            wins.setdefault(tuple(w[s:s + size]), set()).add(str(i))
    out = []
    for d, t in rows:
        w = words(t)
        hit, ids = set(), set()
        for size in {len(k) for k in wins}:
            for s in range(len(w) - size + 1):
                if tuple(w[s:s + size]) in wins:
                    ids |= wins[tuple(w[s:s + size])]
                    hit |= set(range(s, s + size))
        out.append((str(d), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def fixture(seed=1):
    rng = np.random.default_rng(seed)
    vocab = ["The", "of", "É", "x1", "straße", "new", "longwordwithtail1", "longwordwithtail2"]
    text = lambda k: " ".join(rng.choice(vocab, k))
    items = [(k, text(int(rng.integers(1, 40)))) for k in range(30)] + [(3, "of new of new of new of new"), (None, "the the"), (77, ""), (78, None), (5, "q")]
    items += [(10, items[4][1]), (100, items[4][1])]
    rows = [(k, text(int(rng.integers(0, 80)))) for k in range(50)]
    rows += [(k + 60, text(20) + "\n" + items[k][1].upper() + ", " + text(300)) for k in range(30)]
    rows += [(500, None), (501, ""), (None, items[2][1]), (60, rows[50][1]), (502, "word " * 5000 + items[8][1]), (503, "...!?")]
    return rows, items


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_suffix_array_and_index():
    rng = np.random.default_rng(2)
    for top in (2, 50):
        t = np.concatenate([rng.integers(1, top + 1, 400), [0]])
        assert dc.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        index = dc.FMIndex(t)
        for size in (1, 2, 5):
            starts = np.arange(0, 300, 7)
            lo, hi = index.search(t, starts, np.full(len(starts), size))
            for s, a, b in zip(starts, lo, hi):
                want = [i for i in range(len(t)) if t[i:i + size].tolist() == t[s:s + size].tolist()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_words_equal_the_pattern():
    texts = ["A-b_c d9\x7fÀİx\x00y", "", "zzz", "…", "#"]
    digest, at, start, end, raw = dc.split_words([t.encode() for t in texts])
    got = [[] for _ in texts]
    for i, s, e in zip(at, start, end):
        got[i].append(raw.lower()[s:e].decode())
    assert got == [words(t) for t in texts]


def test_equals_brute_force(spark):
    rows, items = fixture()
    got = dc.op1(docs(spark, rows).withColumn("n_hit", F.lit("clash")).withColumn("decon", F.lit(1)), bench(spark, items))
    assert result(got) == brute(rows, items)


@pytest.mark.parametrize("shard,block", [(64, 1 << 23), (1 << 20, 700)])
def test_shards_and_blocks_do_not_change_the_result(spark, shard, block):
    rows, items = fixture(3)
    found = dc.mark(docs(spark, rows), bench(spark, items), shard_symbols=shard, block_bytes=block).select(
        "doc_id", "decon.*").collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, len(r["items"]), dc.digest_of(r["items"]), r.contaminated) for r in found)
    assert got == brute(rows, items)


def test_clean_and_keep(spark):
    item = " ".join(f"bench{k}" for k in range(20))
    rows = [(1, f"Before {item}, after"), (2, "nothing here"), (3, " ".join(f"w{k}" for k in range(900)) + " " + item), (4, None)]
    b = bench(spark, [(1, item)])
    assert {r.doc_id: r.text for r in dc.clean(docs(spark, rows[:2]), b).collect()} == {1: "Before , after", 2: "nothing here"}
    kept = dc.keep_clean(docs(spark, rows), b)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == docs(spark, rows).columns


def test_empty_tables(spark):
    rows, items = fixture()
    assert dc.op1(spark.createDataFrame([], DOC_SCHEMA), bench(spark, items)).count() == 0
    assert result(dc.op1(docs(spark, rows[:3]), bench(spark, []))) == brute(rows[:3], [])


def test_other_columns_stay_whatever_they_are_called(spark):
    words = " ".join(f"w{i}" for i in range(20))
    wide = docs(spark, [(1, words), (2, "clean text here")]).selectExpr("*", "'mine' as decon", "1 as DECON_")
    bench = spark.createDataFrame([(1, words)], "item_id bigint, text string")
    got = dc.keep_clean(wide, bench)
    assert got.columns == wide.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in wide.filter("doc_id = 2").collect()]
    cut = dc.clean(wide, bench)
    assert cut.columns == wide.columns and {r.doc_id: (r.text, r.decon) for r in cut.collect()} == {1: ("", "mine"), 2: ("clean text here", "mine")}
