import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sightings.llm import mixing
from tests.llm.util import DOC_SCHEMA, docs


def brute_targets(sizes):
    """sizes: {source: words}; the contract's resharing, step by step."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(1e-300, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(rows, result):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for r in rows:
        per[r[3]] += size(r[1])
    want = brute_targets(per)
    assert sorted(str((r[0], size(r[1]), per[r[3]])) for r in rows) == sorted(str((r.doc_id, r.size, r.source_size)) for r in result)
    taken, biggest = defaultdict(int), defaultdict(int)
    src = {}
    for r in rows:
        src.setdefault(r[0], r[3])
    for r in result:
        s = r.source
        assert abs(r.target - want[s]) <= 1e-9 * max(1, want[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= biggest[s] + 1e-6, (s, taken[s], want[s], biggest[s])


def test_targets_sizes_and_totals(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(900):
        s = rng.choice(["a", "b", "é", "Z", "big", "tiny"], p=[.2, .1, .1, .1, .49, .01])
        rows.append((k, " \t".join(["w"] * int(rng.integers(0, 60))), "en", str(s)))
    rows += [(k, "one two", "en", None) for k in range(1000, 1020)] + [(1, None, "en", "a"), (5, "x y", "en", "a"), (5, "x y", "en", "a"),
                                                                    (None, "n u l l", "en", "b"), (7000, "", "en", "void")]
    d = docs(spark, rows).withColumn("target", F.lit("clash")).withColumn("n", F.lit(1))
    got = mixing.mix(d, fan_in=8).collect()
    check(rows, got)
    again = mixing.mix(d.repartition(2), fan_in=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_expectation_of_the_rounding(spark):
    items = spark.createDataFrame([(k, "s", 1 + k % 7, 1, 0.1 + 0.8 * (k % 5) / 5) for k in range(40)],
                                  "doc_id bigint, source string, size bigint, n bigint, p double")
    total = np.zeros(40)
    runs = 6
    words = []
    for seed in range(runs):
        out = mixing.rounded(items, fan_in=16, seed=seed).collect()
        assert len(out) == 40
        for r in out:
            total[r.doc_id] += r.up
        words.append(sum(r.up * r.size for r in out))
    want = sum((1 + k % 7) * (0.1 + 0.8 * (k % 5) / 5) for k in range(40))
    assert max(abs(w - want) for w in words) <= 7
    low = np.mean([total[k] / runs for k in range(40) if k % 5 == 0])
    high = np.mean([total[k] / runs for k in range(40) if k % 5 == 4])
    assert abs(low - 0.1) < 0.2 and abs(high - 0.74) < 0.2


def test_empty_tables_and_one_row(spark):
    assert mixing.op7(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    row = mixing.op7(docs(spark, [(1, "a b c", "en", "s")])).first()
    assert (row.size, row.source_size, row.target, row.taken) == (3, 3, 3.0, 3)
    row = mixing.op7(docs(spark, [(1, None, "en", None)])).first()
    assert (row.size, row.target, row.taken) == (0, 0.0, 0)


def test_no_python_in_the_plan(spark):
    plan = mixing.op7(docs(spark, [(1, "a b", "en", "s"), (2, "c", "en", "t")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
