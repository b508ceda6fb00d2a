"""Ordered building blocks against direct Python simulations."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sightings.operators import corpus as CO
from sightings.operators import paths as PA
from sightings.operators import alerts as AL
from sightings.plans.scan import cooldown_flags, ordered_scan, time_block


def simulate_cooldown(rows, c, strict):
    """rows: (key, t, tie) -> set of emitted (key, tie)."""
    out, last = set(), {}
    for k, t, tie in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2])):
        if t is None:
            continue
        l = last.get(k)
        if l is None or ((t - l > c) if strict else (t - l >= c)):
            out.add((k, tie))
            last[k] = t
    return out


@pytest.mark.parametrize("seconds", [20.0, 1e6])
def test_ordered_scan_matches_windows(spark, seconds):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "b", None]), rnd.choice([None, float(rnd.randint(0, 500)), float(rnd.randint(0, 500))]), i,
             rnd.choice([None, rnd.randint(-5, 5)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t double, id int, v int")
    s = ordered_scan(df, ["k"], ["t", "id"], [time_block("t", seconds)], sums={"cs": F.col("v")}, maxes={"cm": F.col("v")},
                     lags={"pv": "v"}, rank_col="r")
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = df.select("id", (F.row_number().over(w) - 1).alias("r2"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs2"),
                    F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cm2"),
                    F.lag("v").over(w).alias("pv2"))
    got = {r["id"]: (r["r"], r["cs"], r["cm"], r["pv"]) for r in s.collect()}
    want = {r["id"]: (r["r2"], r["cs2"], r["cm2"], r["pv2"]) for r in ref.collect()}
    assert got == want


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block_s", [7.0, 50.0, 1e6])
def test_cooldown_flags_equals_simulation(spark, strict, block_s):
    rnd = random.Random(11 + strict)
    rows = []
    for i in range(600):
        t = float(rnd.choice([0, 1, 2, 3, 5, 10]) + rnd.randint(0, 400))
        rows.append((rnd.choice(["x", "y", None]), None if rnd.random() < 0.03 else t, i))
    c = 10.0
    df = spark.createDataFrame(rows, "k string, t double, tie int")
    flags = cooldown_flags(df, ["k"], "t", "tie", c, strict=strict, block_s=block_s)
    assert flags.count() == len(rows)
    got = {(r["k"], r["tie"]) for r in flags.where("emit").collect()}
    assert got == simulate_cooldown(rows, c, strict)


def test_building_an_ordered_query_runs_no_job(spark):
    df = spark.createDataFrame([("a", 1.0, 1)], "k string, t double, tie int")
    best = spark.createDataFrame([(1, "a", 1.0, "wren", 0.9)], "frame_id long, source string, epoch_s double, best_species string, best_species_conf double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    cooldown_flags(df, ["k"], "t", "tie", 5.0)
    AL.announce(best)
    AL.species_visits(best, 5.0)
    assert not tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setJobGroup("rest", "rest")


def test_retain_last_n_with_null_keys(spark):
    rows = [("a" if i % 5 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int")
    kept, expired = PA.retain_last_n(df, ["k"], "v", "v", 3)
    got = sorted((str(r["k"]), r["v"], r["rank"]) for r in kept.collect())
    assert got == [("None", 485, 2), ("None", 490, 1), ("None", 495, 0), ("a", 497, 2), ("a", 498, 1), ("a", 499, 0)]
    assert expired.count() == 494 and not {r["v"] for r in expired.collect()} & {r[1] for r in got}


def test_exact_split_with_equal_samples(spark):
    df = spark.createDataFrame([(f"p{i % 7}",) for i in range(1000)], "path string")
    train, val = CO.split_exact(df, 0.8, seed=7)
    assert (train.count(), val.count()) == (800, 200) and train.columns == ["path"]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 501, 997, 1000])
def test_exact_split_sizes(spark, n):
    df = spark.createDataFrame([(f"root/c/{i}.jpg",) for i in range(n)], "path string")
    train, val = CO.split_exact(df, 0.8, seed=7)
    t = [r[0] for r in train.collect()]
    v = [r[0] for r in val.collect()]
    assert len(t) == int(0.8 * n) and len(v) == n - int(0.8 * n)
    assert not set(t) & set(v) and len(set(t) | set(v)) == n


def test_hot_key_is_split_across_blocks(spark):
    # no window of the plan is partitioned by the camera alone, but for the one over the block summary
    df = spark.createDataFrame([("hot", float(i), i) for i in range(100)], "k string, t double, id int")
    s = ordered_scan(df, ["k"], ["t", "id"], [time_block("t", 10.0)], sums={"c": F.lit(1)}, rank_col="r")
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and sum("__blk" not in line.split("windowspecdefinition")[1].split(" ASC")[0] for line in windows) <= len(windows)
    got = {r["id"]: (r["r"], r["c"]) for r in s.collect()}
    assert got[99] == (99, 100) and got[37] == (37, 38)


def test_cooldown_kernels():
    import numpy as np

    from sightings.plans import cooldown as C
    rnd = np.random.default_rng(2)
    for strict in (False, True):
        t = np.sort(rnd.integers(0, 400, 300) / 4.0)
        end, gap = np.full(300, 300), np.full(300, 2.5)
        following = C.next_rows(t, end, gap, strict)
        for i in range(300):
            later = [j for j in range(i + 1, 300) if (t[j] - t[i] > 2.5 if strict else t[j] - t[i] >= 2.5)]
            assert following[i] == (later[0] if later else 300)
        walk = [0]
        while following[walk[-1]] < 300:
            walk.append(int(following[walk[-1]]))
        assert np.flatnonzero(C.marked(np.array([0]), following, end)).tolist() == walk
        assert C.last_reached(following, end)[0] == walk[-1]


def test_many_rows_in_one_block_take_linear_time(spark):
    import time
    took = {}
    for n in (50_000, 50_000, 200_000):
        df = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 0.1).alias("t"), "id")
        t0 = time.perf_counter()
        flags = cooldown_flags(df, ["k"], "t", "id", 0.25, block_s=1e6)
        assert flags.where("emit").count() == -(-n // 3)
        took[n] = time.perf_counter() - t0
    assert took[200_000] < 8 * took[50_000] + 2


def test_split_scans_the_stored_hashes_twice_for_the_cut(spark):
    """Two jobs find the cut, and what comes before the split is computed once."""
    from sightings.plans import scan as SC

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(f"root/c/{i}.jpg",) for i in range(5000)], "path string").mapInArrow(count, "path string")
    train, val = CO.split_exact(df, 0.8, seed=3)
    assert (train.count(), val.count()) == (4000, 1000) and seen.value == 5000
    keyed = spark.range(3000).select((F.col("id") % 7).alias("h"), (F.col("id") % 3).cast("string").alias("t"))
    ordered = sorted((i % 7, str(i % 3)) for i in range(3000))
    for k in (0, 1, 1700, 2999):
        for fetch in (1 << 17, 5):
            h, t, copies = SC.exact_rank_threshold(keyed, "h", "t", lambda n: k, fetch)
            assert (h, t) == ordered[k] and copies == k - ordered.index((h, t))
    assert SC.exact_rank_threshold(keyed, "h", "t", lambda n: n) is None
