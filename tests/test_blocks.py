"""Rules over blocks of time: results don't depend on where blocks are cut, and equal a plain walk."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sightings.operators import alerts as AL
from sightings.plans import catalog as C
from tests.conftest import SF01

BEST = "frame_id long, source string, epoch_s double, best_species string, best_species_conf double"


def best_rows(n, seed):
    rnd = random.Random(seed)
    t, rows = 0.0, []
    for i in range(n):
        t += rnd.choice([0.0, 0.5, 1.0, 2.0, 2.5, 9.0, 60.0])
        rows.append((i, rnd.choice(["a", "a", "b", None]), None if rnd.random() < 0.04 else t, rnd.choice(["x", "x", "y", None]), rnd.choice([0.2, 0.9])))
    rnd.shuffle(rows)
    return rows


def walk(rows, repeat_s, song_s, gap_s):
    """(frame_id -> changed, speak, play, run) and visits, row by row."""
    flags, visits = {}, {}
    for source in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == source and r[3] is not None and r[4] >= 0.5), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        shown, spoken, songs, run, visit, before = None, None, {}, 0, 0, None
        for i, _, t, species, conf in mine:
            changed = species != shown
            if changed:
                shown, spoken, run = species, None, run + 1
            speak = play = False
            if t is not None:
                speak = spoken is None or t - spoken >= repeat_s
                play = species not in songs or t - songs[species] >= song_s
                spoken = t if speak else spoken
                if play:
                    songs[species] = t
            flags[i] = (changed, speak, play, run)
            if before is None or before[0] != species or (before[1] is None) != (t is None) or (t is not None and t - before[1] > gap_s):
                visit += 1
            before = (species, t)
            visits.setdefault((source, visit), []).append((t, conf, species))
    return flags, {(s, n, v[0][2], v[0][0], v[-1][0], len(v), max(c for _, c, _ in v)) for (s, n), v in visits.items()}


@pytest.mark.parametrize("block_s", [3.0, 20.0, 1e6])
def test_announcements_changes_and_visits(spark, block_s):
    rows = best_rows(700, 5)
    df = spark.createDataFrame(rows, BEST).repartition(5)
    flags, visits = walk(rows, 10.0, 4.0, 5.0)
    got = AL.announce(df, 0.5, 10.0, 4.0, block_s=block_s).collect()
    assert {r.frame_id: (r.changed, r.speak, r.play_song) for r in got} == {i: f[:3] for i, f in flags.items()}
    got = AL.species_changes(df, 0.5, block_s=block_s).collect()
    assert {r.frame_id: (r.changed, r.run_id) for r in got} == {i: (f[0], f[3]) for i, f in flags.items()}
    got = AL.species_visits(df, 5.0, 0.5, block_s=block_s).collect()
    assert {tuple(r[c] for c in ("source", "visit_no", "species", "start_epoch_s", "end_epoch_s", "frames", "max_conf")) for r in got} == visits


@pytest.mark.parametrize("block_s", [3.0, 20.0, 1e6])
def test_failures(spark, block_s):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "b", None]), None if rnd.random() < 0.04 else float(rnd.randint(0, 400)), rnd.random() < 0.15) for i in range(900)]
    df = spark.createDataFrame(rows, "attempt_id long, source string, t double, ok boolean").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    want = {}
    for source in {r[1] for r in rows}:
        n, logged, oks = 0, None, 0
        for i, _, t, ok in sorted((r for r in rows if r[1] == source), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            if ok:
                n, logged, oks = 0, None, oks + 1
                continue
            n += 1
            say = t is not None and (logged is None or t - logged > 5.0)
            logged = t if say else logged
            want[i] = (n, say, oks)
    got = AL.failure_runs(df, 5.0, block_s).collect()
    assert {r.attempt_id: (r.fail_n, r.logged, r.island) for r in got} == want


def test_rows_travel_once_and_what_comes_before_is_computed_once(spark):
    out = AL.announce(C.frames_with_best(spark, SF01), 0.5)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(__key#\d+, __blk#", plan)) <= 2 and "ReusedExchange" in plan
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1


def test_one_block_of_many_rows_takes_linear_time(spark):
    took = {}
    for n in (50_000, 50_000, 200_000):
        df = spark.range(n).select(F.col("id").alias("frame_id"), F.lit("hot").alias("source"), (F.col("id") * 0.1).alias("epoch_s"),
                                   F.lit("wren").alias("best_species"), F.lit(0.9).alias("best_species_conf"))
        t0 = time.perf_counter()
        assert AL.announce(df, 0.0, 0.25, 0.15, block_s=1e6).where("speak").count() == -(-n // 3)
        took[n] = time.perf_counter() - t0
    assert took[200_000] < 8 * took[50_000] + 2
