"""W6 (announce) and W4 (failure runs) against a direct simulation of the runtime rules on random
sequences, with null cameras and times."""

import random

import pytest

from sightings.operators import alerts as AL


def simulate_announce(rows, min_conf, repeat_s, song_s):
    """rows: (frame_id, source, epoch_s, species, conf) -> {frame_id: (changed, speak, song)}."""
    out = {}
    state = {}
    for fid, src, t, sp, conf in sorted(rows, key=lambda r: (str(r[1]), -1 if r[2] is None else r[2], r[0])):
        if sp is None or conf < min_conf:
            continue
        cur, spoken, song = state.setdefault(src, [None, {}, {}])
        changed = cur is None or sp != cur
        if changed:
            state[src][0] = sp
            spoken.pop(sp, None)  # a change speaks whatever the clock says
        if t is None:
            out[fid] = (changed, False, False)
            continue
        speak = sp not in spoken or t - spoken[sp] >= repeat_s
        play = sp not in song or t - song[sp] >= song_s
        if speak:
            spoken[sp] = t
        if play:
            song[sp] = t
        out[fid] = (changed, speak, play)
    return out


def simulate_failures(rows, quiet_s):
    """rows: (attempt_id, source, t, ok) -> {attempt_id: (n, logged)}."""
    out, state = {}, {}
    for aid, src, t, ok in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        n, last = state.get(src, (0, 0.0))
        if ok:
            state[src] = (0, last)
            continue
        n += 1
        logged = n == 1 or t - last > quiet_s
        if logged:
            last = t
        state[src] = (n, last)
        out[aid] = (n, logged)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_announce_equals_simulation(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(700):
        src = rnd.choice(["a", "b", None])
        t = float(rnd.randint(0, 2400)) + rnd.choice([0.0, 0.5])  # many equal times -> frame_id ties
        sp = rnd.choice(["jay", "wren", "tit", None])
        rows.append((i, src, (0.0 if seed == 2 else 1.7e9) + t if rnd.random() < 0.97 else None, sp, rnd.choice([0.2, 0.5, 0.9])))
    df = spark.createDataFrame(rows, "frame_id long, source string, epoch_s double, best_species string, "
                                     "best_species_conf double")
    got = {r["frame_id"]: (r["changed"], r["speak"], r["play_song"])
           for r in AL.announce(df, 0.5).collect()}
    assert got == simulate_announce(rows, 0.5, 60.0, 10.0)


def test_failure_runs_equal_simulation(spark):
    rnd = random.Random(7)
    t = 1.7e9
    rows = []
    for i in range(800):
        t += rnd.choice([0.2, 1.0, 2.0, 3.5, 6.0])
        rows.append((i, rnd.choice(["x", None]), t, rnd.random() < 0.35))
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "attempt_id long, source string, t double, ok boolean") \
        .withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).drop("t")
    res = AL.failure_runs(df).collect()
    got = {r["attempt_id"]: (r["fail_n"], r["logged"]) for r in res}
    # the operator's clock is microsecond epoch seconds
    micro = [(a, s, int(x * 1_000_000) / 1_000_000, ok) for a, s, x, ok in rows]
    assert got == simulate_failures(micro, 5.0)
