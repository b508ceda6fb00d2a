"""Out-of-order streams on map states and timers equal their batch operators."""

import os
import random
import tempfile
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sightings.operators import alerts as AL
from sightings.plans import catalog as C
from sightings.sources import fixtures as X
from sightings.streaming import ordered as OR
from sightings.streaming import streams as ST
from tests.conftest import SF01


@pytest.fixture(autouse=True)
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ST.ROCKSDB_PROVIDER)
    yield
    spark.conf.set(name, before)


def shuffled_files(pdf, time_col, slice_s, parts, seed):
    """Files whose rows are out of order by less than ``slice_s`` seconds."""
    rnd = random.Random(seed)
    keys = [(int(t // slice_s), rnd.random()) for t in pdf[time_col]]
    pdf = pdf.iloc[sorted(range(len(pdf)), key=lambda i: keys[i])].reset_index(drop=True)
    d, base, n = tempfile.mkdtemp(prefix="sightings-ordered-"), time.time() - 1000, len(pdf)
    for i in range(parts):
        f = os.path.join(d, f"part-{i:03d}.parquet")
        pq.write_table(pa.Table.from_pandas(pdf.iloc[i * n // parts:(i + 1) * n // parts], preserve_index=False), f, coerce_timestamps="us")
        os.utime(f, (base + i, base + i))
    return d


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_announce(spark):
    best = C.frames_with_best(spark, SF01)
    batch = {(r["frame_id"], r["changed"], r["speak"], r["play_song"]) for r in AL.announce(best, 0.5).collect()}
    pdf = best.toPandas()
    s = ST.stream_table(spark, shuffled_files(pdf, "epoch_s", 40, 5, 4), ST.BEST_SCHEMA, max_files=1)
    q = run(OR.announce_in_order(s, "60 seconds", 0.5), "ordered_announce")
    got = [(r["frame_id"], r["changed"], r["speak"], r["play_song"]) for r in spark.table("ordered_announce").collect()]
    closed = (pdf["epoch_s"].max() - 60) // OR.SLOT_S * OR.SLOT_S
    known = set(pdf.loc[pdf["epoch_s"] < closed, "frame_id"])
    assert len(got) == len(set(got)) > 4000 and set(got) == {x for x in batch if x[0] in known}
    assert sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p.get("stateOperators", [])) == 0


def test_failures(spark):
    a = X.attempts(spark, SF01)
    batch = {(r["attempt_id"], r["fail_n"], r["logged"]) for r in AL.failure_runs(a).collect()}
    pdf = a.withColumn("t", AL.epoch_seconds("ts")).toPandas()
    s = ST.stream_table(spark, shuffled_files(pdf, "t", 3600, 4, 9), ST.ATTEMPT_SCHEMA, max_files=1)
    run(OR.failures_in_order(s, "2 hours", slot_s=900.0), "ordered_failures")
    got = {(r["attempt_id"], r["fail_n"], r["logged"]) for r in spark.table("ordered_failures").collect()}
    closed = (pdf["t"].max() - 7200) // 900 * 900
    known = set(pdf.loc[pdf["t"] < closed, "attempt_id"])
    assert got == {x for x in batch if x[0] in known} and len(got) > 1500


def visits_of(rows):
    return {tuple(r[c] for c in ("source", "visit_no", "species", "start_epoch_s", "end_epoch_s", "frames", "max_conf")) for r in rows}


def test_visits(spark):
    best = C.frames_with_best(spark, SF01)
    batch = visits_of(AL.species_visits(best, C.VISIT_GAP_S, 0.5).collect())
    pdf = best.toPandas()
    s = ST.stream_table(spark, shuffled_files(pdf, "epoch_s", 40, 4, 5), ST.BEST_SCHEMA, max_files=1)
    run(OR.visits_stream(s, C.VISIT_GAP_S, "60 seconds", 0.5), "ordered_visits")
    got = visits_of(spark.table("ordered_visits").collect())
    closed = (pdf["epoch_s"].max() - 60) // OR.SLOT_S * OR.SLOT_S
    assert got <= batch and {v for v in batch if v[4] + C.VISIT_GAP_S + OR.SLOT_S < closed} <= got and len(got) > 3000


def test_visits_by_camera_and_by_timer(spark):
    """Cameras don't share visits, a change of species in between splits one, and the watermark ends the last."""
    rows = [("a", 1, 0.0, "wren", 0.9), ("b", 2, 1.0, "wren", 0.8), ("a", 3, 2.0, "jay", 0.7), ("a", 4, 4.0, "wren", 0.6),
            ("a", 5, 9.0, "wren", 0.5), ("b", 6, 500.0, "jay", 0.9), ("c", 7, 900.0, "wren", 1.0)]
    rows = [(c, i, 1e9 + t, sp, conf) for c, i, t, sp, conf in rows]
    best = spark.createDataFrame(rows, "source string, frame_id long, epoch_s double, best_species string, best_species_conf double")
    s = ST.stream_table(spark, shuffled_files(best.toPandas(), "epoch_s", 1, 2, 1), ST.BEST_SCHEMA, max_files=1)
    run(OR.visits_stream(s, 6.0, "10 seconds", slot_s=5.0), "ordered_visits_small")
    got = visits_of(spark.table("ordered_visits_small").collect())
    want = visits_of(AL.species_visits(best, 6.0).collect())
    assert got == {v for v in want if v[0] != "c"} and len(got) == 5


class Handle:
    """Counts what a processor touches."""

    def __init__(self):
        self.reads, self.writes, self.timers = 0, 0, set()

    def getMapState(self, *_):
        handle, data = self, {}

        class State:
            def containsKey(self, k):
                return k in data

            def getValue(self, k):
                handle.reads += 1
                return data[k]

            def updateValue(self, k, v):
                handle.writes += 1
                data[k] = v

            def removeKey(self, k):
                del data[k]

        return State()

    def getValueState(self, *_):
        box = []

        class State:
            def exists(self):
                return bool(box)

            def get(self):
                return box[0]

            def update(self, v):
                box[:] = [v]

            def clear(self):
                box.clear()

        return State()

    def registerTimer(self, at):
        self.timers.add(at)


def test_a_batch_touches_only_its_slots():
    import pandas as pd

    h, p = Handle(), OR.Failures(10.0, 5.0)
    p.init(h)
    for slot in range(500):  # 500 slots wait
        p.handleInputRows(("a",), iter([pd.DataFrame({"t": [slot * 10.0 + 1], "attempt_id": [slot], "ok": [False]})]), None)
    assert h.reads == 0 and h.writes == 500 and len(h.timers) == 500

    class Info:
        def getExpiryTimeInMs(self):
            return 10_000

    class Values:
        def getCurrentWatermarkInMs(self):
            return 10_000

    out = list(p.handleExpiredTimer(("a",), Values(), Info()))
    assert h.reads == 1 and len(out) == 1 and out[0]["attempt_id"].tolist() == [0]
    p.handleInputRows(("a",), iter([pd.DataFrame({"t": [21.0, 22.0], "attempt_id": [7, 8], "ok": [True, False]})]), None)
    assert h.reads == 2 and h.writes == 501
