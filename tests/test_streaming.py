"""Streams equal their batch operators (availableNow over split files), plus T2/T6/T7/T8/T9."""

import os
import tempfile
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sightings.operators import alerts as AL
from sightings.operators import events as EV
from sightings.plans import catalog as C
from sightings.sources import fixtures as X
from sightings.streaming import streams as ST
from tests.conftest import SF01


def _split_files(pdf, order_col, parts):
    d = tempfile.mkdtemp(prefix="sightings-stream-")
    pdf = pdf.sort_values(order_col).reset_index(drop=True)
    n = len(pdf)
    base = time.time() - 1000
    for i in range(parts):
        chunk = pdf.iloc[i * n // parts:(i + 1) * n // parts]
        f = os.path.join(d, f"part-{i:03d}.parquet")
        pq.write_table(pa.Table.from_pandas(chunk, preserve_index=False), f, coerce_timestamps="us")
        os.utime(f, (base + i, base + i))
    return d


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_announce_stream_equals_batch(spark):
    bf = C.frames_with_best(spark, SF01)
    batch = {(r["frame_id"], r["changed"], r["speak"], r["play_song"])
             for r in AL.announce(bf, 0.5).collect()}
    d = _split_files(bf.toPandas(), "epoch_s", 5)
    s = ST.stream_table(spark, d, ST.BEST_SCHEMA, max_files=1)
    _run(ST.announce_stream(s, 0.5), "announce_out")
    got = {(r["frame_id"], r["changed"], r["speak"], r["play_song"]) for r in spark.table("announce_out").collect()}
    assert got == batch and len(got) == 4869


def test_failure_stream_equals_batch(spark):
    a = X.attempts(spark, SF01)
    batch = {(r["attempt_id"], r["fail_n"], r["logged"]) for r in AL.failure_runs(a).collect()}
    pdf = a.withColumn("t", AL.epoch_seconds("ts")).toPandas()
    d = _split_files(pdf.drop(columns=["t"]).assign(_t=pdf["t"]), "_t", 4)
    s = ST.stream_table(spark, d, ST.ATTEMPT_SCHEMA + ", _t DOUBLE", max_files=1)
    _run(ST.failure_monitor_stream(s), "failure_out")
    got = {(r["attempt_id"], r["fail_n"], r["logged"]) for r in spark.table("failure_out").collect()}
    assert got == batch


def test_event_reader_versions_and_rejects(spark):
    lines = [
        '{"event_id":"a-1","ts":"2024-01-01T00:00:00+00:00","epoch_s":1.0,"source":"cam","annotated_image_path":"p",'
        '"annotated_image_url":null,"best_species":"wren","best_species_conf":0.8,'
        '"detections":[{"class":"bird","confidence":0.9,"bbox":[1,2,3,4],"species":"wren","species_confidence":0.8,"crop_path":null}]}',
        '{"event_id":"b-2","ts":"2024-01-01T00:00:02+00:00","epoch_s":2.0,"source":"cam","yolo_label":"bird",'
        '"yolo_conf":0.7,"species":"jay","species_conf":0.6,"annotated_image":"q"}',
        '{"event_id":"c-3","ts":"2024-01-01T00:00:04',
    ]
    ev, rej = EV.read_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = {r["event_id"]: r for r in ev.collect()}
    assert set(rows) == {"a-1", "b-2"}
    assert rows["b-2"]["best_species"] == "jay" and rows["b-2"]["detections"][0]["class"] == "bird"
    assert rows["b-2"]["annotated_image_path"] == "q" and rows["b-2"]["schema_version"] == 2
    assert rows["a-1"]["detections"][0]["bbox"] == [1, 2, 3, 4]
    assert [r["reason"] for r in rej.collect()] == ["malformed json"]


def test_event_json_roundtrip_stream_and_dedupe(spark):
    ev = EV.build_events(X.frames(spark, SF01), C.kept_detections(spark, SF01)).limit(50)
    js = EV.to_event_json(ev).select("value").toPandas()
    dup = js.iloc[:10]  # delivered twice (QoS >= 1)
    d = tempfile.mkdtemp(prefix="sightings-ev-")
    for i, part in enumerate([js, dup]):
        with open(os.path.join(d, f"e{i}.jsonl"), "w") as fh:
            fh.write("\n".join(part["value"]) + "\n")
    evs, _rej = ST.stream_events(spark, d)
    evs = evs.withColumn("event_time", F.to_timestamp("ts"))
    _run(ST.dedupe_events(evs, "event_time", "1 hour"), "dedup_out")
    assert spark.table("dedup_out").count() == 50


def test_conflate_counts_and_latest_state(spark):
    rows = [("cam_a", i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 3, 8, 11, 12, 25])]
    pdf = spark.createDataFrame(rows, "source string, frame_id long, t string") \
        .withColumn("scheduled_at", F.to_timestamp("t")).drop("t").toPandas()
    d = _split_files(pdf, "scheduled_at", 2)
    s = ST.stream_table(spark, d, "source STRING, frame_id LONG, scheduled_at TIMESTAMP", max_files=1)
    _run(ST.conflate_stream(s, 10, "0 seconds"), "conf_out")
    got = sorted((r["frame_id"], r["frames_in_slot"]) for r in spark.table("conf_out").collect())
    # the slot holding 00:25 stays open: no later event moved the watermark past its end
    assert got == [(2, 3), (4, 2)]
    c = ST.species_counts_stream(s.withColumn("best_species", F.lit("wren")), "scheduled_at", "0 seconds",
                                 session_gap="5 seconds")
    _run(c, "sess_out")
    # 0,3,8,11,12 chain within 5 s (touching sessions merge); the session at 00:25 is still open
    assert sorted(r["n"] for r in spark.table("sess_out").collect()) == [5]
    ev = spark.createDataFrame([("cam_a", "e1", 1.0), ("cam_a", "e2", 5.0), ("cam_b", "e3", 2.0)],
                               "source string, event_id string, epoch_s double")
    pdf2 = ev.toPandas()
    d2 = _split_files(pdf2, "epoch_s", 2)
    s2 = ST.stream_table(spark, d2, "source STRING, event_id STRING, epoch_s DOUBLE", max_files=1)
    _run(ST.latest_state_stream(s2), "state_out", mode="complete")
    assert {r["source"]: r["event_id"] for r in spark.table("state_out").collect()} == {"cam_a": "e2", "cam_b": "e3"}


def test_observed_counters(spark):
    f = spark.createDataFrame([(1, True), (2, False), (3, True)], "frame_id long, has_detection boolean")
    from pyspark.sql import Observation
    obs = Observation("run_counters")
    f.observe(obs, F.count(F.lit(1)).alias("frames_processed"),
              F.sum(F.col("has_detection").cast("long")).alias("frames_with_detections")).collect()
    assert obs.get == {"frames_processed": 3, "frames_with_detections": 2}
    d = _split_files(f.toPandas(), "frame_id", 2)
    s = ST.observe_counters(ST.stream_table(spark, d, "frame_id LONG, has_detection BOOLEAN", max_files=1))
    q = _run(s, "obs_out")
    metrics = [p["observedMetrics"]["run_counters"] for p in q.recentProgress if p.get("observedMetrics")]
    assert sum(m["frames_processed"] for m in metrics) == 3


def test_announce_stream_out_of_order_with_watermark(spark):
    import random

    bf = C.frames_with_best(spark, SF01)
    batch = {(r["frame_id"], r["changed"], r["speak"], r["play_song"]) for r in AL.announce(bf, 0.5).collect()}
    pdf = bf.toPandas().sort_values("epoch_s").reset_index(drop=True)
    # arrival order: shuffled inside 40-second slices (disorder below the 60 s watermark delay)
    rnd = random.Random(4)
    pdf["_slice"] = (pdf["epoch_s"] // 40).astype(int)
    pdf["_r"] = [rnd.random() for _ in range(len(pdf))]
    pdf = pdf.sort_values(["_slice", "_r"]).drop(columns=["_slice", "_r"]).reset_index(drop=True)
    d = tempfile.mkdtemp(prefix="sightings-ooo-")
    base = time.time() - 1000
    n = len(pdf)
    for i in range(6):
        f = os.path.join(d, f"part-{i:03d}.parquet")
        pq.write_table(pa.Table.from_pandas(pdf.iloc[i * n // 6:(i + 1) * n // 6], preserve_index=False), f)
        os.utime(f, (base + i, base + i))
    s = ST.stream_table(spark, d, ST.BEST_SCHEMA, max_files=1)
    _run(ST.announce_stream(s, 0.5, watermark="60 seconds"), "announce_ooo")
    got = {(r["frame_id"], r["changed"], r["speak"], r["play_song"]) for r in spark.table("announce_ooo").collect()}
    final_wm = pdf["epoch_s"].max() - 60
    want = {x for x in batch if x[0] in set(pdf.loc[pdf["epoch_s"] <= final_wm, "frame_id"])}
    assert got == want and len(got) > 4000


def test_failure_stream_out_of_order_with_watermark(spark):
    import random

    a = X.attempts(spark, SF01)
    batch = {(r["attempt_id"], r["fail_n"], r["logged"]) for r in AL.failure_runs(a).collect()}
    pdf = a.withColumn("t", AL.epoch_seconds("ts")).toPandas().sort_values("t").reset_index(drop=True)
    rnd = random.Random(9)
    pdf["_slice"] = (pdf["t"] // 3600).astype(int)
    pdf["_r"] = [rnd.random() for _ in range(len(pdf))]
    pdf = pdf.sort_values(["_slice", "_r"]).reset_index(drop=True)
    t = pdf["t"]
    pdf = pdf.drop(columns=["_slice", "_r", "t"])
    d = tempfile.mkdtemp(prefix="sightings-ooo4-")
    base = time.time() - 1000
    n = len(pdf)
    for i in range(5):
        f = os.path.join(d, f"part-{i:03d}.parquet")
        pq.write_table(pa.Table.from_pandas(pdf.iloc[i * n // 5:(i + 1) * n // 5], preserve_index=False), f,
                       coerce_timestamps="us")
        os.utime(f, (base + i, base + i))
    s = ST.stream_table(spark, d, ST.ATTEMPT_SCHEMA, max_files=1)
    _run(ST.failure_monitor_stream(s, watermark="2 hours"), "failure_ooo")
    got = {(r["attempt_id"], r["fail_n"], r["logged"]) for r in spark.table("failure_ooo").collect()}
    final = set(pdf.loc[t <= t.max() - 7200, "attempt_id"])
    assert got == {x for x in batch if x[0] in final} and len(got) > 1500


def test_conflate_and_state_streams_equal_batch(spark):
    f = X.frames(spark, SF01).select("source", "frame_id", "epoch_s") \
        .withColumn("scheduled_at", F.timestamp_seconds("epoch_s"))
    batch = {(r["source"], r["frame_id"], r["frames_in_slot"]) for r in AL.conflate(f, 10.0).collect()}
    pdf = f.toPandas()
    d = _split_files(pdf, "epoch_s", 4)
    s = ST.stream_table(spark, d, "source STRING, frame_id LONG, epoch_s DOUBLE, scheduled_at TIMESTAMP", max_files=1)
    _run(ST.conflate_stream(s, 10, "0 seconds"), "conflate_eq")
    got = {(r["source"], r["frame_id"], r["frames_in_slot"]) for r in spark.table("conflate_eq").collect()}
    # every slot except the newest one per source is closed by the watermark
    last = pdf.groupby("source")["epoch_s"].max().to_dict()
    open_slots = {(src, int(t // 10)) for src, t in last.items()}
    closed = {x for x in batch
              if (x[0], int(pdf.loc[pdf["frame_id"] == x[1], "epoch_s"].iloc[0] // 10)) not in open_slots}
    assert got == closed and len(got) > 8000
    ev = EV.build_events(X.frames(spark, SF01), C.kept_detections(spark, SF01)).select("source", "event_id", "epoch_s")
    want = {(r["source"], r["event_id"]) for r in EV.latest_per_key(ev, ["source"], ["epoch_s", "event_id"]).collect()}
    d2 = _split_files(ev.toPandas(), "epoch_s", 3)
    s2 = ST.stream_table(spark, d2, "source STRING, event_id STRING, epoch_s DOUBLE", max_files=1)
    _run(ST.latest_state_stream(s2), "state_eq", mode="complete")
    assert {(r["source"], r["event_id"]) for r in spark.table("state_eq").collect()} == want


def test_announce_transform_with_state_equals_batch(spark):
    bf = C.frames_with_best(spark, SF01)
    batch = {(r["frame_id"], r["changed"], r["speak"], r["play_song"]) for r in AL.announce(bf, 0.5).collect()}
    d = _split_files(bf.toPandas(), "epoch_s", 4)
    prev = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB_PROVIDER)
    try:
        s = ST.stream_table(spark, d, ST.BEST_SCHEMA, max_files=1)
        _run(ST.announce_stream_tws(s, 0.5), "announce_tws")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", prev)
    got = {(r["frame_id"], r["changed"], r["speak"], r["play_song"]) for r in spark.table("announce_tws").collect()}
    assert got == batch and len(got) == 4869


def test_windowed_counts_drop_and_count_late_rows(spark):
    rows1 = [("wren", f"2024-01-01 00:{m:02d}:00") for m in range(0, 30, 3)]
    rows2 = [("wren", "2024-01-01 00:40:00")]
    # late: older than the watermark of the batch before it (Spark filters late input with it)
    rows3 = [("wren", "2024-01-01 00:01:00"), ("wren", "2024-01-01 00:41:00")]
    d = tempfile.mkdtemp(prefix="sightings-late-")
    base = time.time() - 1000
    for i, rows in enumerate([rows1, rows2, rows3]):
        pdf = spark.createDataFrame(rows, "best_species string, t string") \
            .withColumn("ts", F.to_timestamp("t")).drop("t").toPandas()
        f = os.path.join(d, f"part-{i}.parquet")
        pq.write_table(pa.Table.from_pandas(pdf, preserve_index=False), f, coerce_timestamps="us")
        os.utime(f, (base + i, base + i))
    s = ST.stream_table(spark, d, "best_species STRING, ts TIMESTAMP", max_files=1)
    q = _run(ST.species_counts_stream(s, "ts", "5 minutes", window="10 minutes"), "late_out")
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p.get("stateOperators", []))
    assert dropped == 1
    counts = {str(r["window_start"]): r["n"] for r in spark.table("late_out").collect()}
    assert counts["2024-01-01 00:00:00"] == 4  # 00:00, 00:03, 00:06, 00:09 - the late 00:01 is not added


def test_state_batch_writer_merges_micro_batches(spark):
    from sightings.sinks import writers as W

    ev = EV.build_events(X.frames(spark, SF01), C.kept_detections(spark, SF01)).select("source", "event_id", "epoch_s")
    want = {(r["source"], r["event_id"]) for r in EV.latest_per_key(ev, ["source"], ["epoch_s", "event_id"]).collect()}
    d = _split_files(ev.toPandas(), "epoch_s", 3)
    target = tempfile.mkdtemp(prefix="sightings-state-") + "/state"
    s = ST.stream_table(spark, d, "source STRING, event_id STRING, epoch_s DOUBLE", max_files=1)
    q = s.writeStream.foreachBatch(W.state_batch_writer(target)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["source"], r["event_id"]) for r in W.read_state(spark, target).collect()} == want
