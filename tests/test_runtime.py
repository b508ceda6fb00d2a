"""The runtime job from image files to events, state, facts, annotated frames and rejects."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from sightings.operators import events as EV
from sightings.operators import runtime as RT
from sightings.sinks import writers as W
from sightings.sources import files as FS
from sightings.sources import fixtures as X
from sightings.streaming import streams as ST
from tests.pngs import fixture_images


def _detector():
    return lambda a: [(14, 0.9, 5.0, 6.0, 30.0, 25.0), (3, 0.8, 1.0, 1.0, 4.0, 4.0)]


def _classifier():
    import numpy as np
    return lambda x: np.tile(np.array([[0.0, 4.0, 1.0]], np.float32), (len(x), 1))


def _images():
    d = tempfile.mkdtemp(prefix="sightings-rt-")
    os.makedirs(d + "/cam_1")
    for name, data in fixture_images().items():
        with open(os.path.join(d, "cam_1", name), "wb") as fh:
            fh.write(data)
    return d


def _check(spark, out, batches):
    table = spark.read.parquet(out + "/frames").collect()
    good = [r for r in table if not r.is_corrupt]
    assert len(table) == 6 and len(good) == 4 and all(r.detect_ms is not None and r.source == "cam_1" for r in good)
    lines = [json.loads(r.value) for r in spark.read.text(out + "/events").collect()]
    assert len(lines) == 4 and all(x["source"] == "cam_1" and len(x["detections"]) == 1 for x in lines)
    facts = spark.read.parquet(out + "/sightings").collect()
    assert len(facts) == 4 and {r.detector_label for r in facts} == {"bird"} and {r.classifier_label for r in facts} == {"class_1"}
    state = W.read_state(spark, out + "/state").collect()
    assert len(state) == 1 and state[0].epoch_s == max(x["epoch_s"] for x in lines)
    assert 1 <= spark.read.parquet(out + "/annotated").count() <= 4
    reasons = [r.reason for r in spark.read.parquet(out + "/rejects").collect()]
    assert len(reasons) == 3 and sum("decode failed" in r for r in reasons) == 1
    back, bad = EV.read_events(spark.read.text(out + "/events").select(F.col("value")))
    assert back.count() == 4 and bad.count() == 0
    # crops: one each, named once, and the events say where
    crops = spark.read.parquet(out + "/crops").collect()
    paths = {x["detections"][0]["crop_path"] for x in lines}
    assert len(crops) == 4 and {r.crop_path for r in crops} == paths and len(paths) == 4
    assert all(p.startswith(out + "/crops/class_1/") for p in paths) and all(len(r["data"]) == r.height * r.width * 3 for r in crops)
    assert {x["annotated_image_url"] for x in lines} == {"http://host/latest.jpg"}
    latest = W.read_state(spark, out + "/latest").collect()
    assert len(latest) == 1 and latest[0].epoch_s == state[0].epoch_s and len(latest[0]["data"]) > 0
    assert RT.run_counters(spark, out) == {"frames": 6, "corrupt": 2, "with_detections": 4, "undecodable": 1}
    best = spark.read.parquet(out + "/best").collect()
    assert len(best) == 4 and {r.best_species for r in best} == {"class_1"}
    said = RT.write_alerts(spark, out + "", min_conf=0.5).collect()
    assert sum(r.speak for r in said) >= 1 and {r.spoken_text for r in said} == {"class 1"}


OPTIONS = dict(classifier=_classifier, classifier_key="rt-cls", base_url="http://host/")


def test_batch_and_its_replay(spark):
    out = tempfile.mkdtemp(prefix="sightings-rto-")
    frames = FS.scan_frames(spark, _images() + "/cam_1")
    for _ in range(2):
        counts = RT.run_batch(frames, X.class_dim(spark), out, _detector, "rt", **OPTIONS)
    assert counts == {"frames": 6, "corrupt": 2, "with_detections": 4, "undecodable": 1}
    _check(spark, out, 1)


def test_stream(spark):
    out = tempfile.mkdtemp(prefix="sightings-rts-")
    frames = ST.stream_frames(spark, _images() + "/cam_1", max_files=3)
    q = RT.run_stream(frames, X.class_dim(spark), out, out + "/checkpoint", _detector, "rt", trigger={"availableNow": True}, **OPTIONS)
    q.awaitTermination()
    assert q.exception() is None
    _check(spark, out, 3)


def test_alerts_behind_the_stream(spark):
    """Best species written in batches become announcements, equal to W6 over the whole table."""
    out = tempfile.mkdtemp(prefix="sightings-rta-")
    rows = [(i, f"cam_{i % 2}", 1.7e9 + 7.0 * i, "wren" if i % 9 < 6 else "jay", 0.9) for i in range(60)]
    for b in range(3):
        part = spark.createDataFrame(rows[20 * b:20 * b + 20], "frame_id long, source string, epoch_s double, best_species string, best_species_conf double")
        RT._batch(part.coalesce(1), out + "/best", b)
    want = {(r.frame_id, r.speak, r.play_song) for r in RT.write_alerts(spark, out).collect()}
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ST.ROCKSDB_PROVIDER)
    try:
        late = tempfile.mkdtemp(prefix="sightings-rtb-")
        os.symlink(out + "/best", late + "/best")
        q = RT.run_alerts(spark, late, late + "/checkpoint", "10 seconds", {"availableNow": True})
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    got = {(r.frame_id, r.speak, r.play_song) for r in spark.read.parquet(late + "/alerts").collect()}
    assert got and got == {x for x in want if 1.7e9 + 7.0 * x[0] < (1.7e9 + 7 * 59 - 10) // 30 * 30}


def test_crop_names_over_batches(spark):
    """Crops of the same second in several batches are numbered on; a replay changes nothing."""
    root = tempfile.mkdtemp(prefix="sightings-ledger-") + "/crops"
    t = 1.7e9

    def batch(ids):
        crop = F.struct(F.lit(1).alias("height"), F.lit(1).alias("width"), F.unhex(F.lit("010203")).alias("data"))
        return spark.createDataFrame([(i, 0, t, None, "bird") for i in ids], "frame_id long, det_idx int, epoch_s double, species string, detector_label string") \
            .withColumn("crop", crop)

    def names():
        return sorted((r.frame_id, r.crop_path.rsplit("/", 1)[1]) for r in spark.read.parquet(root).collect())

    stem = "221320_231114"
    W.write_crops(batch([1, 2]), root, batch_id=0)
    W.write_crops(batch([3]), root, batch_id=1)
    want = [(1, f"{stem}.jpg"), (2, f"{stem}_1.jpg"), (3, f"{stem}_2.jpg")]
    assert names() == want
    again = {r.frame_id: r.crop_path for r in W.write_crops(batch([3]), root, batch_id=1).collect()}
    assert names() == want and again[3].endswith(f"{stem}_2.jpg")
    W.write_crops(batch([1, 2]), root, batch_id=0)
    assert names() == want and W.crop_ledger(spark, root).count() == 3
    assert W.write_crops(batch([]), root, batch_id=2).count() == 0 and names() == want
