"""S1, P1, M1, M2, M7, M10 on synthetic PNGs."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from sightings.functions import kernels as K
from sightings.operators import detections as D
from sightings.operators import images as IM
from sightings.sources import files as FS
from tests.pngs import fixture_images

EXPECT = {"noise.png": False, "flat.png": True, "band_30.png": False, "band_35.png": True,
          "top_flat.png": False, "std2.png": False}


def _dir():
    d = tempfile.mkdtemp(prefix="sightings-img-")
    for name, data in fixture_images().items():
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
    return d


def test_read_frames_and_quality(spark):
    d = _dir()
    frames, rejects = FS.read_frames(spark, d)
    rej = {os.path.basename(r["path"]): r["reason"] for r in rejects.collect()}
    assert rej == {"junk.png": "decode failed (4 bytes)"}
    q = IM.frame_quality(frames).select("path", "is_corrupt", "reason").collect()
    got = {os.path.basename(r["path"]): r["is_corrupt"] for r in q}
    assert got == EXPECT
    reasons = {os.path.basename(r["path"]): r["reason"] for r in q}
    assert reasons["flat.png"] == "single value" and reasons["band_35.png"] == "flat rows"


def test_decoded_bgr_matches_written_rgb(spark):
    d = _dir()
    frames, _ = FS.read_frames(spark, d)
    r = frames.where(F.col("path").endswith("noise.png")).first()["image"]
    a = K.to_array(r["data"], r["height"], r["width"], r["nChannels"])
    rnd = np.random.default_rng(5)
    noise = rnd.integers(0, 256, size=(40, 64, 3), dtype=np.uint8)
    assert np.array_equal(a[:, :, ::-1], noise)


def test_tensorize_and_augment(spark):
    d = _dir()
    frames, _ = FS.read_frames(spark, d)
    t = IM.tensorize(frames.where(F.col("path").endswith("/flat.png")), size=8).first()["tensor"]
    assert len(t) == 3 * 8 * 8
    v = (77 / 255.0 - np.array([0.485, 0.456, 0.406])) / np.array([0.229, 0.224, 0.225])
    assert np.allclose(np.array(t).reshape(3, 8, 8)[:, 3, 3], v, atol=1e-5)
    a1 = IM.augment(frames, seed=1, epoch=0, size=8).select("path", "tensor").orderBy("path").collect()
    a2 = IM.augment(frames, seed=1, epoch=0, size=8).select("path", "tensor").orderBy("path").collect()
    a3 = IM.augment(frames, seed=1, epoch=1, size=8).select("path", "tensor").orderBy("path").collect()
    assert [r["tensor"] for r in a1] == [r["tensor"] for r in a2]
    assert [r["tensor"] for r in a1] != [r["tensor"] for r in a3]


def test_crop_and_annotate(spark):
    d = _dir()
    frames, _ = FS.read_frames(spark, d)
    frames = frames.where(F.col("path").endswith("noise.png")).withColumn("frame_id", F.lit(1).cast("long"))
    dets = spark.createDataFrame(
        [(1, 0, "bird", 0.9, 10.7, 5.2, 30.9, 20.1, "blue_jay", 0.8), (1, 1, "cat", 0.5, -3.9, 1.0, 70.0, 50.0, None, None)],
        "frame_id long, det_idx int, detector_label string, confidence float, x1 double, y1 double, x2 double, "
        "y2 double, species string, species_confidence float")
    dets = D.crop_window(D.truncate_bbox(dets), 64, 40, padding=2)
    rows = {r["det_idx"]: r for r in dets.collect()}
    assert rows[1]["bbox_x1"] == -3 and rows[1]["crop_x1"] == 0 and rows[1]["crop_x2"] == 64
    c = {r["det_idx"]: r["crop"] for r in IM.crop_images(frames, dets).collect()}
    assert (c[0]["height"], c[0]["width"]) == (22 - 3, 32 - 8)  # window (8, 3, 32, 22)
    ann = IM.annotate(frames, dets).first()
    assert ann["labels"] == ["bird 0.90 -> blue_jay (0.80)", "cat 0.50"]
    img = K.to_array(ann["annotated"]["data"], 40, 64, 3)
    assert tuple(img[5, 15]) == (0, 255, 0)


def test_crops_and_boxes_read_stored_pixels_in_place(spark, tmp_path):
    """No exchange over image.data, and a frame with many crops is joined once."""
    import re

    from pyspark.sql import functions as F

    from sightings.operators import images as IM
    from sightings.sources import files as FS

    img = F.struct(F.lit("o").alias("origin"), F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(3).alias("nChannels"),
                   F.lit(IM.CV_8UC3).alias("mode"), F.unhex(F.repeat(F.lpad(F.hex(F.col("id") % 200), 2, "0"), 12)).alias("data"))
    frames = FS.store_frames(spark.range(50).select(F.col("id").alias("frame_id"), img.alias("image")), "stored_frames", str(tmp_path / "f"), 16)
    dets = spark.range(120).select((F.col("id") % 40).alias("frame_id"), (F.col("id") / 40).cast("int").alias("det_idx"), F.lit(0).alias("crop_x1"),
                                   F.lit(0).alias("crop_y1"), (1 + F.col("id") % 2).cast("int").alias("crop_x2"), F.lit(1).alias("crop_y2"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        crops = IM.crop_images(frames, dets)
        rows = crops.collect()
        boxes = dets.select("frame_id", "det_idx", F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("bbox"), F.lit("bird").alias("detector_label"),
                            F.lit(0.5).cast("float").alias("confidence"), F.lit(None).cast("string").alias("species"), F.lit(None).cast("float").alias("species_confidence"))
        drawn = IM.annotate(frames, boxes)
        assert drawn.count() == 40
        for df in (crops, drawn):
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
            pixels = plan[plan.index("FileScan"):]
            assert "Bucketed: true" in pixels and len(re.findall("FileScan", plan)) == 1
            scan_line = next(line for line in plan.splitlines() if "FileScan" in line)
            indent = len(scan_line) - len(scan_line.lstrip(" :+-*()0123456789"))
            above = plan.splitlines()[:plan.splitlines().index(scan_line)]
            path, depth = [], indent
            for line in reversed(above):  # the operators between the scan and the root
                at = len(line) - len(line.lstrip(" :+-*()0123456789"))
                if at < depth:
                    path.append(line)
                    depth = at
            assert not any("Exchange" in line for line in path)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE stored_frames")
    assert len(rows) == 120 and {(r.frame_id, r.det_idx) for r in rows} == {(i % 40, i // 40) for i in range(120)}
    assert all(bytes(r.crop.data) == bytes([r.frame_id] * 3 * r.crop_x2) and r.crop.width == r.crop_x2 for r in rows)
