"""T5 as a stream-stream join equals batch, with bounded state; T9's listener equals A8."""

import os
import random
import tempfile
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sightings.operators import detections as D
from sightings.operators import events as EV
from sightings.plans import catalog as C
from sightings.sources import fixtures as X
from sightings.streaming import counters as CT
from sightings.streaming import joined as JO
from sightings.streaming import streams as ST
from tests.conftest import SF01

FRAME_SCHEMA = "frame_id LONG, source STRING, epoch_s DOUBLE, scheduled_at TIMESTAMP"
BOX_SCHEMA = ("frame_id LONG, det_idx INT, cls_id INT, confidence FLOAT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, species STRING, "
              "species_confidence FLOAT, detected_at TIMESTAMP")


def write_parts(pdf, parts, start=0):
    d, base, n = tempfile.mkdtemp(prefix="sightings-joined-"), time.time() - 1000, len(pdf)
    for i in range(parts):
        f = os.path.join(d, f"part-{i:03d}.parquet")
        pq.write_table(pa.Table.from_pandas(pdf.iloc[i * n // parts:(i + 1) * n // parts], preserve_index=False), f, coerce_timestamps="us")
        os.utime(f, (base + i, base + i))
    return d


def events_of(df):
    return {(r.frame_id, r.event_id, r.best_species, r.best_species_conf, len(r.detections), r.detections[0]["class"]) for r in df.collect()}


def test_events_of_late_boxes_equal_batch(spark):
    frames = X.frames(spark, SF01).where("frame_id < 16000").select("frame_id", "source", "epoch_s")
    boxes = X.boxes(spark, SF01).where("frame_id < 16000")
    batch = events_of(EV.build_events(frames, D.detections(boxes, X.class_dim(spark))))
    fpdf = frames.withColumn("scheduled_at", F.timestamp_seconds("epoch_s")).orderBy("epoch_s").toPandas()
    # a box is made 1 to 40 seconds after its frame and arrives in that order, so a frame's boxes come in several files
    late = (F.lit(1) + F.pmod(F.xxhash64("frame_id", "det_idx"), F.lit(40))).cast("double")
    made = boxes.join(frames.select("frame_id", "epoch_s"), "frame_id").withColumn("_t", F.col("epoch_s") + late)
    bpdf = made.withColumn("detected_at", F.timestamp_seconds("_t")).orderBy("_t").drop("epoch_s", "_t").toPandas()
    random.Random(3)
    fs = ST.stream_table(spark, write_parts(fpdf, 8), FRAME_SCHEMA, max_files=1)
    bs = ST.stream_table(spark, write_parts(bpdf, 8), BOX_SCHEMA, max_files=1)
    ev = JO.detection_events_stream(bs, fs, X.class_dim(spark), watermark="10 seconds")
    q = ev.writeStream.format("memory").queryName("joined_events").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = events_of(spark.table("joined_events"))
    newest = min(fpdf["epoch_s"].max(), bpdf["detected_at"].max().timestamp())
    closed = set(fpdf.loc[fpdf["epoch_s"] < newest - 10 - 60 - 5, "frame_id"])
    assert got <= batch and {e for e in batch if e[0] in closed} <= got and len(got) > 1000
    join = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"] if "symmetricHashJoin" in op["operatorName"]]
    rows = len(fpdf) + len(bpdf)
    assert join and max(join) < 0.5 * rows and join[-1] < 0.05 * rows
    assert sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p["stateOperators"]) == 0


def test_listener_totals_equal_the_batch_counters(spark):
    frames, dets = X.frames(spark, SF01), C.kept_detections(spark, SF01)
    want = D.run_counters(frames, dets).first().asDict()
    has = frames.join(dets.select("frame_id").distinct().withColumn("has_detection", F.lit(True)), "frame_id", "left") \
        .select("frame_id", F.coalesce("has_detection", F.lit(False)).alias("has_detection"))
    s = ST.stream_table(spark, write_parts(has.toPandas(), 5), "frame_id LONG, has_detection BOOLEAN", max_files=1)
    stored = tempfile.mkdtemp(prefix="sightings-counters-")
    listener = CT.CounterListener(path=stored)
    spark.streams.addListener(listener)
    try:
        q = ST.observe_counters(s).writeStream.format("noop").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):  # progress arrives after the batch
            if listener.totals().get("frames_processed") == want["frames_processed"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert len(listener.batches) == 5 and listener.totals() == want
    kept = {r.counter: r.value for r in CT.read_counters(spark, stored).collect()}
    assert kept == {k: v for k, v in want.items() if k != "frames_without_detections"}
