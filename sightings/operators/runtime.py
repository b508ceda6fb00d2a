"""The runtime job: frames to detections, crops, events, state, facts, annotated frames and alerts.

``run_batch`` takes frames as S1 or S6 read them, decodes them and runs the models once (M8, which also crops and
draws) and feeds every sink from what that pass wrote. ``run_stream`` calls it for each micro-batch. A replayed batch
replaces its own output in every sink. Alerts follow the best species of all frames so far: ``write_alerts`` over the
table of best species, ``run_alerts`` as a stream behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..sinks import writers as W
from ..streaming import ordered as OR
from ..streaming.streams import BEST_SCHEMA, capture_trigger, stream_table
from . import alerts as AL
from . import events as EV
from . import facts as FA
from . import inference as INF

COUNTERS = ("frames", "corrupt", "with_detections", "undecodable")


def run_batch(frames: DataFrame, dim: DataFrame, out: str, detector: Callable[[], Callable], detector_key: str,
              classifier: Callable[[], Callable] | None = None, classifier_key: str | None = None,
              class_map: DataFrame | None = None, batch_id: int = 0, conf: float = config.DETECT_CONF,
              padding: int = config.DETECT_PADDING, size: int = config.INPUT_SIZE,
              keep: int = config.KEEP_LAST_ANNOTATED, base_url: str | None = None) -> dict[str, int]:
    """One batch of frames (the columns of ``scan_frames``) into the sinks below ``out``: ``crops`` (K4), ``events``
    (K2), ``state`` (K3), ``sightings`` (K1), ``annotated`` (K5), ``latest`` (the newest annotated frame), ``frames``
    (timings of every frame, A6's input), ``best`` (best species of each frame, the input of alerts), ``counters`` (A8)
    and ``rejects`` (undecodable and corrupt frames, model errors, facts without a required column).
    Returns the run's counters."""
    frames = frames.withColumnRenamed("reason", "unreadable")
    dets, best, seen = INF.run_two_stage(frames, dim, detector, detector_key, classifier, classifier_key, class_map, conf, padding, size,
                                         keep_crops=True, draw=True, carry=["source", "epoch_s", "grab_ms", "unreadable"])
    table = seen.where("unreadable is null").drop("annotated", "unreadable")
    times = table.select("frame_id", "source", "epoch_s", "grab_ms")
    _batch(table, f"{out}/frames", batch_id)
    paths = W.write_crops(dets.join(times.select("frame_id", "epoch_s"), "frame_id"), f"{out}/crops", batch_id=batch_id)
    dets = dets.drop("crop").join(paths, ["frame_id", "det_idx"], "left")
    events = EV.build_events(times, dets, base_url=base_url, with_crop_path=True)
    W.write_events(events, f"{out}/events", batch_id=batch_id)
    W.upsert_state(events.select("source", "event_id", "epoch_s", "best_species", "best_species_conf"), f"{out}/state")
    _batch(best.join(times.select("frame_id", "source", "epoch_s"), "frame_id"), f"{out}/best", batch_id)
    bad_facts = W.append_sightings(FA.to_sightings(dets, times), f"{out}/sightings", batch_id=batch_id)
    drawn = seen.where("annotated is not null").select("frame_id", "source", "epoch_s", "annotated")
    W.write_annotated(drawn, f"{out}/annotated", keep)
    W.write_latest(drawn, f"{out}/latest")

    def reject(df: DataFrame, reason) -> DataFrame:
        return df.select("frame_id", "source", "epoch_s", reason.alias("reason"))

    rejects = (reject(seen.where("unreadable is not null"), F.col("unreadable"))
               .unionByName(reject(table.where("is_corrupt"), F.col("reason")))
               .unionByName(reject(table.where("error is not null"), F.col("error")))
               .unionByName(reject(dets.where("error is not null").join(times, "frame_id"), F.col("error")))
               .unionByName(reject(bad_facts.withColumn("epoch_s", F.lit(None).cast("double")), F.lit("incomplete fact row"))))
    _batch(rejects, f"{out}/rejects", batch_id)
    read = F.col("unreadable").isNull()
    total = [F.count_if(read), F.count_if(read & F.col("is_corrupt")), F.count_if(F.col("detections") > 0), F.count_if(~read)]
    counts = seen.agg(*[c.alias(n) for c, n in zip(total, COUNTERS)])
    _batch(counts, f"{out}/counters", batch_id)
    return counts.first().asDict()


def _batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(int(batch_id)).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def run_counters(spark: SparkSession, out: str) -> dict[str, int]:
    """The counters of all batches below ``out``."""
    return spark.read.parquet(f"{out}/counters").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]).first().asDict()


def run_stream(frames: DataFrame, dim: DataFrame, out: str, checkpoint: str, detector: Callable[[], Callable],
               detector_key: str, trigger: dict | None = None, **options):
    """A started query over a stream of frames (``stream_frames``): ``run_batch`` per micro-batch, one per
    capture interval unless ``trigger`` says otherwise."""
    def batch(df: DataFrame, batch_id: int) -> None:
        run_batch(df, dim, out, detector, detector_key, batch_id=batch_id, **options)

    return (frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or capture_trigger())).start())


def write_alerts(spark: SparkSession, out: str, **rules) -> DataFrame:
    """W6 over all best species below ``out``, written to ``alerts``: the announcements to speak or play."""
    said = AL.announce(spark.read.parquet(f"{out}/best").drop("batch_id"), **rules).where("speak or play_song")
    said.write.mode("overwrite").parquet(f"{out}/alerts")
    return spark.read.parquet(f"{out}/alerts")


def run_alerts(spark: SparkSession, out: str, checkpoint: str, watermark: str = "30 seconds", trigger: dict | None = None, **rules):
    """A started query that reads the best species as ``run_stream`` writes them and appends announcements to ``alerts``
    (T3 in event order; the session must use the RocksDB state store)."""
    best = stream_table(spark, f"{out}/best", BEST_SCHEMA)
    said = OR.announce_in_order(best, watermark, **rules).where("speak or play_song")
    return (said.writeStream.format("parquet").option("path", f"{out}/alerts").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or capture_trigger())).start())
