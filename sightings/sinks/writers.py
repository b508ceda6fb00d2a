"""Sinks: sightings fact rows (K1), event messages (K2), retained latest state (K3), crops (K4),
annotated frames with retention (K5) and the class mapping document (K6).

Batch writes go through Spark's commit protocol (a failed task's files never become visible).
Stream writes use ``foreachBatch`` keyed by the batch id so a replayed batch replaces itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..operators import corpus as CO
from ..operators import events as EV
from ..operators import facts as FA
from ..operators import paths as PA
from ..session import checkpoint_dir


#: the columns of the fact table that a writer fills (fixed values: the table fills in its own id,
#: created_at and review columns)
INSERT_COLUMNS = (
    "detected_at", "image_path", "detector_model", "detector_label", "detector_confidence", "classifier_model",
    "classifier_label", "classifier_confidence", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "video_source",
)


def append_sightings(facts: DataFrame, path: str | None = None, *, jdbc: dict | None = None,
                     batch_id: int | None = None) -> DataFrame:
    """K1: write valid fact rows, return the rejects (P7) for logging. A bad row never blocks the
    others.

    The facts are computed once: they are written whole to the shared checkpoint folder, and both the
    valid rows and the rejects come from there. Parquet: partitioned by ``detected_date`` (and
    ``batch_id`` for stream batches, written with dynamic partition overwrite, so a replayed batch
    replaces itself). JDBC: batched appends of ``INSERT_COLUMNS``; with a ``batch_id`` a marker in the
    folder ``jdbc["batches"]`` makes a batch that was written before a no-op.
    """
    spark = facts.sparkSession
    scratch = f"{checkpoint_dir(spark)}/facts-{uuid.uuid4().hex}"
    facts.write.parquet(scratch)
    ok, rejects = FA.split_valid(spark.read.schema(facts.schema).parquet(scratch))
    if path is not None:
        w, parts, mode = ok.withColumn("detected_date", F.to_date("detected_at")), ["detected_date"], "append"
        if batch_id is not None:
            w = w.withColumn("batch_id", F.lit(int(batch_id)).cast("long"))
            parts.append("batch_id")
            mode = "overwrite"
        # rebalance: rows of one date land together (few files per date) while AQE splits a hot date
        (w.hint("rebalance", *parts).write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy(*parts).parquet(path))
    elif jdbc is not None:
        opts = dict(jdbc)
        batches = opts.pop("batches", None)
        opts["dbtable"] = S.safe_identifier(opts["dbtable"])
        done = f"{batches}/batch-{batch_id}" if batches and batch_id is not None else None
        if done is None or not _exists(spark, done):
            ok.select(*INSERT_COLUMNS).write.format("jdbc").options(**opts).option("batchsize", "1000").mode("append").save()
            if done is not None:
                _put(spark, done, "")
    return rejects


def sightings_batch_writer(path: str):
    """``foreachBatch`` function for a stream of fact rows (K1 in a stream)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_sightings(batch, path, batch_id=batch_id)

    return write


def write_events(events: DataFrame, path: str | None = None, *, kafka: dict | None = None,
                 batch_id: int | None = None) -> None:
    """K2: one compact JSON message per frame with >= 1 detection (``events`` come from
    ``build_events``, which only has such frames). Text files (one JSON per line) or Kafka. A stream
    gives its ``batch_id``: each batch has a folder of its own, so a replayed batch replaces its
    messages. (Kafka delivers at least once; ``dedupe_events`` drops what comes twice.)"""
    msgs = EV.to_event_json(events).select(F.col("event_id").alias("key"), "value")
    if kafka is not None:
        msgs.write.format("kafka").options(**kafka).save()
    elif batch_id is not None:
        msgs.select("value", F.lit(int(batch_id)).alias("batch_id")).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").text(path)
    else:
        msgs.select("value").write.mode("append").text(path)


def events_batch_writer(path: str):
    """``foreachBatch`` function for K2 in a stream."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_events(batch, path, batch_id=batch_id)

    return write


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _state_versions(spark: SparkSession, target: str) -> list[int]:
    """The complete versions of a retained state, oldest first: those whose write was committed."""
    return sorted(int(n.removeprefix("v-")) for n in _names(spark, target)
                  if n.startswith("v-") and _exists(spark, f"{target}/{n}/_SUCCESS"))


def read_state(spark: SparkSession, target: str) -> DataFrame | None:
    """Current retained state (K3) or None when nothing was published yet."""
    versions = _state_versions(spark, target)
    return spark.read.parquet(f"{target}/v-{versions[-1]:012d}") if versions else None


def upsert_state(events: DataFrame, target: str, key: str = "source", order: tuple[str, ...] = ("epoch_s", "event_id"),
                 keep_versions: int = 2) -> str:
    """K3: retained state - only the newest event per key survives (W8), merged with the current
    state. Every write is a new version; the highest one that was committed is the state. Nothing is
    swapped or overwritten, so a stop at any point leaves the state before or after it. One writer at
    a time; versions older than the last ``keep_versions`` go, for readers that began earlier."""
    spark = events.sparkSession
    versions = _state_versions(spark, target)
    cols = events.columns
    merged = events if not versions else events.unionByName(read_state(spark, target).select(*cols))
    name = f"v-{(versions[-1] if versions else 0) + 1:012d}"
    EV.latest_per_key(merged, [key], list(order)).write.mode("overwrite").parquet(f"{target}/{name}")
    for old in versions[:max(0, len(versions) + 1 - keep_versions)]:
        _delete(spark, f"{target}/v-{old:012d}")
    return name


def state_batch_writer(target: str, key: str = "source"):
    """``foreachBatch`` function for K3 in a stream: each micro-batch is merged into the retained
    state (newest per key wins, so a replayed batch leaves the same state)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_state(batch, target, key)

    return write


LEDGER_SCHEMA = ("safe_label string, ts string, crop_num bigint, frame_id bigint, det_idx int, crop_path string, day date, "
                 "batch_id bigint")


def crop_ledger(spark: SparkSession, root: str) -> DataFrame | None:
    """The names given to crops below ``root`` so far (``LEDGER_SCHEMA``), or None."""
    path = f"{root}.ledger"
    return spark.read.schema(LEDGER_SCHEMA).parquet(path) if _names(spark, path) else None


def write_crops(crops: DataFrame, root: str, existing: DataFrame | None = None, *, batch_id: int | None = None) -> DataFrame:
    """K4: crop images under ``<safe label>/`` with first-free collision numbering (W2), written as Parquet
    partitioned by ``safe_label`` (path, size, bytes); returns the path table (frame_id, det_idx, crop_path).

    With a ``batch_id`` (a stream) names go through a ledger beside the crops, partitioned by day and batch: a batch is
    numbered after the names of the batches before it on its days, and its names are written before its pixels.
    Names follow from the rows and the earlier batches alone and both writes replace their own partitions, so a
    replayed batch, or one that was stopped in between, ends as if it had run once. Without a ``batch_id`` rows are
    appended, numbered after ``existing``."""
    spark = crops.sparkSession
    pixels = [F.col("crop.height").alias("height"), F.col("crop.width").alias("width"), F.col("crop.data").alias("data")]
    if batch_id is None:
        named = PA.crop_paths(crops, root, existing)
        out = named.select("safe_label", "crop_path", "frame_id", "det_idx", *pixels)
        out.hint("rebalance", "safe_label").write.mode("append").partitionBy("safe_label").parquet(root)
        return named.select("frame_id", "det_idx", "crop_path")
    batch = F.lit(int(batch_id)).cast("long")
    narrow = crops.select("frame_id", "det_idx", "epoch_s", "species", "detector_label").withColumn(
        "day", F.to_date(F.timestamp_seconds("epoch_s")))
    ledger = crop_ledger(spark, root)
    if ledger is not None:
        earlier = ledger.where(F.col("batch_id") < batch).join(narrow.select("day").distinct(), "day", "left_semi")
        known = earlier.select(F.col("crop_path").alias("path"))
        existing = known if existing is None else existing.select("path").unionByName(known)
    written_to = f"{root}.ledger"
    (PA.crop_paths(narrow, root, existing).select("safe_label", "ts", "crop_num", "frame_id", "det_idx", "crop_path", "day", batch.alias("batch_id"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(written_to))
    made = crop_ledger(spark, root)
    if made is None:
        return narrow.select("frame_id", "det_idx", F.lit(None).cast("string").alias("crop_path")).limit(0)
    mine = made.where(F.col("batch_id") == batch).select("frame_id", "det_idx", "safe_label", "crop_path")
    (crops.select("frame_id", "det_idx", *pixels).join(mine, ["frame_id", "det_idx"]).withColumn("batch_id", batch)
     .hint("rebalance", "batch_id", "safe_label").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id", "safe_label").parquet(root))
    return mine.select("frame_id", "det_idx", "crop_path")


def write_latest(annotated: DataFrame, root: str) -> None:
    """The newest annotated frame of each source (``source, epoch_s, frame_id, data``) as a retained state (K3): what a
    dashboard shows. Only the rows that win among narrow ones bring their pixels."""
    newest = annotated.groupBy("source").agg(F.max(F.struct("epoch_s", "frame_id")).alias("m")).select(
        F.col("source").alias("_s"), F.col("m.frame_id").alias("_i"))
    rows = annotated.join(newest, F.col("source").eqNullSafe(F.col("_s")) & (F.col("frame_id") == F.col("_i")))
    upsert_state(rows.select("source", "epoch_s", "frame_id", F.col("annotated.data").alias("data")), root, order=("epoch_s", "frame_id"))


def write_annotated(annotated: DataFrame, root: str, keep: int = config.KEEP_LAST_ANNOTATED) -> DataFrame:
    """K5: annotated frames (``frame_id, source, epoch_s, annotated``); the newest ``keep`` per source
    survive (W3), those already below ``root`` included; returns the expired ``(source, path)``.

    Two frames of a source in the same second share a path: the later one replaces the earlier. Only
    narrow rows (source, path, time) are ranked, old and new together; pixels go straight from the
    frames to their files, one folder per path, and only expired folders are removed.
    """
    spark = annotated.sparkSession
    named = annotated.withColumn("path", EV.annotated_path(F.timestamp_seconds("epoch_s"), "detections")) \
        .withColumn("file", F.sha2(F.concat_ws("/", F.coalesce("source", F.lit("")), "path"), 256))
    narrow = named.groupBy("source", "path", "file").agg(F.max(F.struct("epoch_s", "frame_id")).alias("m")) \
        .select("source", "path", "file", "m.*")
    old = narrow.limit(0) if not _names(spark, root) else spark.read.schema(
        "source string, path string, epoch_s double, frame_id bigint, data binary, file string").parquet(root).select(*narrow.columns)
    both = old.join(narrow.select("file"), "file", "left_anti").select(*narrow.columns).withColumn("new", F.lit(False)) \
        .unionByName(narrow.withColumn("new", F.lit(True)))
    scratch = f"{checkpoint_dir(spark)}/retain-{uuid.uuid4().hex}"
    PA.ranked_files(both, ["source"], "epoch_s", "path", keep).write.parquet(scratch)
    ranked = spark.read.parquet(scratch)
    fresh = ranked.where(F.col("new") & F.col("kept")).select(F.col("file").alias("_f"), F.col("frame_id").alias("_i"))
    (named.join(fresh, (F.col("file") == F.col("_f")) & (F.col("frame_id") == F.col("_i")))
     .select("source", F.concat(F.lit(f"{root}/"), F.regexp_extract("path", "[^/]*$", 0)).alias("path"), "epoch_s", "frame_id",
             F.col("annotated.data").alias("data"), "file")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(root))
    expired = ranked.where(~F.col("kept"))
    for row in expired.where(~F.col("new")).select("file").toLocalIterator():  # one folder at a time
        _delete(spark, f"{root}/file={row['file']}")
    return expired.select("source", F.concat(F.lit(f"{root}/"), F.regexp_extract("path", "[^/]*$", 0)).alias("path"))


def write_class_mapping(index: DataFrame, path: str) -> None:
    """K6: the mapping document with both directions, one JSON text file."""
    CO.mapping_document(index).coalesce(1).write.mode("overwrite").text(path)
