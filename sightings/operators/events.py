"""Detection events (one per frame with at least one detection), their JSON form (K2/F9), the
reader for both event schema versions (S3) and the retained latest state (W8/K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from . import detections as D

DETECTION_TYPE = T.StructType([
    T.StructField("class", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("bbox", T.ArrayType(T.IntegerType())),
    T.StructField("species", T.StringType()),
    T.StructField("species_confidence", T.DoubleType()),
    T.StructField("crop_path", T.StringType()),
])

# Nested event (runtime publisher) and flat event (second schema version), read with one schema.
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("ts", T.StringType()),
    T.StructField("epoch_s", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("annotated_image_path", T.StringType()),
    T.StructField("annotated_image_url", T.StringType()),
    T.StructField("best_species", T.StringType()),
    T.StructField("best_species_conf", T.DoubleType()),
    T.StructField("detections", T.ArrayType(DETECTION_TYPE)),
    # flat version
    T.StructField("yolo_label", T.StringType()),
    T.StructField("yolo_conf", T.DoubleType()),
    T.StructField("species", T.StringType()),
    T.StructField("species_conf", T.DoubleType()),
    T.StructField("annotated_image", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def annotated_path(t: F.Column | str = "detected_at", root: str = "detections") -> F.Column:
    """``<root>/detection_<HHmmss_yyMMdd>.jpg``."""
    return F.concat(F.lit(f"{root}/detection_"), S.file_ts(t), F.lit(".jpg"))


def build_events(frames: DataFrame, dets: DataFrame, best: DataFrame | None = None,
                 base_url: F.Column | str | None = None, source_col: str = "source",
                 with_crop_path: bool = False) -> DataFrame:
    """One event row per frame with >= 1 detection: the event fields plus the nested detections.

    ``frames`` needs frame_id, source, epoch_s. ``best`` defaults to A3 over ``dets``.
    """
    if best is None:  # nested detections and A3 from one aggregation
        nested = D.nest_detections(dets, with_crop_path, with_best=True)
    else:
        nested = D.nest_detections(dets, with_crop_path).join(best, on="frame_id", how="left")
    return event_columns(nested.join(frames.select("frame_id", source_col, "epoch_s"), on="frame_id"), base_url, source_col)


def event_columns(nested: DataFrame, base_url: F.Column | str | None = None, source_col: str = "source") -> DataFrame:
    """The event fields of frames with nested detections, best species and time."""
    url = S.image_url(base_url if not isinstance(base_url, str) else F.lit(base_url)) if base_url is not None \
        else F.lit(None).cast("string")
    ev = nested.withColumn("detected_at", F.timestamp_seconds(F.col("epoch_s")))
    return ev.select(
        "frame_id",
        S.event_id("detected_at", "epoch_s").alias("event_id"),
        S.iso_utc("detected_at").alias("ts"),
        F.col("epoch_s").cast("double").alias("epoch_s"),
        F.col(source_col).alias("source"),
        annotated_path().alias("annotated_image_path"),
        url.alias("annotated_image_url"),
        F.col("best_species"),
        F.col("best_species_conf").cast("double").alias("best_species_conf"),
        F.col("detections"),
    )


EVENT_FIELDS = ["event_id", "ts", "epoch_s", "source", "annotated_image_path", "annotated_image_url",
                "best_species", "best_species_conf", "detections"]


def to_event_json(events: DataFrame) -> DataFrame:
    """K2 payload: compact JSON, nulls kept (F9). Adds ``value``."""
    return events.withColumn("value", S.event_json(F.struct(*[F.col(c) for c in EVENT_FIELDS])))


def read_events(df: DataFrame, json_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """S3: parse event JSON of both versions into one shape; malformed text goes to rejects.

    Returns ``(events, rejects)``; rejects keep the raw text and a reason.
    """
    # exploding an array of one keeps the optimizer from copying the parse into every use of its result
    parsed = df.select("*", F.explode(F.array(
        F.from_json(F.col(json_col), EVENT_SCHEMA,
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))).alias("_e"))
    bad = F.col("_e").isNull() | F.col("_e._corrupt_record").isNotNull() | F.col("_e.event_id").isNull()
    flat_det = F.array(F.struct(
        F.col("_e.yolo_label").alias("class"),
        F.col("_e.yolo_conf").alias("confidence"),
        F.lit(None).cast("array<int>").alias("bbox"),
        F.col("_e.species").alias("species"),
        F.col("_e.species_conf").alias("species_confidence"),
        F.lit(None).cast("string").alias("crop_path"),
    ))
    is_flat = F.col("_e.detections").isNull() & F.col("_e.yolo_label").isNotNull()
    events = parsed.where(~bad).select(
        F.col("_e.event_id").alias("event_id"),
        F.col("_e.ts").alias("ts"),
        F.col("_e.epoch_s").alias("epoch_s"),
        F.col("_e.source").alias("source"),
        F.coalesce("_e.annotated_image_path", "_e.annotated_image").alias("annotated_image_path"),
        F.col("_e.annotated_image_url").alias("annotated_image_url"),
        F.coalesce("_e.best_species", "_e.species").alias("best_species"),
        F.coalesce("_e.best_species_conf", "_e.species_conf").alias("best_species_conf"),
        F.when(is_flat, flat_det).otherwise(F.col("_e.detections")).alias("detections"),
        F.when(is_flat, F.lit(2)).otherwise(F.lit(1)).alias("schema_version"),
    )
    rejects = parsed.where(bad).select(
        F.col(json_col).alias("raw"),
        F.when(F.col("_e").isNull(), "null payload")
        .when(F.col("_e._corrupt_record").isNotNull(), "malformed json")
        .otherwise("missing event_id").alias("reason"),
    )
    return events, rejects


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key by ``order`` (last wins), via ``max_by``: each task sorts its rows by key and keeps the
    newest of each before the shuffle (whole rows don't fit a hash aggregate's buffer), so only winners travel.

    Returns the original columns.
    """
    cols = [c for c in df.columns]
    agg = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order])).alias("_l")
    )
    return agg.select("_l.*")
