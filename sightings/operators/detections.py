"""Per-frame detection operators: class filter join (J1/P2), confidence filter (P3), bbox truncation
(P4), crop window (P5), frames without detections (J3), best species (A3), nested detections (A4),
summary text (A5), display label (P8) and run counters (A8).

Everything groups by ``frame_id`` with partial aggregation before the shuffle, so a frame with very many boxes is
still combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..plans.sizes import sized_broadcast


def filter_classes(boxes: DataFrame, dim: DataFrame) -> DataFrame:
    """Inner equi join on ``cls_id``; unmatched ids are dropped, ``detector_label`` added.

    The class dimension is broadcast if it is as small as it should be: by Spark where it has statistics,
    else after counting it (``sized_broadcast``); otherwise Spark plans the join. So boxes are neither
    shuffled by class nor broadcast themselves.
    """
    d = sized_broadcast(dim.select("cls_id", F.col("class_name").alias("detector_label")))
    return boxes.join(d, on="cls_id", how="inner")


def filter_confidence(boxes: DataFrame, conf: float = config.DETECT_CONF) -> DataFrame:
    """Keep boxes with confidence strictly above the threshold (a Parquet-pushable predicate)."""
    return boxes.where(F.col("confidence") > F.lit(float(conf)))


def truncate_bbox(boxes: DataFrame) -> DataFrame:
    """Float corners -> INT toward zero, as ``bbox_x1..bbox_y2`` and the array ``bbox``."""
    out = boxes
    for c in ("x1", "y1", "x2", "y2"):
        out = out.withColumn(f"bbox_{c}", F.col(c).cast("int"))
    return out.withColumn("bbox", F.array("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"))


def crop_window(boxes: DataFrame, width, height, padding: int = config.DETECT_PADDING) -> DataFrame:
    """P5: padded crop clamped to the frame; the stored bbox stays unpadded.

    ``width``/``height`` are numbers or columns (per-frame sizes).
    """
    w = width if not isinstance(width, (int, float)) else F.lit(int(width))
    h = height if not isinstance(height, (int, float)) else F.lit(int(height))
    p = F.lit(int(padding))
    return (
        boxes.withColumn("crop_x1", F.greatest(F.lit(0), F.col("bbox_x1") - p))
        .withColumn("crop_y1", F.greatest(F.lit(0), F.col("bbox_y1") - p))
        .withColumn("crop_x2", F.least(w, F.col("bbox_x2") + p))
        .withColumn("crop_y2", F.least(h, F.col("bbox_y2") + p))
    )


def detections(boxes: DataFrame, dim: DataFrame, conf: float = config.DETECT_CONF) -> DataFrame:
    """The detector stage over a box table: P3 -> J1 -> P4 (kept boxes with labels and int bbox)."""
    return truncate_bbox(filter_classes(filter_confidence(boxes, conf), dim))


def frames_without_detections(frames: DataFrame, dets: DataFrame) -> DataFrame:
    """Frames with no kept detection ("no animals"); they emit no event, crop or fact row."""
    return frames.join(dets.select("frame_id").distinct(), on="frame_id", how="left_anti")


def frames_with_detections(frames: DataFrame, dets: DataFrame) -> DataFrame:
    """J3 complement as a semi join."""
    return frames.join(dets.select("frame_id"), on="frame_id", how="left_semi")


def best_candidate() -> F.Column:
    """A3 as an aggregate expression: ``max`` over candidate structs (conf, -det_idx, species).

    Candidates: truthy species, non-null and non-NaN confidence above -1.0; the first detection
    (lowest ``det_idx``) wins ties. Non-candidates contribute null, which ``max`` ignores, so the
    expression can share one aggregation with other per-frame aggregates.
    """
    c = F.col("species_confidence").cast("double")
    cand = S.truthy("species") & c.isNotNull() & ~F.isnan(c) & (c > F.lit(-1.0))
    return F.max(F.when(cand, F.struct(c.alias("conf"), (-F.col("det_idx")).alias("neg_idx"), F.col("species"))))


def best_species(dets: DataFrame) -> DataFrame:
    """A3: per frame the species with the highest species confidence (see ``best_candidate``).

    Frames without a candidate produce no row (their best is null). The maximum of a struct with a string
    runs as a sort-based aggregate, combined map-side; rows that come sorted by frame aren't sorted again.
    """
    best = dets.groupBy("frame_id").agg(best_candidate().alias("b")).where(F.col("b").isNotNull())
    return best.select(
        "frame_id",
        F.col("b.species").alias("best_species"),
        F.col("b.conf").alias("best_species_conf"),
    )


def nesting(with_crop_path: bool = False, with_best: bool = False) -> tuple[list[F.Column], list[F.Column]]:
    """A4 as aggregates of one frame's detections, and the columns to take from them: ``detections``, and with
    ``with_best`` A3's ``best_species`` and ``best_species_conf``."""
    crop = F.col("crop_path") if with_crop_path else F.lit(None).cast("string")
    item = F.struct(
        F.col("det_idx"),
        F.col("detector_label").alias("class"),
        F.col("confidence").cast("double").alias("confidence"),
        F.col("bbox"),
        F.col("species"),
        F.col("species_confidence").cast("double").alias("species_confidence"),
        crop.alias("crop_path"),
    )
    aggs = [F.sort_array(F.collect_list(item)).alias("_d")]
    cols = [F.transform(F.col("_d"), lambda d: d.dropFields("det_idx")).alias("detections")]
    if with_best:  # A3 in the same aggregation (one pass over the detections)
        aggs.append(best_candidate().alias("_b"))
        cols += [F.col("_b.species").alias("best_species"), F.col("_b.conf").alias("best_species_conf")]
    return aggs, cols


def nest_detections(dets: DataFrame, with_crop_path: bool = False, with_best: bool = False) -> DataFrame:
    """A4: one row per frame with ``detections`` = ordered ARRAY<STRUCT<class, confidence, bbox,
    species, species_confidence, crop_path>>.

    The array is per frame; its length is bounded by the detector's box limit per image.
    """
    aggs, cols = nesting(with_crop_path, with_best)
    return dets.groupBy("frame_id").agg(*aggs).select("frame_id", *cols)


def detection_summary(dets: DataFrame) -> DataFrame:
    """A5: ``class(0.91)->species(0.87), ...`` in detector order, species part only when truthy."""
    label = S.detection_label("detector_label", "confidence", "species", "species_confidence")
    per = dets.groupBy("frame_id").agg(
        F.sort_array(F.collect_list(F.struct("det_idx", label.alias("t")))).alias("_l")
    )
    return per.select("frame_id", F.array_join(F.transform("_l", lambda x: x["t"]), ", ").alias("summary"))


def with_display_label(dets: DataFrame) -> DataFrame:
    """Species if truthy else detector class."""
    return dets.withColumn("display_label", S.display_label("species", "detector_label"))


def run_counters(frames: DataFrame, dets: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Processed frames, frames with detections, frames without, failed attempts - one row.

    One global aggregate over a union of narrow rows (partial sums per task, one final row).
    """
    has = dets.select("frame_id").distinct().withColumn("_has", F.lit(1))
    f = frames.select("frame_id").join(has, on="frame_id", how="left").select(
        F.lit(1).alias("_f"), F.coalesce(F.col("_has"), F.lit(0)).alias("_d"), F.lit(0).alias("_x")
    )
    parts = f
    if attempts is not None:
        parts = parts.unionByName(
            attempts.select(F.lit(0).alias("_f"), F.lit(0).alias("_d"),
                            F.when(~F.col("ok"), 1).otherwise(0).alias("_x"))
        )
    out = parts.agg(
        F.sum("_f").cast("long").alias("frames_processed"),
        F.sum("_d").cast("long").alias("frames_with_detections"),
        F.sum("_x").cast("long").alias("failed_attempts"),
    ).withColumn("frames_without_detections", F.col("frames_processed") - F.col("frames_with_detections"))
    return out if attempts is not None else out.drop("failed_attempts")
