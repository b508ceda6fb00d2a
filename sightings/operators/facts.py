"""The sightings fact table: building rows (P6), NOT NULL split (P7), review queue (P9), time and
species lookups (P10), effective label (P11), stage latency (A6), species by time (A9) and label
agreement (A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..plans.ranges import ranked
from .events import annotated_path

FACT_COLUMNS = [
    "detected_at", "created_at", "image_path", "detector_model", "detector_label", "detector_confidence",
    "classifier_model", "classifier_label", "classifier_confidence", "bbox_x1", "bbox_y1", "bbox_x2",
    "bbox_y2", "video_source", "reviewed", "corrected_label",
]
KEY = ["source", "frame_id", "det_idx"]


def to_sightings(dets: DataFrame, frames: DataFrame, *, detector_model: str | None = config.DETECTOR_MODEL,
                 classifier_model: str | None = config.CLASSIFIER_MODEL, video_source: F.Column | None = None,
                 reviews: DataFrame | None = None) -> DataFrame:
    """One fact row per detection of a frame (stable key ``source, frame_id, det_idx``).

    Null-safe casts; a bbox that is missing or not of length 4 gives four nulls; classifier label
    ``''`` becomes null while detector label ``''`` is kept; confidences narrow to FLOAT.
    ``dets`` needs frame_id, det_idx, detector_label, confidence, bbox (array), species,
    species_confidence. ``frames`` needs frame_id, source, epoch_s.
    """
    f = frames.select("frame_id", "source", "epoch_s")
    j = dets.join(f, on="frame_id")
    if reviews is not None:
        j = j.join(reviews, on=["frame_id", "det_idx"], how="left")
    elif "reviewed" in dets.columns:  # review marks already carried by the detection rows
        j = j.withColumn("corrected_label", F.col("corrected_label").cast("string"))
    else:
        j = j.withColumn("reviewed", F.lit(False)).withColumn("corrected_label", F.lit(None).cast("string"))
    ok_bbox = F.coalesce(F.size("bbox") == 4, F.lit(False))
    bb = [F.when(ok_bbox, F.col("bbox")[i].cast("int")).alias(n)
          for i, n in enumerate(["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"])]
    detected = F.timestamp_seconds("epoch_s")
    return j.select(
        *KEY,
        detected.alias("detected_at"),
        F.current_timestamp().alias("created_at"),
        annotated_path(detected).alias("image_path"),
        F.lit(detector_model).cast("string").alias("detector_model"),
        F.col("detector_label").cast("string").alias("detector_label"),
        F.col("confidence").cast("float").alias("detector_confidence"),
        F.lit(classifier_model).cast("string").alias("classifier_model"),
        F.when(S.truthy("species"), F.col("species").cast("string")).alias("classifier_label"),
        F.col("species_confidence").cast("float").alias("classifier_confidence"),
        *bb,
        (video_source if video_source is not None else F.col("source")).alias("video_source"),
        F.coalesce(F.col("reviewed"), F.lit(False)).alias("reviewed"),
        F.col("corrected_label"),
    )



def split_valid(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows violating NOT NULL (detected_at, image_path) go to rejects with a reason; the other
    rows are written. Both sides filter one plan (cache it when writing both)."""
    reason = (
        F.when(F.col("detected_at").isNull(), F.lit("detected_at is null"))
        .when(F.col("image_path").isNull(), F.lit("image_path is null"))
    )
    tagged = facts.withColumn("reject_reason", reason)
    return tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"), tagged.where(
        F.col("reject_reason").isNotNull()
    )


def with_effective_label(facts: DataFrame) -> DataFrame:
    """Corrected, else classifier, else detector label."""
    return facts.withColumn("effective_label", S.effective_label("corrected_label", "classifier_label", "detector_label"))


def review_queue(facts: DataFrame, n: int | None = None) -> DataFrame:
    """All unreviewed rows, least confident first (rows without classifier confidence first), then
    the stable key. ``n`` asks for the first page only."""
    order = [F.col("classifier_confidence").asc_nulls_first(), *[F.col(k).asc() for k in KEY]]
    queue = facts.where(~F.col("reviewed")).orderBy(*order)
    return queue if n is None else queue.limit(n)


def review_positions(facts: DataFrame) -> DataFrame:
    """P9 with ``queue_pos`` (from 1) over all unreviewed rows: ranked in ranges of the order with sampled
    bounds (``plans.ranges``); the only thing in one task is one count a range."""
    order = [F.col("classifier_confidence").asc_nulls_first(), *[F.col(k).asc() for k in KEY]]
    place = ranked(facts.where(~F.col("reviewed")), order, "_r")
    return place.withColumn("queue_pos", F.col("_r") + 1).drop("_r")


def between(facts: DataFrame, t0: str, t1: str) -> DataFrame:
    """P10: half-open time range on detected_at; prunes date partitions of a written table."""
    lo, hi = F.to_timestamp(F.lit(t0)), F.to_timestamp(F.lit(t1))
    d0 = F.to_date(F.lit(t0))
    d1 = F.to_date(F.lit(t1))
    out = facts.where((F.col("detected_at") >= lo) & (F.col("detected_at") < hi))
    if "detected_date" in facts.columns:
        out = out.where((F.col("detected_date") >= d0) & (F.col("detected_date") <= d1))
    return out


def for_species(facts: DataFrame, label: str) -> DataFrame:
    """P10: rows whose classifier label equals ``label``."""
    return facts.where(F.col("classifier_label") == F.lit(label))


def stage_latency(frames: DataFrame, every: str = "1 hour", exact: bool = False) -> DataFrame:
    """Per source and time bucket: count, mean, p50, p95, max of grab/detect/classify ms.

    By default percentiles come from ``percentile_approx``, a sketch of fixed size per group (rank
    error 1/10000). ``exact`` uses ``percentile`` (linear interpolation), which holds a group's distinct
    values in one task.
    """
    t = F.timestamp_seconds("epoch_s")
    aggs = [F.count(F.lit(1)).alias("frames")]
    for stage in ("grab", "detect", "classify"):
        c = F.col(f"{stage}_ms")
        if exact:
            p50, p95 = F.percentile(c, F.lit(0.5)), F.percentile(c, F.lit(0.95))
        else:
            p50, p95 = F.percentile_approx(c, 0.5), F.percentile_approx(c, 0.95)
        aggs += [F.avg(c).alias(f"{stage}_mean"), p50.cast("double").alias(f"{stage}_p50"),
                 p95.cast("double").alias(f"{stage}_p95"), F.max(c).alias(f"{stage}_max")]
    g = frames.groupBy("source", F.window(t, every).start.alias("_bucket")).agg(*aggs)
    return g.withColumn("bucket", F.date_format("_bucket", "yyyy-MM-dd HH:mm")).drop("_bucket")


LATENCY_STAGES = ("grab", "detect", "classify")


def latency_sketches(frames: DataFrame, every: str = "1 hour", k: int = config.LATENCY_SKETCH_K) -> DataFrame:
    """A6 in a form that can be stored and merged: per source and ``bucket`` (its start) the number of frames, and per
    stage count, sum, maximum and a KLL sketch of the times. A sketch has a bounded size whatever it has seen, and
    is combined map-side."""
    aggs = [F.count(F.lit(1)).alias("frames")]
    for stage in LATENCY_STAGES:
        c = F.col(f"{stage}_ms").cast("double")
        aggs += [F.count(c).alias(f"{stage}_n"), F.sum(c).alias(f"{stage}_sum"), F.max(c).alias(f"{stage}_max"),
                 F.kll_sketch_agg_double(c, F.lit(int(k))).alias(f"{stage}_sketch")]
    bucket = F.window(F.timestamp_seconds("epoch_s"), every).start
    return frames.where(F.col("epoch_s").isNotNull()).groupBy("source", bucket.alias("bucket")).agg(*aggs)


def merge_latency(sketches: DataFrame, unit: str) -> DataFrame:
    """Rows of ``latency_sketches`` merged to longer buckets (``day``, ``month``, ...), of the same shape: days come from
    stored hours, without the frames."""
    aggs = [F.sum("frames").alias("frames")]
    for stage in LATENCY_STAGES:
        aggs += [F.sum(f"{stage}_n").alias(f"{stage}_n"), F.sum(f"{stage}_sum").alias(f"{stage}_sum"),
                 F.max(f"{stage}_max").alias(f"{stage}_max"), F.kll_merge_agg_double(f"{stage}_sketch").alias(f"{stage}_sketch")]
    return sketches.groupBy("source", F.date_trunc(unit, "bucket").alias("bucket")).agg(*aggs)


def latency_quantiles(sketches: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Count, mean, maximum and quantiles (``<stage>_p50`` ...) of ``latency_sketches`` or ``merge_latency``; null for a
    stage without times."""
    cols = ["source", "bucket", "frames"]
    for stage in LATENCY_STAGES:
        some = F.col(f"{stage}_n") > 0
        cols += [F.try_divide(f"{stage}_sum", f"{stage}_n").alias(f"{stage}_mean"), F.col(f"{stage}_max")]
        cols += [F.when(some, F.kll_sketch_get_quantile_double(f"{stage}_sketch", F.lit(p))).alias(f"{stage}_p{round(p * 100)}") for p in shares]
    return sketches.select(*cols)


def species_by_time(facts: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """Per effective label and hour, with roll-ups to label+day, label and grand total:
    sightings, distinct frames, mean and max confidence (classifier, else detector).

    Rows collapse to (label, hour, frame) once. A frame has one time, so the frames of a day or a label
    are the sum over its hours, and the roll-up runs on the few hourly rows; only the grand total counts
    frames anew, as a frame may show several labels. ``exact_distinct`` off replaces that collapse by a
    sketch per group (relative error 5 %)."""
    f = with_effective_label(facts).select(
        F.col("effective_label").alias("label"),
        F.date_format("detected_at", "yyyy-MM-dd").alias("day"),
        F.hour("detected_at").alias("hour"),
        F.struct("source", "frame_id").alias("frame"),
        F.coalesce("classifier_confidence", "detector_confidence").cast("double").alias("conf"),
    )
    sums = [F.count(F.lit(1)).alias("n"), F.sum("conf").alias("s"), F.count("conf").alias("k"), F.max("conf").alias("m")]
    again = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("k").alias("k"), F.max("m").alias("m")]
    if exact_distinct:
        seen = f.groupBy("label", "day", "hour", "frame").agg(*sums)
        hourly = seen.groupBy("label", "day", "hour").agg(*again, F.count(F.lit(1)).alias("f"))
        total = seen.groupBy("frame").agg(*again).agg(*again, F.count(F.lit(1)).alias("f"))
    else:
        hourly = f.groupBy("label", "day", "hour").agg(*sums, F.approx_count_distinct("frame").alias("f"))
        total = f.agg(*sums, F.approx_count_distinct("frame").alias("f"))
    up = hourly.rollup("label", "day", "hour").agg(*again, F.sum("f").alias("f"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "hour").when(F.col("g") == 1, "day").when(F.col("g") == 3, "label")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("day", "string"), ("hour", "int"))]
    both = up.where("g < 7").select("label", "day", "hour", "n", "s", "k", "m", "f", level.alias("level")).unionByName(
        total.where("n > 0").select(*none, "n", "s", "k", "m", "f", F.lit("total").alias("level")))
    return both.select("label", "day", "hour", F.col("n").alias("sightings"), F.col("f").alias("frames"),
                       F.try_divide("s", "k").alias("mean_conf"), F.col("m").alias("max_conf"), "level")


def label_agreement(facts: DataFrame) -> DataFrame:
    """A10: reviewed rows, predicted x corrected counts plus per predicted class accuracy (%).

    predicted = classifier label, else detector label; corrected = corrected label, else predicted
    (a review without a correction confirms). Aggregates first; the class totals join is on the
    small aggregated table.
    """
    r = facts.where(F.col("reviewed")).select(
        F.coalesce("classifier_label", "detector_label").alias("predicted_label"),
        F.coalesce("corrected_label", "classifier_label", "detector_label").alias("corrected_label"),
    )
    pair = r.groupBy("predicted_label", "corrected_label").agg(F.count(F.lit(1)).alias("n"))
    # class totals over the aggregated pairs (one row per label pair): one lineage, no second scan
    w = Window.partitionBy("predicted_label")
    hit = F.when(F.col("predicted_label") == F.col("corrected_label"), F.col("n")).otherwise(F.lit(0))
    return pair.withColumn("class_total", F.sum("n").over(w)).withColumn(
        "class_accuracy", F.lit(100.0) * F.sum(hit).over(w) / F.col("class_total"))
