"""Registered queries: one per O-checked operator of the survey.

Each entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with DuckDB SQL over the same
driver tables. Column names and types agree between the two. All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..operators import alerts as AL
from ..operators import corpus as CO
from ..operators import detections as D
from ..operators import events as EV
from ..operators import facts as FA
from ..operators import images as IM
from ..operators import inference as INF
from ..operators import paths as PA
from ..operators import training as TR
from ..operators import vectors as VE
from ..sources import fixtures as X
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


# ---- shared building blocks --------------------------------------------------------------

def kept_detections(spark: SparkSession, sf_dir: str, conf: float = config.DETECT_CONF) -> DataFrame:
    """boxes -> P3 -> J1 -> P4."""
    return D.detections(X.boxes(spark, sf_dir), X.class_dim(spark), conf)


# DuckDB: the same kept detections. CAST(double AS INT) rounds in DuckDB, so truncate first.
DETS_SQL = """, dets AS (
SELECT b.frame_id, b.det_idx, b.cls_id, c.class_name AS detector_label, b.confidence,
       b.x1, b.y1, b.x2, b.y2, b.species, b.species_confidence,
       CAST(trunc(b.x1) AS INTEGER) AS bbox_x1, CAST(trunc(b.y1) AS INTEGER) AS bbox_y1,
       CAST(trunc(b.x2) AS INTEGER) AS bbox_x2, CAST(trunc(b.y2) AS INTEGER) AS bbox_y2
FROM boxes b JOIN class_dim c ON b.cls_id = c.cls_id
WHERE b.confidence > 0.25
)
"""


def with_dets(*extra: str, recursive: bool = False) -> str:
    return X.with_views("boxes", "class_dim", *extra, recursive=recursive) + DETS_SQL


BEST_SQL = """, best AS (
SELECT frame_id, best_species, best_species_conf FROM (
  SELECT frame_id, species AS best_species, CAST(species_confidence AS DOUBLE) AS best_species_conf,
         row_number() OVER (PARTITION BY frame_id ORDER BY species_confidence DESC, det_idx) AS rn
  FROM dets
  WHERE species IS NOT NULL AND species <> '' AND species_confidence IS NOT NULL
    AND NOT isnan(species_confidence) AND species_confidence > -1.0) t
WHERE rn = 1)
"""


# ---- J1 / P2 ---------------------------------------------------------------------------------

@register(
    "class_filter_join",
    X.with_views("boxes", "class_dim")
    + """SELECT b.frame_id, b.det_idx, b.cls_id, c.class_name AS detector_label, b.confidence
FROM boxes b JOIN class_dim c ON b.cls_id = c.cls_id""",
)
def q_class_filter_join(spark, sf_dir):
    j = D.filter_classes(X.boxes(spark, sf_dir), X.class_dim(spark))
    return j.select("frame_id", "det_idx", "cls_id", "detector_label", "confidence")


# ---- P3 / P4 / P5 --------------------------------------------------------------------------

@register(
    "crop_window",
    with_dets()
    + """SELECT frame_id, det_idx, bbox_x1, bbox_y1, bbox_x2, bbox_y2,
       greatest(0, bbox_x1 - 100) AS crop_x1, greatest(0, bbox_y1 - 100) AS crop_y1,
       least(1920, bbox_x2 + 100) AS crop_x2, least(1080, bbox_y2 + 100) AS crop_y2
FROM dets""",
)
def q_crop_window(spark, sf_dir):
    d = D.crop_window(kept_detections(spark, sf_dir), config.FRAME_W, config.FRAME_H)
    return d.select("frame_id", "det_idx", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2",
                    "crop_x1", "crop_y1", "crop_x2", "crop_y2")


# ---- J3 ----------------------------------------------------------------------------------------

@register(
    "no_animal_frames",
    with_dets("frames")
    + """SELECT f.frame_id, f.source FROM frames f
WHERE NOT EXISTS (SELECT 1 FROM dets d WHERE d.frame_id = f.frame_id)""",
)
def q_no_animal_frames(spark, sf_dir):
    f = X.frames(spark, sf_dir)
    return D.frames_without_detections(f, kept_detections(spark, sf_dir)).select("frame_id", "source")


# ---- A3 ----------------------------------------------------------------------------------------

@register("best_species", with_dets() + BEST_SQL + "SELECT frame_id, best_species, best_species_conf FROM best")
def q_best_species(spark, sf_dir):
    return D.best_species(kept_detections(spark, sf_dir))


# ---- flagship (entry): A3 per species and day ----------------------------------------------

DAY_SQL = "strftime(make_timestamp(CAST(epoch_s * 1000000 AS BIGINT)), '%Y-%m-%d')"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = D.best_species(kept_detections(spark, sf_dir))
    f = X.frames(spark, sf_dir).select("frame_id", "epoch_s")
    day = F.date_format(F.timestamp_seconds("epoch_s"), "yyyy-MM-dd")
    return (
        best.join(f, on="frame_id")
        .groupBy(F.col("best_species").alias("species"), day.alias("day"))
        .agg(F.count(F.lit(1)).alias("frames"), F.avg("best_species_conf").alias("mean_conf"))
    )


register(
    "species_daily",
    with_dets("frames") + BEST_SQL
    + f"""SELECT b.best_species AS species, {DAY_SQL} AS day, count(*) AS frames,
       avg(b.best_species_conf) AS mean_conf
FROM best b JOIN frames f ON f.frame_id = b.frame_id
GROUP BY 1, 2""",
)(flagship)


# ---- events: A4, A5, F-functions, K2/S3, W8/K3 --------------------------------------------


TS_SQL = "make_timestamp(CAST(epoch_s * 1000000 AS BIGINT))"
FILE_TS_SQL = f"strftime({TS_SQL}, '%H%M%S_%y%m%d')"
F6_SQL = "printf('%.2f', {x})"


def frames_with_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 best per frame joined to the frame's source and time."""
    best = D.best_species(kept_detections(spark, sf_dir))
    return best.join(X.frames(spark, sf_dir).select("frame_id", "source", "epoch_s"), on="frame_id")


BESTF_SQL = BEST_SQL + """, bestf AS (
SELECT b.frame_id, f.source, f.epoch_s, b.best_species, b.best_species_conf
FROM best b JOIN frames f ON f.frame_id = b.frame_id)
"""

DET_TEXT_SQL = (
    "concat_ws(':', detector_label, printf('%.2f', confidence), CAST(bbox_x1 AS VARCHAR), CAST(bbox_y1 AS VARCHAR), "
    "CAST(bbox_x2 AS VARCHAR), CAST(bbox_y2 AS VARCHAR), coalesce(species, '~'), "
    "coalesce(printf('%.2f', species_confidence), '~'))"
)


@register(
    "nest_detections",
    with_dets()
    + f"""SELECT frame_id, count(*) AS n_dets,
       string_agg({DET_TEXT_SQL}, '|' ORDER BY det_idx) AS dets_text,
       sum(CAST(confidence AS DOUBLE)) AS sum_conf
FROM dets GROUP BY frame_id""",
)
def q_nest_detections(spark, sf_dir):
    n = D.nest_detections(kept_detections(spark, sf_dir))

    def text(d):
        return F.concat_ws(
            ":", d["class"], S.fixed2(d["confidence"]), *[d["bbox"][i].cast("string") for i in range(4)],
            F.coalesce(d["species"], F.lit("~")), F.coalesce(S.fixed2(d["species_confidence"]), F.lit("~")),
        )

    return n.select(
        "frame_id",
        F.size("detections").cast("long").alias("n_dets"),
        F.array_join(F.transform("detections", text), "|").alias("dets_text"),
        F.aggregate("detections", F.lit(0.0), lambda acc, d: acc + d["confidence"]).alias("sum_conf"),
    )


@register(
    "detection_summary",
    with_dets()
    + """SELECT frame_id, string_agg(
    CASE WHEN species IS NOT NULL AND species <> ''
         THEN detector_label || '(' || printf('%.2f', confidence) || ')->' || species || '(' || printf('%.2f', species_confidence) || ')'
         ELSE detector_label || '(' || printf('%.2f', confidence) || ')' END, ', ' ORDER BY det_idx) AS summary
FROM dets GROUP BY frame_id""",
)
def q_detection_summary(spark, sf_dir):
    return D.detection_summary(kept_detections(spark, sf_dir))


EVENT_BASE = "concat('  http://', source, '.local:8765//  ')"


@register(
    "event_fields",
    with_dets("frames") + BEST_SQL
    + f"""SELECT f.frame_id,
       {FILE_TS_SQL} || '-' || CAST(CAST(trunc(f.epoch_s * 1000) AS BIGINT) AS VARCHAR) AS event_id,
       strftime({TS_SQL}, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN f.epoch_s = floor(f.epoch_s) THEN '' ELSE strftime({TS_SQL}, '.%f') END || '+00:00' AS ts,
       {FILE_TS_SQL} AS file_ts,
       'detections/detection_' || {FILE_TS_SQL} || '.jpg' AS annotated_image_path,
       'http://' || f.source || '.local:8765/latest.jpg' AS annotated_image_url,
       'frame_' || strftime({TS_SQL}, '%Y%m%d_%H%M%S') || '.jpg' AS frame_name,
       trim(replace(b.best_species, '_', ' ')) AS spoken_text
FROM frames f LEFT JOIN best b ON b.frame_id = f.frame_id
WHERE EXISTS (SELECT 1 FROM dets d WHERE d.frame_id = f.frame_id)""",
)
def q_event_fields(spark, sf_dir):
    dets = kept_detections(spark, sf_dir)
    fr = X.frames(spark, sf_dir)
    ev = EV.build_events(fr, dets, base_url=F.expr(EVENT_BASE))
    t = F.timestamp_seconds("epoch_s")
    return ev.select(
        "frame_id", "event_id", "ts", S.file_ts(t).alias("file_ts"), "annotated_image_path",
        "annotated_image_url", S.default_frame_name(t).alias("frame_name"),
        S.spoken_text("best_species").alias("spoken_text"),
    )


@register(
    "event_roundtrip",
    with_dets("frames") + BEST_SQL
    + f"""SELECT {FILE_TS_SQL} || '-' || CAST(CAST(trunc(f.epoch_s * 1000) AS BIGINT) AS VARCHAR) AS event_id,
       f.epoch_s, f.source, b.best_species, b.best_species_conf,
       d.n_dets, d.first_bbox_x1, d.sum_conf, d.n_species, 1 AS schema_version
FROM frames f
JOIN (SELECT frame_id, count(*) AS n_dets, arg_min(bbox_x1, det_idx) AS first_bbox_x1,
             sum(CAST(confidence AS DOUBLE)) AS sum_conf, count(species) AS n_species
      FROM dets GROUP BY frame_id) d ON d.frame_id = f.frame_id
LEFT JOIN best b ON b.frame_id = f.frame_id""",
)
def q_event_roundtrip(spark, sf_dir):
    ev = EV.build_events(X.frames(spark, sf_dir), kept_detections(spark, sf_dir))
    parsed, _rejects = EV.read_events(EV.to_event_json(ev).select("value"))
    return parsed.select(
        "event_id", "epoch_s", "source", "best_species", "best_species_conf",
        F.size("detections").cast("long").alias("n_dets"),
        F.col("detections")[0]["bbox"][0].alias("first_bbox_x1"),
        F.aggregate("detections", F.lit(0.0), lambda acc, d: acc + d["confidence"]).alias("sum_conf"),
        F.size(F.filter("detections", lambda d: d["species"].isNotNull())).cast("long").alias("n_species"),
        "schema_version",
    )


@register(
    "latest_state",
    with_dets("frames") + BEST_SQL
    + f"""SELECT source, event_id, epoch_s, best_species FROM (
  SELECT f.source, {FILE_TS_SQL} || '-' || CAST(CAST(trunc(f.epoch_s * 1000) AS BIGINT) AS VARCHAR) AS event_id,
         f.epoch_s, b.best_species,
         row_number() OVER (PARTITION BY f.source ORDER BY f.epoch_s DESC, f.frame_id DESC) AS rn
  FROM frames f LEFT JOIN best b ON b.frame_id = f.frame_id
  WHERE EXISTS (SELECT 1 FROM dets d WHERE d.frame_id = f.frame_id)) t
WHERE rn = 1""",
)
def q_latest_state(spark, sf_dir):
    ev = EV.build_events(X.frames(spark, sf_dir), kept_detections(spark, sf_dir))
    latest = EV.latest_per_key(ev.select("frame_id", "source", "event_id", "epoch_s", "best_species"),
                               ["source"], ["epoch_s", "frame_id"])
    return latest.select("source", "event_id", "epoch_s", "best_species")


# ---- W2 / W3 --------------------------------------------------------------------------------

@register(
    "crop_paths",
    with_dets("frames")
    + f"""SELECT frame_id, det_idx, safe_label, ts,
       'crops/' || safe_label || '/' || ts
         || CASE WHEN n = 0 THEN '' ELSE '_' || CAST(n AS VARCHAR) END || '.jpg' AS crop_path
FROM (SELECT *, row_number() OVER (PARTITION BY safe_label, ts ORDER BY epoch_s, frame_id, det_idx) - 1 AS n
      FROM (SELECT d.frame_id, d.det_idx, f.epoch_s, {FILE_TS_SQL} AS ts,
                   regexp_replace(coalesce(nullif(d.species, ''), d.detector_label),
                                  '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') AS safe_label
            FROM dets d JOIN frames f ON f.frame_id = d.frame_id) x) y""",
)
def q_crop_paths(spark, sf_dir):
    d = kept_detections(spark, sf_dir).join(X.frames(spark, sf_dir).select("frame_id", "epoch_s"), on="frame_id")
    return PA.crop_paths(d).select("frame_id", "det_idx", "safe_label", "ts", "crop_path")


@register(
    "retain_last_n",
    with_dets("frames")
    + f"""SELECT source, path, rank FROM (
  SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY epoch_s DESC, path DESC) - 1 AS rank
  FROM (SELECT DISTINCT f.source, f.epoch_s, 'detections/detection_' || {FILE_TS_SQL} || '.jpg' AS path
        FROM frames f WHERE EXISTS (SELECT 1 FROM dets d WHERE d.frame_id = f.frame_id)) a) t
WHERE rank < 10""",
)
def q_retain_last_n(spark, sf_dir):
    ev = EV.build_events(X.frames(spark, sf_dir), kept_detections(spark, sf_dir))
    files = ev.select("source", "epoch_s", F.col("annotated_image_path").alias("path")).distinct()
    kept, _expired = PA.retain_last_n(files, ["source"], "epoch_s", "path", 10)
    return kept.select("source", "path", "rank")


# ---- W4 / W5 / W6 / W9 / T1 / T2 ---------------------------------------------------------

ALERT_MIN_CONF = 0.5  # FIXTURES.md anchors for W5/W6
VISIT_GAP_S = 30.0
CONFLATE_SLOT_S = 10.0


@register(
    "failure_runs",
    X.with_views("attempts", recursive=True)
    + """, att AS (SELECT attempt_id, source, epoch(ts) AS t, ok FROM attempts),
isl AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END)
          OVER (PARTITION BY source ORDER BY t, attempt_id ROWS UNBOUNDED PRECEDING) AS island FROM att),
fails AS (SELECT attempt_id, source, t, island,
                 row_number() OVER (PARTITION BY source, island ORDER BY t, attempt_id) AS fail_n
          FROM isl WHERE NOT ok),
walk AS (
  SELECT attempt_id, source, island, fail_n, t, t AS last_log, true AS logged FROM fails WHERE fail_n = 1
  UNION ALL
  SELECT f.attempt_id, f.source, f.island, f.fail_n, f.t,
         CASE WHEN f.t - w.last_log > 5 THEN f.t ELSE w.last_log END,
         f.t - w.last_log > 5
  FROM walk w JOIN fails f ON f.source = w.source AND f.island = w.island AND f.fail_n = w.fail_n + 1)
SELECT attempt_id, source, CAST(fail_n AS BIGINT) AS fail_n,
       least(CAST(0.2 AS DOUBLE) * fail_n, CAST(5.0 AS DOUBLE)) AS backoff_s, logged
FROM walk""",
)
def q_failure_runs(spark, sf_dir):
    r = AL.failure_runs(X.attempts(spark, sf_dir))
    return r.select("attempt_id", "source", "fail_n", "backoff_s", "logged")


CHG_SQL = f""", ann AS (SELECT * FROM bestf WHERE best_species_conf >= {ALERT_MIN_CONF}),
chg AS (SELECT *, coalesce(lag(best_species) OVER (PARTITION BY source ORDER BY epoch_s, frame_id) <> best_species,
                           true) AS changed FROM ann)
"""


@register(
    "species_changes",
    with_dets("frames") + BESTF_SQL + CHG_SQL
    + "SELECT frame_id, source, epoch_s, best_species, changed FROM chg",
)
def q_species_changes(spark, sf_dir):
    c = AL.species_changes(frames_with_best(spark, sf_dir), ALERT_MIN_CONF)
    return c.select("frame_id", "source", "epoch_s", "best_species", "changed")


@register(
    "announce",
    with_dets("frames", recursive=True) + BESTF_SQL + CHG_SQL
    + """, runs AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END)
          OVER (PARTITION BY source ORDER BY epoch_s, frame_id ROWS UNBOUNDED PRECEDING) AS run_id FROM chg),
sp AS (SELECT *, row_number() OVER (PARTITION BY source, run_id ORDER BY epoch_s, frame_id) AS rn,
              row_number() OVER (PARTITION BY source, best_species ORDER BY epoch_s, frame_id) AS rs FROM runs),
speak_walk AS (
  SELECT source, run_id, rn, frame_id, epoch_s AS last_t, true AS speak FROM sp WHERE rn = 1
  UNION ALL
  SELECT s.source, s.run_id, s.rn, s.frame_id,
         CASE WHEN s.epoch_s - w.last_t >= 60 THEN s.epoch_s ELSE w.last_t END,
         s.epoch_s - w.last_t >= 60
  FROM speak_walk w JOIN sp s ON s.source = w.source AND s.run_id = w.run_id AND s.rn = w.rn + 1),
song_walk AS (
  SELECT source, best_species, rs, frame_id, epoch_s AS last_t, true AS play_song FROM sp WHERE rs = 1
  UNION ALL
  SELECT s.source, s.best_species, s.rs, s.frame_id,
         CASE WHEN s.epoch_s - w.last_t >= 10 THEN s.epoch_s ELSE w.last_t END,
         s.epoch_s - w.last_t >= 10
  FROM song_walk w JOIN sp s ON s.source = w.source AND s.best_species = w.best_species AND s.rs = w.rs + 1)
SELECT sp.frame_id, sp.source, sp.epoch_s, sp.best_species, sp.changed, a.speak, b.play_song,
       trim(replace(sp.best_species, '_', ' ')) AS spoken_text
FROM sp JOIN speak_walk a ON a.frame_id = sp.frame_id JOIN song_walk b ON b.frame_id = sp.frame_id""",
)
def q_announce(spark, sf_dir):
    a = AL.announce(frames_with_best(spark, sf_dir), ALERT_MIN_CONF)
    return a.select("frame_id", "source", "epoch_s", "best_species", "changed", "speak", "play_song", "spoken_text")


def _no_source_no_time(df: DataFrame, key: str, time: str) -> DataFrame:
    """The ordered rows with one camera's source missing, and every 50th row's time."""
    return df.withColumns({"source": F.when(F.col("source") != "cam_0", F.col("source")),
                           time: F.when(F.col(key) % 50 != 0, F.col(time))})


@register(
    "failure_runs_null_source",
    X.with_views("attempts", recursive=True)
    + """, att AS (SELECT attempt_id, nullif(source, 'cam_0') AS source,
                          CASE WHEN attempt_id % 50 <> 0 THEN epoch(ts) END AS t, ok FROM attempts),
isl AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END)
          OVER (PARTITION BY source ORDER BY t NULLS FIRST, attempt_id ROWS UNBOUNDED PRECEDING) AS island FROM att),
fails AS (SELECT attempt_id, source, t, island,
                 row_number() OVER (PARTITION BY source, island ORDER BY t NULLS FIRST, attempt_id) AS fail_n
          FROM isl WHERE NOT ok),
timed AS (SELECT *, row_number() OVER (PARTITION BY source, island ORDER BY t, attempt_id) AS k FROM fails WHERE t IS NOT NULL),
walk AS (
  SELECT attempt_id, source, island, k, t AS last_log, true AS logged FROM timed WHERE k = 1
  UNION ALL
  SELECT f.attempt_id, f.source, f.island, f.k,
         CASE WHEN f.t - w.last_log > 5 THEN f.t ELSE w.last_log END, f.t - w.last_log > 5
  FROM walk w JOIN timed f ON f.source IS NOT DISTINCT FROM w.source AND f.island = w.island AND f.k = w.k + 1)
SELECT f.attempt_id, f.source, CAST(f.fail_n AS BIGINT) AS fail_n,
       least(CAST(0.2 AS DOUBLE) * f.fail_n, CAST(5.0 AS DOUBLE)) AS backoff_s, coalesce(w.logged, false) AS logged
FROM fails f LEFT JOIN walk w ON w.attempt_id = f.attempt_id""",
)
def q_failure_runs_null_source(spark, sf_dir):
    r = AL.failure_runs(_no_source_no_time(X.attempts(spark, sf_dir), "attempt_id", "ts"))
    return r.select("attempt_id", "source", "fail_n", "backoff_s", "logged")


@register(
    "announce_null_source",
    with_dets("frames", recursive=True) + BESTF_SQL
    + f""", nulled AS (SELECT frame_id, nullif(source, 'cam_0') AS source, CASE WHEN frame_id % 50 <> 0 THEN epoch_s END AS epoch_s,
                            best_species, best_species_conf FROM bestf),
ann AS (SELECT * FROM nulled WHERE best_species_conf >= {ALERT_MIN_CONF}),
chg AS (SELECT *, coalesce(lag(best_species) OVER (PARTITION BY source ORDER BY epoch_s NULLS FIRST, frame_id) <> best_species,
                           true) AS changed FROM ann),
runs AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END)
          OVER (PARTITION BY source ORDER BY epoch_s NULLS FIRST, frame_id ROWS UNBOUNDED PRECEDING) AS run_id FROM chg),
sp AS (SELECT *, row_number() OVER (PARTITION BY source, run_id ORDER BY epoch_s, frame_id) AS rn,
              row_number() OVER (PARTITION BY source, best_species ORDER BY epoch_s, frame_id) AS rs FROM runs WHERE epoch_s IS NOT NULL),
speak_walk AS (
  SELECT source, run_id, rn, frame_id, epoch_s AS last_t, true AS speak FROM sp WHERE rn = 1
  UNION ALL
  SELECT s.source, s.run_id, s.rn, s.frame_id,
         CASE WHEN s.epoch_s - w.last_t >= 60 THEN s.epoch_s ELSE w.last_t END, s.epoch_s - w.last_t >= 60
  FROM speak_walk w JOIN sp s ON s.source IS NOT DISTINCT FROM w.source AND s.run_id = w.run_id AND s.rn = w.rn + 1),
song_walk AS (
  SELECT source, best_species, rs, frame_id, epoch_s AS last_t, true AS play_song FROM sp WHERE rs = 1
  UNION ALL
  SELECT s.source, s.best_species, s.rs, s.frame_id,
         CASE WHEN s.epoch_s - w.last_t >= 10 THEN s.epoch_s ELSE w.last_t END, s.epoch_s - w.last_t >= 10
  FROM song_walk w JOIN sp s ON s.source IS NOT DISTINCT FROM w.source AND s.best_species = w.best_species AND s.rs = w.rs + 1)
SELECT r.frame_id, r.source, r.epoch_s, r.best_species, r.changed, coalesce(a.speak, false) AS speak,
       coalesce(b.play_song, false) AS play_song
FROM runs r LEFT JOIN speak_walk a ON a.frame_id = r.frame_id LEFT JOIN song_walk b ON b.frame_id = r.frame_id""",
)
def q_announce_null_source(spark, sf_dir):
    a = AL.announce(_no_source_no_time(frames_with_best(spark, sf_dir), "frame_id", "epoch_s"), ALERT_MIN_CONF)
    return a.select("frame_id", "source", "epoch_s", "best_species", "changed", "speak", "play_song")


@register(
    "species_visits",
    with_dets("frames") + BESTF_SQL
    + f""", ann AS (SELECT * FROM bestf WHERE best_species_conf >= {ALERT_MIN_CONF}),
flag AS (SELECT *, CASE WHEN lag(best_species) OVER w IS NULL OR lag(best_species) OVER w <> best_species
                          OR epoch_s - lag(epoch_s) OVER w > {VISIT_GAP_S} THEN 1 ELSE 0 END AS new_visit
         FROM ann WINDOW w AS (PARTITION BY source ORDER BY epoch_s, frame_id)),
vis AS (SELECT *, sum(new_visit) OVER (PARTITION BY source ORDER BY epoch_s, frame_id ROWS UNBOUNDED PRECEDING) AS visit_no
        FROM flag)
SELECT source, CAST(visit_no AS BIGINT) AS visit_no, max(best_species) AS species, min(epoch_s) AS start_epoch_s,
       max(epoch_s) AS end_epoch_s, count(*) AS frames, max(best_species_conf) AS max_conf
FROM vis GROUP BY source, visit_no""",
)
def q_species_visits(spark, sf_dir):
    return AL.species_visits(frames_with_best(spark, sf_dir), VISIT_GAP_S, ALERT_MIN_CONF)


@register(
    "aligned_ticks",
    X.with_views("attempts")
    + """SELECT attempt_id, epoch(ts) AS epoch_s,
       (floor(epoch(ts) / CAST(2.0 AS DOUBLE)) + 1) * CAST(2.0 AS DOUBLE) AS next_tick
FROM attempts""",
)
def q_aligned_ticks(spark, sf_dir):
    a = X.attempts(spark, sf_dir).select("attempt_id", AL.epoch_seconds("ts").alias("epoch_s"))
    return AL.aligned_ticks(a, "epoch_s")


@register(
    "conflate_frames",
    X.with_views("frames")
    + f"""SELECT source, slot_start, frames_in_slot, frame_id, epoch_s FROM (
  SELECT source, floor(epoch_s / {CONFLATE_SLOT_S}) * {CONFLATE_SLOT_S} AS slot_start, frame_id, epoch_s,
         count(*) OVER (PARTITION BY source, floor(epoch_s / {CONFLATE_SLOT_S})) AS frames_in_slot,
         row_number() OVER (PARTITION BY source, floor(epoch_s / {CONFLATE_SLOT_S}) ORDER BY epoch_s DESC, frame_id DESC) AS rn
  FROM frames) t WHERE rn = 1""",
)
def q_conflate_frames(spark, sf_dir):
    f = X.frames(spark, sf_dir).select("source", "frame_id", "epoch_s")
    c = AL.conflate(f, CONFLATE_SLOT_S)
    return c.select("source", "slot_start", F.col("frames_in_slot").cast("long").alias("frames_in_slot"),
                    "frame_id", "epoch_s")


# ---- facts: P6, P7, P9, P10, P11, A6, A8, A9, A10 ----------------------------------------

BETWEEN_T0, BETWEEN_T1 = "2024-01-01 06:00:00", "2024-01-01 12:00:00"


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 over the fixture: kept detections of every frame, with review marks. The marks come from
    the same adapter rows as the boxes, so they ride along instead of being joined back."""
    boxes = X.reviewed_boxes(spark, sf_dir)
    dets = D.detections(boxes, X.class_dim(spark), config.DETECT_CONF)
    return FA.to_sightings(dets, X.frames(spark, sf_dir))


FACTS_SQL = f""", facts AS (
SELECT f.source, d.frame_id, d.det_idx, {TS_SQL} AS detected_at,
       'detections/detection_' || {FILE_TS_SQL} || '.jpg' AS image_path,
       'yolov8s.pt' AS detector_model, d.detector_label, d.confidence AS detector_confidence,
       'bird_classifier.onnx' AS classifier_model,
       CASE WHEN d.species IS NOT NULL AND d.species <> '' THEN d.species END AS classifier_label,
       d.species_confidence AS classifier_confidence,
       d.bbox_x1, d.bbox_y1, d.bbox_x2, d.bbox_y2, f.source AS video_source,
       coalesce(r.reviewed, false) AS reviewed, r.corrected_label
FROM dets d JOIN frames f ON f.frame_id = d.frame_id
LEFT JOIN reviews r ON r.frame_id = d.frame_id AND r.det_idx = d.det_idx)
"""

FACT_OUT = ["source", "frame_id", "det_idx", "detected_at", "image_path", "detector_model", "detector_label",
            "detector_confidence", "classifier_model", "classifier_label", "classifier_confidence", "bbox_x1",
            "bbox_y1", "bbox_x2", "bbox_y2", "video_source", "reviewed", "corrected_label"]


def _fact_cols(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "detected_at" else F.col(c)
                       for c in FACT_OUT])


FACT_SEL = ", ".join(
    "strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected_at" if c == "detected_at" else c for c in FACT_OUT
)


@register("sighting_rows", with_dets("frames", "reviews") + FACTS_SQL + f"SELECT {FACT_SEL} FROM facts")
def q_sighting_rows(spark, sf_dir):
    return _fact_cols(sightings(spark, sf_dir))


@register(
    "reject_rows",
    with_dets("frames", "reviews") + FACTS_SQL
    + """SELECT source, frame_id, det_idx,
       CASE WHEN frame_id % 50 = 0 THEN 'detected_at is null' ELSE 'image_path is null' END AS reject_reason
FROM facts WHERE frame_id % 50 = 0 OR frame_id % 53 = 0""",
)
def q_reject_rows(spark, sf_dir):
    holes = sightings(spark, sf_dir).withColumns({
        "detected_at": F.when(F.col("frame_id") % 50 != 0, F.col("detected_at")),
        "image_path": F.when(F.col("frame_id") % 53 != 0, F.col("image_path"))})
    _ok, rejects = FA.split_valid(holes)
    return rejects.select("source", "frame_id", "det_idx", "reject_reason")


@register(
    "review_queue",
    with_dets("frames", "reviews") + FACTS_SQL
    + """SELECT row_number() OVER (ORDER BY classifier_confidence ASC NULLS FIRST, source, frame_id, det_idx) AS queue_pos,
       source, frame_id, det_idx, classifier_label, classifier_confidence
FROM facts WHERE NOT reviewed""",
)
def q_review_queue(spark, sf_dir):
    return FA.review_positions(sightings(spark, sf_dir)).select(
        "queue_pos", "source", "frame_id", "det_idx", "classifier_label", "classifier_confidence")


@register(
    "sightings_between",
    with_dets("frames", "reviews") + FACTS_SQL
    + f"""SELECT source, frame_id, det_idx, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected_at,
       coalesce(corrected_label, classifier_label, detector_label) AS effective_label
FROM facts WHERE detected_at >= TIMESTAMP '{BETWEEN_T0}' AND detected_at < TIMESTAMP '{BETWEEN_T1}'""",
)
def q_sightings_between(spark, sf_dir):
    b = FA.with_effective_label(FA.between(sightings(spark, sf_dir), BETWEEN_T0, BETWEEN_T1))
    return b.select("source", "frame_id", "det_idx", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss").alias("detected_at"),
                    "effective_label")


@register(
    "species_by_time",
    with_dets("frames", "reviews") + FACTS_SQL
    + """, e AS (SELECT coalesce(corrected_label, classifier_label, detector_label) AS label,
                  strftime(detected_at, '%Y-%m-%d') AS day, CAST(hour(detected_at) AS INTEGER) AS hour,
                  source || '/' || CAST(frame_id AS VARCHAR) AS frame_key,
                  CAST(coalesce(classifier_confidence, detector_confidence) AS DOUBLE) AS conf FROM facts)
SELECT label, day, hour, count(*) AS sightings, count(DISTINCT frame_key) AS frames, avg(conf) AS mean_conf,
       max(conf) AS max_conf,
       CASE grouping(label, day, hour) WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 3 THEN 'label' ELSE 'total' END AS level
FROM e GROUP BY GROUPING SETS ((label, day, hour), (label, day), (label), ())""",
)
def q_species_by_time(spark, sf_dir):
    return FA.species_by_time(sightings(spark, sf_dir))


@register(
    "label_agreement",
    with_dets("frames", "reviews") + FACTS_SQL
    + """, r AS (SELECT coalesce(classifier_label, detector_label) AS predicted_label,
                  coalesce(corrected_label, classifier_label, detector_label) AS corrected_label
           FROM facts WHERE reviewed)
SELECT p.predicted_label, p.corrected_label, p.n, c.class_total, c.class_accuracy
FROM (SELECT predicted_label, corrected_label, count(*) AS n FROM r GROUP BY 1, 2) p
JOIN (SELECT predicted_label, count(*) AS class_total,
             100.0 * sum(CASE WHEN predicted_label = corrected_label THEN 1 ELSE 0 END) / count(*) AS class_accuracy
      FROM r GROUP BY 1) c ON c.predicted_label = p.predicted_label""",
)
def q_label_agreement(spark, sf_dir):
    return FA.label_agreement(sightings(spark, sf_dir))


@register(
    "stage_latency",
    X.with_views("frames")
    + f"""SELECT source, strftime(date_trunc('hour', {TS_SQL}), '%Y-%m-%d %H:%M') AS bucket, count(*) AS frames,
       avg(grab_ms) AS grab_mean, quantile_cont(grab_ms, 0.5) AS grab_p50, quantile_cont(grab_ms, 0.95) AS grab_p95,
       max(grab_ms) AS grab_max,
       avg(detect_ms) AS detect_mean, quantile_cont(detect_ms, 0.5) AS detect_p50,
       quantile_cont(detect_ms, 0.95) AS detect_p95, max(detect_ms) AS detect_max,
       avg(classify_ms) AS classify_mean, quantile_cont(classify_ms, 0.5) AS classify_p50,
       quantile_cont(classify_ms, 0.95) AS classify_p95, max(classify_ms) AS classify_max
FROM frames GROUP BY 1, 2""",
)
def q_stage_latency(spark, sf_dir):
    return FA.stage_latency(X.frames(spark, sf_dir), exact=True)


_RANKS = [(stage, p) for stage in FA.LATENCY_STAGES for p in (50, 95)]


def _latency_level_sql(level: str) -> str:
    return f"""SELECT '{level}' AS level, source, strftime(date_trunc('{level}', {TS_SQL}), '%Y-%m-%d %H:%M') AS bucket,
       count(*) AS frames, avg(grab_ms) AS grab_mean, max(grab_ms) AS grab_max, avg(detect_ms) AS detect_mean, max(detect_ms) AS detect_max,
       avg(classify_ms) AS classify_mean, max(classify_ms) AS classify_max,
       """ + ", ".join(f"true AS {stage}_p{p}_ok" for stage, p in _RANKS) + "\nFROM frames GROUP BY 2, 3"


@register(
    "stage_latency_sketch",
    X.with_views("frames") + _latency_level_sql("hour") + "\nUNION ALL\n" + _latency_level_sql("day"),
)
def q_stage_latency_sketch(spark, sf_dir):
    """Hourly sketches, and days merged from them. Each quantile is held against the frames: the share of times below
    it and up to it must enclose the asked share, give or take the sketch's rank error."""
    frames = X.frames(spark, sf_dir)
    hours = FA.latency_sketches(frames)
    out = None
    for level, sketches in (("hour", hours), ("day", FA.merge_latency(hours, "day"))):
        q = FA.latency_quantiles(sketches)
        times = frames.withColumn("_b", F.date_trunc(level, F.timestamp_seconds("epoch_s"))).withColumnRenamed("source", "_s")
        seen = times.join(q, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        names = [c for c in q.columns if "_p" not in c]
        oks = []
        for stage, p in _RANKS:
            c, at, e = F.col(f"{stage}_ms"), F.col(f"{stage}_p{p}"), config.LATENCY_RANK_ERROR
            below, upto = F.avg((c < at).cast("double")), F.avg((c <= at).cast("double"))
            oks.append(((below - e <= p / 100) & (p / 100 <= upto + e)).alias(f"{stage}_p{p}_ok"))
        rows = seen.groupBy(*names).agg(*oks).withColumn("level", F.lit(level)).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "run_counters",
    with_dets("frames", "attempts")
    + """SELECT count(*) AS frames_processed,
       count(*) FILTER (WHERE EXISTS (SELECT 1 FROM dets d WHERE d.frame_id = f.frame_id)) AS frames_with_detections,
       (SELECT count(*) FROM attempts WHERE NOT ok) AS failed_attempts,
       count(*) - count(*) FILTER (WHERE EXISTS (SELECT 1 FROM dets d WHERE d.frame_id = f.frame_id)) AS frames_without_detections
FROM frames f""",
)
def q_run_counters(spark, sf_dir):
    return D.run_counters(X.frames(spark, sf_dir), kept_detections(spark, sf_dir), X.attempts(spark, sf_dir))


# ---- corpus and mapping: A1, A2, U3, W1, J4, O2, F10, J5, J6 ------------------------------


CLASS_COUNTS_SQL = """, counts AS (
SELECT c.class_name, coalesce(x.n, 0) AS n
FROM (SELECT DISTINCT class_name FROM corpus) c
LEFT JOIN (SELECT class_name, count(*) AS n FROM corpus
           WHERE path LIKE '%.jpg' OR path LIKE '%.png' GROUP BY class_name) x ON x.class_name = c.class_name)
"""


def _index_sql(name: str, min_samples: int) -> str:
    return f""", {name} AS (
SELECT class_name, CAST(row_number() OVER (ORDER BY class_name) - 1 AS INTEGER) AS idx
FROM counts WHERE n >= {min_samples})
"""


def corpus_counts(spark, sf_dir):
    return CO.class_counts(X.corpus(spark, sf_dir))


def corpus_index(spark, sf_dir, min_samples=config.MIN_SAMPLES):
    return CO.class_index(CO.valid_classes(corpus_counts(spark, sf_dir), min_samples))


@register("class_counts", X.with_views("corpus") + CLASS_COUNTS_SQL + "SELECT class_name, n FROM counts")
def q_class_counts(spark, sf_dir):
    return corpus_counts(spark, sf_dir)


@register("valid_classes", X.with_views("corpus") + CLASS_COUNTS_SQL + "SELECT class_name, n FROM counts WHERE n >= 5")
def q_valid_classes(spark, sf_dir):
    return CO.valid_classes(corpus_counts(spark, sf_dir))


@register(
    "dropped_classes",
    X.with_views("corpus") + CLASS_COUNTS_SQL
    + "SELECT class_name, n, class_name || '(' || CAST(n AS VARCHAR) || ')' AS label FROM counts WHERE n < 5",
)
def q_dropped_classes(spark, sf_dir):
    return CO.dropped_classes(corpus_counts(spark, sf_dir))


@register("class_index", X.with_views("corpus") + CLASS_COUNTS_SQL + _index_sql("idx5", 5) + "SELECT * FROM idx5")
def q_class_index(spark, sf_dir):
    return corpus_index(spark, sf_dir)


@register(
    "sample_index",
    X.with_views("corpus") + CLASS_COUNTS_SQL + _index_sql("idx5", 5)
    + """SELECT c.path, c.class_name, i.idx AS class_idx FROM corpus c JOIN idx5 i ON i.class_name = c.class_name
WHERE c.path LIKE '%.jpg' OR c.path LIKE '%.png'""",
)
def q_sample_index(spark, sf_dir):
    return CO.sample_index(X.corpus(spark, sf_dir), corpus_index(spark, sf_dir))


SPLIT_SEED = 42


@register(
    "split_sizes",
    X.with_views("corpus") + CLASS_COUNTS_SQL + _index_sql("idx5", 5)
    + """, s AS (SELECT count(*) AS n FROM corpus c JOIN idx5 i ON i.class_name = c.class_name
           WHERE c.path LIKE '%.jpg' OR c.path LIKE '%.png')
SELECT 'train' AS split, CAST(floor(CAST(0.8 AS DOUBLE) * n) AS BIGINT) AS samples FROM s
UNION ALL
SELECT 'val' AS split, n - CAST(floor(CAST(0.8 AS DOUBLE) * n) AS BIGINT) AS samples FROM s""",
)
def q_split_sizes(spark, sf_dir):
    samples = CO.sample_index(X.corpus(spark, sf_dir), corpus_index(spark, sf_dir))
    train, val = CO.split_exact(samples, config.TRAIN_FRACTION, SPLIT_SEED)
    t = train.agg(F.count(F.lit(1)).alias("samples")).withColumn("split", F.lit("train"))
    v = val.agg(F.count(F.lit(1)).alias("samples")).withColumn("split", F.lit("val"))
    return t.unionByName(v).select("split", F.col("samples").cast("long"))


@register(
    "mapping_fingerprint",
    X.with_views("corpus") + CLASS_COUNTS_SQL + _index_sql("idx5", 5)
    + """SELECT count(*) AS n_classes,
       sha256('{' || string_agg('"' || class_name || '":' || CAST(idx AS VARCHAR), ',' ORDER BY class_name) || '}')[1:12]
         AS fingerprint
FROM idx5""",
)
def q_mapping_fingerprint(spark, sf_dir):
    return CO.mapping_fingerprint(corpus_index(spark, sf_dir))


@register(
    "mapping_diff",
    X.with_views("corpus") + CLASS_COUNTS_SQL + _index_sql("idx5", 5) + _index_sql("idx3", 3)
    + """SELECT coalesce(o.class_name, n.class_name) AS class_name, o.idx AS old_idx, n.idx AS new_idx,
       CASE WHEN o.idx IS NULL THEN 'added' WHEN n.idx IS NULL THEN 'removed'
            WHEN o.idx <> n.idx THEN 'reindexed' ELSE 'same' END AS status
FROM idx5 o FULL OUTER JOIN idx3 n ON o.class_name = n.class_name""",
)
def q_mapping_diff(spark, sf_dir):
    counts = corpus_counts(spark, sf_dir)
    old = CO.class_index(CO.valid_classes(counts, 5))
    new = CO.class_index(CO.valid_classes(counts, 3))
    return CO.mapping_diff(old, new).select("class_name", "old_idx", "new_idx", "status")


@register(
    "key_shape_match",
    X.with_views("corpus")
    + """, l AS (SELECT class_name AS name, '[' || CAST(count(*) AS VARCHAR) || ']' AS shape
           FROM corpus WHERE path LIKE '%.jpg' GROUP BY 1),
r AS (SELECT class_name AS name, '[' || CAST(count(*) AS VARCHAR) || ']' AS shape
      FROM corpus WHERE path LIKE '%.png' GROUP BY 1)
SELECT coalesce(l.name, r.name) AS name, coalesce(l.shape, r.shape) AS shape,
       CASE WHEN l.name IS NOT NULL AND r.name IS NOT NULL THEN 'matched'
            WHEN l.name IS NOT NULL THEN 'skipped' ELSE 'missing' END AS status
FROM l FULL OUTER JOIN r ON l.name = r.name AND l.shape = r.shape""",
)
def q_key_shape_match(spark, sf_dir):
    c = X.corpus(spark, sf_dir)

    def params(ext):
        return c.where(F.col("path").endswith(ext)).groupBy(F.col("class_name").alias("name")).agg(
            F.concat(F.lit("["), F.count(F.lit(1)).cast("string"), F.lit("]")).alias("shape"))

    return CO.match_by_key_and_shape(params(".jpg"), params(".png"))


# ---- vectors: F12, O4, M4, J2, A7, W7, F14 --------------------------------------------------

@register(
    "softmax_top1",
    X.with_views("logits", "class_map")
    + """SELECT t.vec_id, t.top_idx, coalesce(c.class_name, 'class_' || CAST(t.top_idx AS VARCHAR)) AS species,
       round(t.top_prob, 9) AS top_prob
FROM (SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS top_idx,
             1.0 / list_sum(list_transform(logits, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(logits) AS DOUBLE))))
               AS top_prob
      FROM logits) t
LEFT JOIN class_map c ON c.idx = t.top_idx""",
)
def q_softmax_top1(spark, sf_dir):
    t = VE.top1(X.logits(spark, sf_dir), X.class_map(spark, sf_dir))
    return t.select("vec_id", "top_idx", "species", F.round("top_prob", 9).alias("top_prob"))


@register(
    "batch_metrics",
    X.with_views("logits")
    + """, l AS (SELECT vec_id, label, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred,
       CAST(list_max(logits) AS DOUBLE)
         + ln(list_sum(list_transform(logits, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(logits) AS DOUBLE)))))
         - CAST(logits[label + 1] AS DOUBLE) AS loss,
       (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS batch_id
FROM logits),
b AS (SELECT batch_id, avg(loss) AS bl, count(*) AS n, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS c
      FROM l GROUP BY batch_id)
SELECT CAST(sum(n) AS BIGINT) AS samples, CAST(sum(c) AS BIGINT) AS correct,
       CAST(100.0 AS DOUBLE) * sum(c) / sum(n) AS accuracy, round(avg(bl), 9) AS mean_batch_loss, count(*) AS batches
FROM b""",
)
def q_batch_metrics(spark, sf_dir):
    pred = VE.batch_ids(VE.with_loss(X.logits(spark, sf_dir)), ["vec_id"], config.BATCH_SIZE)
    m = VE.classification_metrics(pred)
    return m.withColumn("mean_batch_loss", F.round("mean_batch_loss", 9))


@register(
    "best_epochs",
    X.with_views("epoch_log")
    + """SELECT epoch, val_acc FROM (
  SELECT epoch, val_acc, max(val_acc) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM epoch_log) t
WHERE val_acc > coalesce(prev, 0.0)""",
)
def q_best_epochs(spark, sf_dir):
    return VE.best_epochs(X.epoch_log(spark, sf_dir)).select("epoch", "val_acc")


@register(
    "cosine_lr",
    X.with_views("epoch_log")
    + "SELECT epoch, round(0.5 * CAST(0.0001 AS DOUBLE) * (1 + cos(pi() * epoch / CAST(30 AS DOUBLE))), 12) AS lr FROM epoch_log",
)
def q_cosine_lr(spark, sf_dir):
    s = VE.cosine_schedule(X.epoch_log(spark, sf_dir))
    return s.select("epoch", F.round("lr", 12).alias("lr"))


# ---- scalar checks over whole tables: F1, F15 -------------------------------------------

@register(
    "safe_label",
    "SELECT doc_id, sha256(regexp_replace(text, '[^\\p{L}\\p{N}_-]', '_', 'g')) AS safe_sha FROM documents",
)
def q_safe_label(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", F.sha2(S.safe_label("text"), 256).alias("safe_sha"))


LENIENT_SQL = """SELECT event_id AS attempt_id,
       lower(trim(CAST(user_id % 2 AS VARCHAR))) IN ('1', 'true', 'yes', 'y', 'on') AS flag,
       CASE WHEN regexp_full_match(trim(regexp_extract(props, '"k": ([0-9]+)', 1)), '[+-]?[0-9]+(_[0-9]+)*')
            THEN CAST(replace(trim(regexp_extract(props, '"k": ([0-9]+)', 1)), '_', '') AS BIGINT) ELSE -1 END AS k_int,
       CASE WHEN regexp_full_match(trim(printf('%.2f', value)), '[+-]?[0-9]+(_[0-9]+)*(\\.([0-9]+(_[0-9]+)*)?)?')
            THEN CAST(replace(trim(printf('%.2f', value)), '_', '') AS DOUBLE) ELSE -1.0 END AS value_float,
       CASE WHEN regexp_full_match(trim(event_type), '[+-]?[0-9]+(_[0-9]+)*')
            THEN CAST(trim(event_type) AS BIGINT) ELSE -1 END AS type_int,
       CAST(-1.0 AS DOUBLE) AS props_float
FROM events"""


@register("lenient_parse", LENIENT_SQL)
def q_lenient_parse(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", ["event_id", "user_id", "props", "value", "event_type"])
    return e.select(
        F.col("event_id").alias("attempt_id"),
        S.parse_bool((F.col("user_id") % 2).cast("string")).alias("flag"),
        S.parse_int(F.regexp_extract("props", r'"k": ([0-9]+)', 1), -1).alias("k_int"),
        S.parse_float(F.format_string("%.2f", "value"), -1.0).alias("value_float"),
        S.parse_int("event_type", -1).alias("type_int"),
        S.parse_float("props", -1.0).alias("props_float"),
    )


# ---- P1 / A11 over frames derived from the embedding table; M5 / M6 -------------------------



def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 grey frame per embedding vector (pixel = floor(16 x) + 128, the same byte in all
    three BGR channels), built JVM-side as Spark's image struct."""
    e = X.logits(spark, sf_dir)
    px = F.transform("logits", lambda x: (F.floor(x.cast("double") * 16.0) + 128).cast("int"))
    hexes = F.transform(px, lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), 3))
    img = F.struct(
        F.concat(F.lit("embedding:"), F.col("vec_id").cast("string")).alias("origin"),
        F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"),
        F.lit(IM.CV_8UC3).alias("mode"), F.unhex(F.array_join(hexes, "")).alias("data"),
    )
    return e.select("vec_id", img.alias("image"))


@register(
    "frame_quality",
    X.with_views("logits")
    + """, px AS (SELECT vec_id, CAST(floor(CAST(x AS DOUBLE) * 16.0) AS BIGINT) + 128 AS v, (i - 1) // 8 AS r
            FROM (SELECT vec_id, unnest(logits) AS x, generate_subscripts(logits, 1) AS i FROM logits) u),
nd AS (SELECT vec_id, count(DISTINCT v) AS n_distinct FROM px GROUP BY vec_id),
rw AS (SELECT vec_id, r, count(*) AS n, sum(v) AS s, sum(v * v) AS ss FROM px WHERE r >= 4 GROUP BY vec_id, r),
fl AS (SELECT vec_id, sum(CASE WHEN n * ss - s * s < 4 * n * n THEN 1 ELSE 0 END) AS n_flat, count(*) AS n_rows
       FROM rw GROUP BY vec_id)
SELECT nd.vec_id,
       nd.n_distinct <= 1 OR CAST(fl.n_flat AS DOUBLE) / greatest(fl.n_rows, 1) > 0.3 AS is_corrupt,
       CASE WHEN nd.n_distinct <= 1 THEN 'single value'
            WHEN CAST(fl.n_flat AS DOUBLE) / greatest(fl.n_rows, 1) > 0.3 THEN 'flat rows' END AS reason
FROM nd JOIN fl ON fl.vec_id = nd.vec_id""",
)
def q_frame_quality(spark, sf_dir):
    return IM.frame_quality(embedding_frames(spark, sf_dir)).select("vec_id", "is_corrupt", "reason")


@register("classifier_eval", None)  # iterative training: rows-only check
def q_classifier_eval(spark, sf_dir):
    emb = X.logits(spark, sf_dir).withColumnRenamed("logits", "embedding")
    model, _train, val = TR.train_species_classifier(emb, max_iter=50)
    metrics, _confusion = TR.evaluate(model, val)
    return metrics


# ---- branches that the queries above don't reach ---------------------------------------------

@register(
    "lenient_parse_forms",
    """SELECT event_id,
       CASE event_id % 5 WHEN 0 THEN user_id WHEN 1 THEN user_id * 10 + 5 WHEN 2 THEN user_id WHEN 4 THEN 12 ELSE -1 END AS as_int,
       CASE event_id % 5 WHEN 0 THEN user_id + CAST(0.5 AS DOUBLE) WHEN 1 THEN user_id * CAST(100 AS DOUBLE)
            WHEN 2 THEN CAST(10.25 AS DOUBLE) WHEN 4 THEN CAST(0.25 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS as_float,
       event_id % 4 IN (0, 1) AS as_bool
FROM events""",
)
def q_lenient_parse_forms(spark, sf_dir):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 5
    whole = (F.when(k == 0, F.concat(F.lit("\u00a0"), u, F.lit("\u2003"))).when(k == 1, F.concat(u, F.lit("_5"))).when(k == 2, F.concat(F.lit("+"), u))
             .when(k == 4, F.lit("\uff11\uff12")).otherwise(F.concat(F.lit("x"), u)))
    real = (F.when(k == 0, F.concat(u, F.lit(".5"))).when(k == 1, F.concat(F.lit("\t"), u, F.lit("e2"))).when(k == 2, F.lit("1_0.25"))
            .when(k == 4, F.lit(" .25")).otherwise(F.lit("1__0")))
    word = F.element_at(F.array(F.lit(" Yes "), F.lit("\u00a0ON"), F.lit("nope"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    e = read_table(spark, sf_dir, "events", ["event_id", "user_id"])
    return e.select("event_id", S.parse_int(whole, -1).alias("as_int"), S.parse_float(real, -1.0).alias("as_float"), S.parse_bool(word).alias("as_bool"))


@register(
    "split_membership",
    X.with_views("corpus") + CLASS_COUNTS_SQL + _index_sql("idx5", 5)
    + """SELECT c.path, CAST(1 AS BIGINT) AS sides FROM corpus c JOIN idx5 i ON i.class_name = c.class_name
WHERE c.path LIKE '%.jpg' OR c.path LIKE '%.png'""",
)
def q_split_membership(spark, sf_dir):
    """O2: the sides are disjoint and cover all samples."""
    samples = CO.sample_index(X.corpus(spark, sf_dir), corpus_index(spark, sf_dir))
    train, val = CO.split_exact(samples, config.TRAIN_FRACTION, SPLIT_SEED)
    both = train.withColumn("side", F.lit("train")).unionByName(val.withColumn("side", F.lit("val")))
    return both.groupBy("path").agg(F.count("side").alias("sides"))


FRACTION_FRAMES = "(SELECT frame_id, source, epoch_s + (frame_id % 8) * CAST(0.125 AS DOUBLE) AS epoch_s FROM frames)"


@register(
    "event_fields_fraction",
    with_dets("frames")
    + f"""SELECT frame_id, {FILE_TS_SQL} || '-' || CAST(CAST(trunc(epoch_s * 1000) AS BIGINT) AS VARCHAR) AS event_id,
       strftime({TS_SQL}, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN epoch_s = floor(epoch_s) THEN '' ELSE strftime({TS_SQL}, '.%f') END || '+00:00' AS ts
FROM {FRACTION_FRAMES} f WHERE EXISTS (SELECT 1 FROM dets d WHERE d.frame_id = f.frame_id)""",
)
def q_event_fields_fraction(spark, sf_dir):
    fr = X.frames(spark, sf_dir).withColumn("epoch_s", F.col("epoch_s") + (F.col("frame_id") % 8) * F.lit(0.125))
    return EV.build_events(fr, kept_detections(spark, sf_dir)).select("frame_id", "event_id", "ts")


@register(
    "sightings_short_bbox",
    with_dets("frames", "reviews") + FACTS_SQL
    + """SELECT source, frame_id, det_idx, CASE WHEN det_idx % 2 = 0 THEN bbox_x1 END AS bbox_x1,
       CASE WHEN det_idx % 2 = 0 THEN bbox_y2 END AS bbox_y2 FROM facts""",
)
def q_sightings_short_bbox(spark, sf_dir):
    dets = D.detections(X.reviewed_boxes(spark, sf_dir), X.class_dim(spark), config.DETECT_CONF)
    short = dets.withColumn("bbox", F.when(F.col("det_idx") % 2 == 0, F.col("bbox")).otherwise(F.slice("bbox", 1, 3)))
    return FA.to_sightings(short, X.frames(spark, sf_dir)).select("source", "frame_id", "det_idx", "bbox_x1", "bbox_y2")


@register(
    "flat_events",
    with_dets("frames")
    + """SELECT 'e-' || CAST(d.frame_id AS VARCHAR) || '-' || CAST(d.det_idx AS VARCHAR) AS event_id, f.source, f.epoch_s, d.species AS best_species,
       CAST(d.species_confidence AS DOUBLE) AS best_species_conf, d.detector_label AS class, CAST(d.confidence AS DOUBLE) AS confidence,
       'p/' || CAST(d.frame_id AS VARCHAR) AS annotated_image_path, 2 AS schema_version
FROM dets d JOIN frames f ON f.frame_id = d.frame_id""",
)
def q_flat_events(spark, sf_dir):
    """S3: the flat version, one detection a message."""
    d = kept_detections(spark, sf_dir).join(X.frames(spark, sf_dir).select("frame_id", "source", "epoch_s"), "frame_id")
    flat = F.to_json(F.struct(
        F.concat_ws("-", F.lit("e"), "frame_id", "det_idx").alias("event_id"), F.lit("2024-01-01T00:00:00+00:00").alias("ts"), "epoch_s", "source",
        F.col("detector_label").alias("yolo_label"), F.col("confidence").cast("double").alias("yolo_conf"), "species",
        F.col("species_confidence").cast("double").alias("species_conf"), F.concat(F.lit("p/"), F.col("frame_id").cast("string")).alias("annotated_image")),
        {"ignoreNullFields": "false"})
    events, _rejects = EV.read_events(d.select(flat.alias("value")))
    return events.select("event_id", "source", "epoch_s", "best_species", "best_species_conf", F.col("detections")[0]["class"].alias("class"),
                         F.col("detections")[0]["confidence"].alias("confidence"), "annotated_image_path", "schema_version")


@register(
    "mapping_fingerprint_escaped",
    X.with_views("corpus") + CLASS_COUNTS_SQL + _index_sql("idx5", 5)
    + """SELECT count(*) AS n_classes,
       sha256('{' || string_agg('"gr\\u00f6\\u00dfe_\\ud83d\\udc26' || class_name || '":' || CAST(idx AS VARCHAR), ',' ORDER BY class_name) || '}')[1:12]
         AS fingerprint
FROM idx5""",
)
def q_mapping_fingerprint_escaped(spark, sf_dir):
    index = corpus_index(spark, sf_dir)
    return CO.mapping_fingerprint(index.withColumn("class_name", F.concat(F.lit("gr\u00f6\u00dfe_\U0001f426"), F.col("class_name"))))


@register(
    "mapping_mismatch",
    X.with_views("corpus") + CLASS_COUNTS_SQL + _index_sql("idx5", 5) + _index_sql("idx3", 3)
    + """, fp AS (SELECT 'old' AS side, count(*) AS n, sha256('{' || string_agg('"' || class_name || '":' || CAST(idx AS VARCHAR), ',' ORDER BY class_name) || '}')[1:12] AS fp FROM idx5
UNION ALL SELECT 'new', count(*), sha256('{' || string_agg('"' || class_name || '":' || CAST(idx AS VARCHAR), ',' ORDER BY class_name) || '}')[1:12] FROM idx3)
SELECT o.n AS old_classes, w.n AS new_classes, o.fp AS old_fp, w.fp AS new_fp, o.n <> w.n OR o.fp <> w.fp AS mismatch
FROM fp o, fp w WHERE o.side = 'old' AND w.side = 'new'""",
)
def q_mapping_mismatch(spark, sf_dir):
    counts = corpus_counts(spark, sf_dir)
    return CO.mapping_mismatch(CO.class_index(CO.valid_classes(counts, 5)), CO.class_index(CO.valid_classes(counts, 3))).select(
        "old_classes", "new_classes", "old_fp", "new_fp", "mismatch")


@register(
    "for_species",
    with_dets("frames", "reviews") + FACTS_SQL
    + "SELECT source, frame_id, det_idx, classifier_confidence FROM facts WHERE classifier_label = 'promo'",
)
def q_for_species(spark, sf_dir):
    return FA.for_species(sightings(spark, sf_dir), "promo").select("source", "frame_id", "det_idx", "classifier_confidence")


@register(
    "names_and_masks",
    X.with_views("frames")
    + """SELECT frame_id, frame_id % 3 <> 0 AS safe,
       CASE frame_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '***' END AS masked,
       CASE WHEN frame_id % 5 = 0 THEN 'http://other/x.jpg' ELSE 'http://host-' || CAST(frame_id % 7 AS VARCHAR) || '/api/' || source || '/latest.jpg' END AS url
FROM frames""",
)
def q_names_and_masks(spark, sf_dir):
    """F16, F19, F20."""
    k = F.col("frame_id")
    name = F.concat(F.lit(" sightings_"), k.cast("string"), F.when(k % 3 == 0, F.lit("-drop")).otherwise(F.lit("")))
    secret = F.when(k % 4 == 1, F.lit("")).when(k % 4 != 0, F.concat(F.lit("pw"), k.cast("string")))
    host = F.concat(F.lit("host-"), (k % 7).cast("string"))
    return X.frames(spark, sf_dir).select(
        "frame_id", S.is_safe_identifier(name).alias("safe"), S.mask_secret(secret).alias("masked"),
        S.snapshot_url(host, "source", F.when(k % 5 == 0, F.lit("http://other/x.jpg"))).alias("url"))


PIXELS_SQL = """, px AS (SELECT vec_id, CAST(floor(CAST(x AS DOUBLE) * 16.0) AS BIGINT) + 128 AS v, (i - 1) // 8 AS r, (i - 1) % 8 AS c
            FROM (SELECT vec_id, unnest(logits) AS x, generate_subscripts(logits, 1) AS i FROM logits) u)
"""


@register(
    "frame_crops",
    X.with_views("logits") + PIXELS_SQL
    + """SELECT vec_id AS frame_id, string_agg(repeat(lower(lpad(to_hex(v), 2, '0')), 3), '' ORDER BY r, c) AS pixels
FROM px WHERE c >= vec_id % 3 AND c < 7 AND r >= 1 AND r < 5 + vec_id % 4 GROUP BY vec_id""",
)
def q_frame_crops(spark, sf_dir):
    """M7 over the 8 x 8 frames: windows that differ by frame."""
    frames = embedding_frames(spark, sf_dir).withColumnRenamed("vec_id", "frame_id")
    k = F.col("frame_id")
    windows = frames.select("frame_id", F.lit(0).alias("det_idx"), (k % 3).cast("int").alias("crop_x1"), F.lit(1).alias("crop_y1"),
                            F.lit(7).alias("crop_x2"), (5 + k % 4).cast("int").alias("crop_y2"))
    return IM.crop_images(frames, windows).select("frame_id", F.lower(F.hex("crop.data")).alias("pixels"))


@register(
    "frame_tensors",
    X.with_views("logits") + PIXELS_SQL
    + """SELECT vec_id, r * 8 + c AS at,
       CAST(round((CAST(v AS DOUBLE) / 255 - 0.485) / 0.229, 4) AS DOUBLE) AS red,
       CAST(round((CAST(v AS DOUBLE) / 255 - 0.456) / 0.224, 4) AS DOUBLE) AS green,
       CAST(round((CAST(v AS DOUBLE) / 255 - 0.406) / 0.225, 4) AS DOUBLE) AS blue
FROM px""",
)
def q_frame_tensors(spark, sf_dir):
    """M1 over the 8 x 8 frames at their own size (CHW: red first), all cells and channels, to four decimals."""
    t = IM.tensorize(embedding_frames(spark, sf_dir), size=8)
    cells = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(i.cast("bigint").alias("at"), *[
        F.round(F.element_at("tensor", i + 64 * k + 1).cast("double"), 4).alias(c) for k, c in enumerate(("red", "green", "blue"))]))
    return t.select("vec_id", F.inline(cells))


def _corner_detector():
    """Two boxes whose confidences are read off the frame, and one of a class that P2 drops."""
    return lambda a: [(14, (int(a[0, 0, 0]) % 64) / 64, 1.9, 2.0, 6.0, 7.0), (15, (int(a[0, 1, 0]) % 64) / 64, 0.0, 0.0, 8.0, 8.0), (3, 0.9, 0, 0, 4, 4)]


GOOD_FRAMES_SQL = """, nd AS (SELECT vec_id, count(DISTINCT v) AS n_distinct FROM px GROUP BY vec_id),
rw AS (SELECT vec_id, r, count(*) AS n, sum(v) AS s, sum(v * v) AS ss FROM px WHERE r >= 4 GROUP BY vec_id, r),
fl AS (SELECT vec_id, sum(CASE WHEN n * ss - s * s < 4 * n * n THEN 1 ELSE 0 END) AS n_flat, count(*) AS n_rows FROM rw GROUP BY vec_id),
good AS (SELECT nd.vec_id FROM nd JOIN fl ON fl.vec_id = nd.vec_id
         WHERE nd.n_distinct > 1 AND CAST(fl.n_flat AS DOUBLE) / greatest(fl.n_rows, 1) <= 0.3),
bx AS (SELECT p.vec_id AS frame_id, CAST(p.c AS INTEGER) AS det_idx, CASE WHEN p.c = 0 THEN 'bird' ELSE 'cat' END AS detector_label,
              CAST((p.v % 64) / CAST(64 AS DOUBLE) AS FLOAT) AS confidence, p.c
       FROM px p JOIN good g ON g.vec_id = p.vec_id WHERE p.r = 0 AND p.c < 2)
"""


@register(
    "two_stage_boxes",
    X.with_views("logits") + PIXELS_SQL + GOOD_FRAMES_SQL
    + """SELECT frame_id, det_idx, detector_label, confidence, CASE WHEN c = 0 THEN 1 ELSE 0 END AS bbox_x1,
       0 AS crop_x1, CASE WHEN c = 0 THEN 7 ELSE 8 END AS crop_x2, CASE WHEN c = 0 THEN 8 ELSE 8 END AS crop_y2
FROM bx WHERE confidence > 0.25""",
)
def q_two_stage_boxes(spark, sf_dir):
    """M8 without a classifier over the 8 x 8 frames, padding 1."""
    frames = embedding_frames(spark, sf_dir).withColumnRenamed("vec_id", "frame_id")
    dets, _best = INF.two_stage(frames, X.class_dim(spark), _corner_detector, "corner", padding=1)
    return dets.select("frame_id", "det_idx", "detector_label", "confidence", "bbox_x1", "crop_x1", "crop_x2", "crop_y2")


def _row_classifier():
    """Five logits read off the top row of the crop."""
    return lambda x: x[:, 0, 0, :5] * 4.0


@register(
    "two_stage_species",
    X.with_views("logits", "class_map") + PIXELS_SQL + GOOD_FRAMES_SQL
    + """, lg AS (SELECT vec_id, c, (CAST(v AS DOUBLE) / 255 - 0.485) / 0.229 * 4 AS y FROM px WHERE r = 0 AND c < 5),
sm AS (SELECT vec_id, c, exp(y - max(y) OVER w) / sum(exp(y - m)) OVER w AS p, row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, c) AS k
       FROM (SELECT *, max(y) OVER (PARTITION BY vec_id) AS m FROM lg) z WINDOW w AS (PARTITION BY vec_id)),
top AS (SELECT vec_id, coalesce(m.class_name, 'class_' || CAST(c AS VARCHAR)) AS species, p FROM sm LEFT JOIN class_map m ON m.idx = sm.c WHERE k = 1)
SELECT frame_id, det_idx, detector_label, species, round(p, 3) AS species_confidence, species AS best_species, round(p, 3) AS best_species_conf
FROM bx JOIN top ON top.vec_id = bx.frame_id WHERE confidence > 0.25""",
)
def q_two_stage_species(spark, sf_dir):
    """M8 whole: quality, detector, crops (padded to the frame), tensors, classifier, names and best species."""
    frames = embedding_frames(spark, sf_dir).withColumnRenamed("vec_id", "frame_id")
    dets, best = INF.two_stage(frames, X.class_dim(spark), _corner_detector, "corner", _row_classifier, "top-row", X.class_map(spark, sf_dir),
                               padding=8, size=8)
    out = dets.select("frame_id", "det_idx", "detector_label", "species", F.round(F.col("species_confidence").cast("double"), 3).alias("species_confidence"))
    return out.join(best.withColumn("best_species_conf", F.round("best_species_conf", 3)), "frame_id")
