"""Output paths: crop file names with first-free collision numbering (W2) and retention of the
newest N annotated frames (W3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S

_PATH_RE = r"^(.*)/([^/]+)/([0-9]{6}_[0-9]{6})(_([0-9]+))?\.jpg$"


def parse_crop_paths(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Existing crop files -> (safe_label, ts, num) where ``<ts>.jpg`` is number 0."""
    p = F.col(path_col)
    num = F.regexp_extract(p, _PATH_RE, 5)
    return paths.where(p.rlike(_PATH_RE)).select(
        F.regexp_extract(p, _PATH_RE, 2).alias("safe_label"),
        F.regexp_extract(p, _PATH_RE, 3).alias("ts"),
        F.when(num == "", F.lit(0)).otherwise(num.cast("int")).cast("long").alias("num"),
    )


def crop_paths(dets: DataFrame, root: str = "crops", existing: DataFrame | None = None) -> DataFrame:
    """``<root>/<safe label>/<ts>.jpg``, then ``<ts>_1.jpg``, ``<ts>_2.jpg`` ... in processing order
    (epoch_s, frame_id, det_idx); numbers already taken by ``existing`` files are skipped (first free).

    ``dets`` needs frame_id, det_idx, epoch_s, species, detector_label. Adds ``safe_label``, ``ts``,
    ``crop_num`` and ``crop_path``. One (label, second) holds the crops of one second, so a window per
    key is small, and only narrow rows are sorted: the numbers join the other columns back by
    (frame_id, det_idx). The k-th new file of a key (0-based) gets the k-th free number
    ``x = k + #{existing e : e - rank(e) <= k}``.
    """
    base = dets.withColumn("safe_label", S.safe_label(S.display_label("species", "detector_label"))) \
        .withColumn("ts", S.file_ts(F.timestamp_seconds("epoch_s")))
    keys = ["safe_label", "ts"]
    w = Window.partitionBy(*keys).orderBy("epoch_s", "frame_id", "det_idx")
    ranked = base.select(*keys, "epoch_s", "frame_id", "det_idx").withColumn("_k", (F.row_number().over(w) - 1).cast("long"))
    if existing is None:
        nums = ranked.select("frame_id", "det_idx", F.col("_k").alias("crop_num"))
    else:
        we = Window.partitionBy(*keys).orderBy("num")
        ex = parse_crop_paths(existing).distinct().withColumn("_er", F.row_number().over(we) - 1)
        ex = ex.select(*keys, (F.col("num") - F.col("_er")).alias("_g"), F.lit(1).alias("_isex"), F.lit(0).alias("_ord"), "num",
                       F.lit(None).cast("long").alias("frame_id"), F.lit(None).cast("int").alias("det_idx"))
        new = ranked.select(*keys, F.col("_k").alias("_g"), F.lit(0).alias("_isex"), F.lit(1).alias("_ord"),
                            F.lit(None).cast("long").alias("num"), "frame_id", "det_idx")
        # an existing file with gap count g <= k sorts before the new row k
        wu = Window.partitionBy(*keys).orderBy("_g", "_ord", "num", "frame_id", "det_idx")
        s = ex.unionByName(new).withColumn("_nex", F.sum("_isex").over(wu.rowsBetween(Window.unboundedPreceding, 0)))
        nums = s.where(F.col("_isex") == 0).select("frame_id", "det_idx", (F.col("_g") + F.col("_nex")).cast("long").alias("crop_num"))
    numbered = base.join(nums, on=["frame_id", "det_idx"])
    suffix = F.when(F.col("crop_num") == 0, F.lit("")).otherwise(F.concat(F.lit("_"), F.col("crop_num").cast("string")))
    return numbered.withColumn(
        "crop_path", F.concat(F.lit(f"{root}/"), F.col("safe_label"), F.lit("/"), F.col("ts"), suffix, F.lit(".jpg"))
    )


def ranked_files(files: DataFrame, keys: list[str], mtime_col: str, path_col: str,
                 n: int = config.KEEP_LAST_ANNOTATED) -> DataFrame:
    """W3 in one pass: each file with ``rank`` (0 = newest of its key) and ``kept``; nulls in a key are
    a key of their own. ``n <= 0`` keeps all."""
    w = Window.partitionBy(*keys).orderBy(F.col(mtime_col).desc(), F.col(path_col).desc())
    rank = (F.row_number().over(w) - 1).cast("long")
    return files.withColumn("rank", rank).withColumn("kept", F.col("rank") < n if n > 0 else F.lit(True))


def retain_last_n(files: DataFrame, keys: list[str], mtime_col: str, path_col: str,
                  n: int = config.KEEP_LAST_ANNOTATED) -> tuple[DataFrame, DataFrame]:
    """Newest ``n`` files per key by modification time survive (``n <= 0`` keeps all).

    Returns ``(kept, expired)``; ``kept`` has ``rank`` 0 = newest. The filter on the row number lets
    Spark cut each task's rows to ``n`` per key before the exchange, so a busy key stays small.
    """
    if n <= 0:
        return files.withColumn("rank", F.lit(None).cast("long")), files.limit(0)
    w = Window.partitionBy(*keys).orderBy(F.col(mtime_col).desc(), F.col(path_col).desc())
    kept = files.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
        .withColumn("rank", (F.col("rank") - 1).cast("long"))
    expired = ranked_files(files, keys, mtime_col, path_col, n).where(~F.col("kept")).drop("rank", "kept")
    return kept, expired
