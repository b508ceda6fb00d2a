"""Image jobs: frame quality (P1/A11), tensorize (M1), augment (M2), crops (M7) and annotation
(M10) as pandas UDFs over Spark's ``image`` struct. Metadata tests run in SQL first, so a frame
that is obviously unusable never reaches Python; pixels are never collected or grouped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import kernels as K

IMAGE_TYPE = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("nChannels", T.IntegerType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])
QUALITY_TYPE = T.StructType([T.StructField("is_corrupt", T.BooleanType()), T.StructField("reason", T.StringType())])

CV_8UC3 = 16  # OpenCV type code Spark's image source uses for 3-channel 8-bit images


def _arrays(img: pd.DataFrame):
    for d, h, w, c in zip(img["data"], img["height"], img["width"], img["nChannels"]):
        yield K.to_array(d, h, w, c)


def _quality_udf(low_std: float, flat_ratio: float):
    @F.pandas_udf(QUALITY_TYPE)
    def quality(img: pd.DataFrame) -> pd.DataFrame:
        res = [K.frame_quality(a, low_std, flat_ratio) for a in _arrays(img)]
        return pd.DataFrame({"is_corrupt": [r[0] for r in res], "reason": [r[1] for r in res]})

    return quality


def frame_quality(frames: DataFrame, image_col: str = "image", low_std: float = config.LOW_STD,
                  flat_ratio: float = config.FLAT_RATIO) -> DataFrame:
    """Adds ``is_corrupt`` and ``reason``. Undecodable / empty images are decided in SQL."""
    img = F.col(image_col)
    # unknown sizes or bytes are no frame either
    empty = F.coalesce(img.isNull() | (img["height"] <= 0) | (img["width"] <= 0) | (F.length(img["data"]) == 0), F.lit(True))
    q = _quality_udf(low_std, flat_ratio)(img)
    out = frames.withColumn("_q", F.when(~empty, q))
    return out.withColumn("is_corrupt", F.when(empty, F.lit(True)).otherwise(F.col("_q.is_corrupt"))) \
        .withColumn("reason", F.when(empty, F.lit("empty frame")).otherwise(F.col("_q.reason"))).drop("_q")


def tensorize(df: DataFrame, image_col: str = "image", size: int = config.INPUT_SIZE) -> DataFrame:
    """M1: adds ``tensor`` ARRAY<FLOAT> (CHW, 3*S*S) for classifier input."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def tens(img: pd.DataFrame) -> pd.Series:
        return pd.Series([None if a is None else K.tensorize(a, size) for a in _arrays(img)])

    return df.withColumn("tensor", tens(F.col(image_col)))


def augment(df: DataFrame, seed: int, epoch: int | F.Column, image_col: str = "image", path_col: str = "path",
            size: int = config.INPUT_SIZE, train: bool = True) -> DataFrame:
    """M2: adds ``tensor``; each row's generator is seeded by ``xxhash64(seed, path, epoch)``. ``epoch`` may be an INT
    column, so that one job makes the samples of many epochs."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def aug(img: pd.DataFrame, key: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else K.augment(a, size, int(k), train)
                          for a, k in zip(_arrays(img), key)])

    key = F.xxhash64(F.lit(int(seed)), F.col(path_col), F.lit(epoch) if isinstance(epoch, int) else epoch)
    return df.withColumn("tensor", aug(F.col(image_col), key))


def _image_struct(arrs, origins) -> pd.DataFrame:
    rows = {"origin": [], "height": [], "width": [], "nChannels": [], "mode": [], "data": []}
    for a, o in zip(arrs, origins):
        if a is None or a.size == 0:
            vals = (o, -1, -1, -1, -1, b"")
        else:
            vals = (o, a.shape[0], a.shape[1], 3, CV_8UC3, np.ascontiguousarray(a).tobytes())
        for k, v in zip(rows, vals):
            rows[k].append(v)
    return pd.DataFrame(rows)


def crop_images(frames: DataFrame, dets: DataFrame, image_col: str = "image") -> DataFrame:
    """M7: each detection's crop window (P5 columns) sliced from its frame; adds ``crop`` (image struct).

    Windows are nested per frame first, so a frame's pixels meet them once, however many crops it has. With frames
    stored by ``files.store_frames`` the pixels don't move: only the narrow detections are dealt to their buckets."""
    cols = [c for c in dets.columns if c != "frame_id"]
    per = dets.groupBy("frame_id").agg(F.collect_list(F.struct(*cols)).alias("_d"))
    j = per.join(frames.select("frame_id", image_col), on="frame_id")

    @F.pandas_udf(T.ArrayType(IMAGE_TYPE))
    def cut(img: pd.DataFrame, windows: pd.Series) -> pd.Series:
        out = []
        for a, origin, boxes in zip(_arrays(img), img["origin"], windows):
            crops = [None if a is None else K.crop(a, *(int(v) for v in box)) for box in boxes]
            out.append(_image_struct(crops, [origin] * len(crops)).to_dict("records"))
        return pd.Series(out)

    corners = F.transform("_d", lambda d: F.array(*[d[f"crop_{c}"].cast("int") for c in ("x1", "y1", "x2", "y2")]))
    both = j.select("frame_id", F.arrays_zip(F.col("_d").alias("d"), cut(F.col(image_col), corners).alias("crop")).alias("_z"))
    flat = both.select("frame_id", F.explode("_z").alias("z"))
    return flat.select("frame_id", *[F.col(f"z.d.{c}").alias(c) for c in cols], F.col("z.crop").alias("crop"))


def annotate(frames: DataFrame, dets: DataFrame, image_col: str = "image") -> DataFrame:
    """Per frame with detections, the frame with a 2-px green box per detection (detector
    order); the label text stays a column (``labels``, F5 annotation form). Pixels move as in ``crop_images``."""
    from ..functions import scalars as S

    per = dets.groupBy("frame_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "det_idx", F.col("bbox").alias("bbox"),
            S.detection_label("detector_label", "confidence", "species", "species_confidence",
                              style="annotation").alias("label")))).alias("_d"))
    j = per.join(frames.select("frame_id", image_col), on="frame_id")

    @F.pandas_udf(IMAGE_TYPE)
    def draw(img: pd.DataFrame, boxes: pd.Series) -> pd.DataFrame:
        arrs = [None if a is None else K.draw_boxes(a, [list(b) if b is not None else None for b in bs])
                for a, bs in zip(_arrays(img), boxes)]
        return _image_struct(arrs, img["origin"])

    return j.select(
        "frame_id",
        draw(F.col(image_col), F.transform("_d", lambda d: d["bbox"])).alias("annotated"),
        F.transform("_d", lambda d: d["label"]).alias("labels"),
    )
