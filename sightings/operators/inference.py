"""Batch inference (M3) and the two-stage frame job (M8).

Models are injected as factories ``() -> callable`` and loaded once per Python worker (cached by
key), the way the reference keeps its sessions loaded. M8 takes each frame once: quality, detector,
crops and classifier run in one pass over its pixels, and only narrow rows come out, which are
written once and read by every sink. A model that fails on a row leaves its error text there.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import config
from ..functions import kernels as K
from ..session import written
from . import detections as D
from . import images as IM
from . import vectors as VE

BOX_TYPE = T.ArrayType(T.StructType([
    T.StructField("cls_id", T.IntegerType()),
    T.StructField("confidence", T.FloatType()),
    T.StructField("x1", T.DoubleType()), T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()), T.StructField("y2", T.DoubleType()),
]))


_MODELS: dict[str, Callable] = {}  # per Python worker: model key -> loaded model


def _load(key: str, factory: Callable[[], Callable]) -> Callable:
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def numpy_linear_factory(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A classifier from ``.npz`` with ``W`` (classes x features) and ``b``: logits = x W^T + b."""
    def make():
        z = np.load(path)
        w, b = z["W"].astype(np.float32), z["b"].astype(np.float32)
        return lambda x: x.reshape(len(x), -1) @ w.T + b

    return make


def onnx_factory(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A classifier from an ONNX file with input ``input`` of shape [N, 3, S, S] (CPU provider)."""
    def make():
        import onnxruntime as ort  # optional dependency

        sess = ort.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = sess.get_inputs()[0].name
        return lambda x: sess.run(None, {name: x.astype(np.float32)})[0]

    return make


def onnx_input_size(path: str, default: int = config.INPUT_SIZE) -> int:
    """The side of the image that the model asks for: the first of its spatial axes (behind batch and channel) with a
    fixed size. ``default`` if all are symbolic or there is no model to ask."""
    try:
        import onnxruntime as ort

        spatial = ort.InferenceSession(path, providers=["CPUExecutionProvider"]).get_inputs()[0].shape[2:]
    except Exception:
        spatial = []
    return next((side for side in spatial if isinstance(side, int) and side > 0), default)


def predict(df: DataFrame, factory: Callable[[], Callable], key: str, input_col: str = "tensor",
            shape: tuple[int, ...] | None = None, out_col: str = "logits", error_col: str | None = None,
            batch_size: int = config.BATCH_SIZE) -> DataFrame:
    """M3: batch inference of ``input_col`` (ARRAY<FLOAT>) -> ``out_col`` ARRAY<FLOAT>.

    ``batch_size`` rows run together; if the batch fails, rows are retried one by one and a failing
    row gets null, its error text in ``error_col`` if that is asked for.
    """
    kind = T.StructType([T.StructField("y", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _load(key, factory)

        def run(rows: list) -> list:
            x = np.stack([np.asarray(r, dtype=np.float32) for r in rows])
            y = np.asarray(model(x if shape is None else x.reshape((len(rows), *shape))), dtype=np.float32)
            return [v.reshape(-1).tolist() for v in y]

        for s in batches:
            out: list = [None] * len(s)
            errors: list = [None] * len(s)
            known = [i for i, v in enumerate(s) if v is not None]
            for at in range(0, len(known), batch_size):
                part = known[at:at + batch_size]
                try:
                    for i, y in zip(part, run([s.iloc[i] for i in part])):
                        out[i] = y
                except Exception:
                    for i in part:
                        try:
                            out[i] = run([s.iloc[i]])[0]
                        except Exception as e:
                            errors[i] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"y": out, "error": errors})

    got = df.withColumn("_m3", infer.asNondeterministic()(F.col(input_col))).withColumn(out_col, F.col("_m3.y"))
    return (got.withColumn(error_col, F.col("_m3.error")) if error_col else got).drop("_m3")


def predict_batched(df: DataFrame, factory: Callable[[], Callable], shape: tuple[int, ...],
                    input_col: str = "tensor", batch_size: int = config.BATCH_SIZE,
                    out_col: str = "logits") -> DataFrame:
    """M3 on Spark's ``predict_batch_udf``: the model is made once per Python worker and fed
    ``batch_size`` rows at a time. Unlike ``predict`` a failing batch fails the task (no per-row
    isolation), so use it for models that do not raise on bad input. ``shape`` is the tensor shape
    of one row, e.g. (3, S, S)."""
    from pyspark.ml.functions import predict_batch_udf

    def make():
        model = factory()
        return lambda x: np.asarray(model(x), dtype=np.float32)

    udf = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=[list(shape)])
    return df.withColumn(out_col, udf(F.col(input_col)))


def detect(frames: DataFrame, factory: Callable[[], Callable], key: str, image_col: str = "image") -> DataFrame:
    """Detector stage as a UDF: frame -> ARRAY<box>; then one row per box (posexplode gives the
    detector order ``det_idx``). The detector callable maps a BGR array to (cls, conf, x1, y1, x2, y2)
    tuples. A frame whose detection fails has one row with null box columns and the ``error`` text;
    other rows have a null ``error``."""

    @F.pandas_udf(T.StructType([T.StructField("boxes", BOX_TYPE), T.StructField("error", T.StringType())]))
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _load(key, factory)
        for img in batches:
            res, errors = [], []
            for a in IM._arrays(img):
                try:
                    boxes = [] if a is None else list(model(a))
                    res.append([{"cls_id": int(c), "confidence": float(p), "x1": float(x1), "y1": float(y1),
                                 "x2": float(x2), "y2": float(y2)} for c, p, x1, y1, x2, y2 in boxes])
                    errors.append(None)
                except Exception as e:
                    res.append([])
                    errors.append(f"detector: {type(e).__name__}: {e}")
            yield pd.DataFrame({"boxes": res, "error": errors})

    found = frames.withColumn("_r", run.asNondeterministic()(F.col(image_col)))
    one_if_failed = F.when(F.col("_r.error").isNotNull(), F.array(F.lit(None).cast(BOX_TYPE.elementType))).otherwise(F.col("_r.boxes"))
    return found.select("frame_id", "_r.error", F.posexplode(one_if_failed).alias("det_idx", "_b")).select(
        "frame_id", F.col("det_idx").cast("int"), "_b.*", "error")


_DETECTION = ("struct<det_idx:int,cls_id:int,confidence:float,x1:double,y1:double,x2:double,y2:double,logits:array<float>,"
              "error:string,crop:struct<height:int,width:int,data:binary>>")
PASS_SCHEMA = ("frame_id bigint, width int, height int, is_corrupt boolean, reason string, error string, detect_ms double, "
               f"classify_ms double, found array<{_DETECTION}>, annotated struct<height:int,width:int,data:binary>")
MAX_CLASSES = 10_000  # a detector's class list; its ids go to the tasks


def frame_pass(frames: DataFrame, class_ids: set[int], detector: Callable[[], Callable], detector_key: str,
               classifier: Callable[[], Callable] | None = None, classifier_key: str = "classifier",
               conf: float = config.DETECT_CONF, padding: int = config.DETECT_PADDING, size: int = config.INPUT_SIZE,
               batch_size: int = config.BATCH_SIZE, keep_crops: bool = False, draw: bool = False,
               carry: Sequence[str] = ()) -> DataFrame:
    """One row of ``PASS_SCHEMA`` per frame (frame_id, image): P1, the detector once, P2-P5 on its boxes,
    M7 + M1 on the crops and M3 in batches of ``batch_size``. Boxes that P2 or P3 drop are left out. With
    ``draw`` frames that keep a box are drawn on as well (M10), while their pixels are here. The columns
    ``carry`` of the frames go along, so that nothing has to be joined back to the pixels."""

    def one(img, detect, classify) -> dict:
        height, width = (img or {}).get("height"), (img or {}).get("width")
        out = {"width": width, "height": height, "is_corrupt": True, "reason": "empty frame", "error": None,
               "detect_ms": None, "classify_ms": None, "found": [], "annotated": None}
        if not img or not img["data"] or not height or not width or height <= 0 or width <= 0:
            return out
        pixels = K.to_array(img["data"], height, width, img["nChannels"])
        out["is_corrupt"], out["reason"] = K.frame_quality(pixels, config.LOW_STD, config.FLAT_RATIO)
        if out["is_corrupt"]:
            return out
        began = time.perf_counter()
        try:
            boxes = list(detect(pixels))
        except Exception as e:  # a failing model must not stop the other frames
            out["error"] = f"detector: {type(e).__name__}: {e}"
            return out
        out["detect_ms"] = (time.perf_counter() - began) * 1000
        crops = []
        for i, (cls, score, *corners) in enumerate(boxes):
            if not (np.float32(score) > conf and int(cls) in class_ids):
                continue
            x1, y1, x2, y2 = (int(v) for v in corners)
            crops.append(K.crop(pixels, max(0, x1 - padding), max(0, y1 - padding), min(width, x2 + padding), min(height, y2 + padding)))
            c = crops[-1]
            out["found"].append(dict(zip(("det_idx", "cls_id", "confidence", "x1", "y1", "x2", "y2"), (i, int(cls), float(score), *map(float, corners))),
                                     logits=None, error=None,
                                     crop={"height": c.shape[0], "width": c.shape[1], "data": c.tobytes()} if keep_crops else None))
        if classify is not None and crops:
            began = time.perf_counter()
            for at in range(0, len(crops), batch_size):
                _classify(classify, crops[at:at + batch_size], out["found"][at:at + batch_size], size)
            out["classify_ms"] = (time.perf_counter() - began) * 1000
        if draw and out["found"]:
            drawn = K.draw_boxes(pixels, [[int(d[c]) for c in ("x1", "y1", "x2", "y2")] for d in out["found"]])
            out["annotated"] = {"height": height, "width": width, "data": np.ascontiguousarray(drawn).tobytes()}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = _load(detector_key, detector)
        classify = _load(classifier_key, classifier) if classifier is not None else None
        for b in batches:
            for i in range(len(b)):  # a frame at a time: its pixels are the largest thing here
                row = {"frame_id": b["frame_id"][i].as_py(), **one(b["image"][i].as_py(), detect, classify)}
                made = pa.RecordBatch.from_pylist([row], arrow)
                yield pa.RecordBatch.from_arrays([*made.columns, *(b[c].slice(i, 1) for c in carry)], names=[*arrow.names, *carry])

    schema = T.StructType.fromDDL(PASS_SCHEMA)
    arrow = to_arrow_schema(schema)
    whole = T.StructType([*schema.fields, *(frames.schema[c] for c in carry)])
    return frames.select("frame_id", "image", *carry).mapInArrow(run, whole)


def _classify(model: Callable, crops: list[np.ndarray], found: list[dict], size: int) -> None:
    """Logits of the crops; if the batch fails, one by one, and a failing crop keeps its error."""
    def logits(part: list[np.ndarray]) -> np.ndarray:
        x = np.stack([K.tensorize(c, size).reshape(3, size, size) for c in part])
        return np.asarray(model(x), dtype=np.float32).reshape(len(part), -1)

    try:
        for row, y in zip(found, logits(crops)):
            row["logits"] = y.tolist()
    except Exception:
        for row, c in zip(found, crops):
            try:
                row["logits"] = logits([c])[0].tolist()
            except Exception as e:
                row["error"] = f"classifier: {type(e).__name__}: {e}"


def two_stage(frames: DataFrame, dim: DataFrame, detector: Callable[[], Callable], detector_key: str,
              classifier: Callable[[], Callable] | None = None, classifier_key: str | None = None,
              class_map: DataFrame | None = None, conf: float = config.DETECT_CONF,
              padding: int = config.DETECT_PADDING, size: int = config.INPUT_SIZE,
              keep_crops: bool = False) -> tuple[DataFrame, DataFrame]:
    """M8: ``run_two_stage`` without the frame table: (detections, best)."""
    dets, best, _ = run_two_stage(frames, dim, detector, detector_key, classifier, classifier_key, class_map, conf, padding, size, keep_crops)
    return dets, best


def run_two_stage(frames: DataFrame, dim: DataFrame, detector: Callable[[], Callable], detector_key: str,
                  classifier: Callable[[], Callable] | None = None, classifier_key: str | None = None,
                  class_map: DataFrame | None = None, conf: float = config.DETECT_CONF,
                  padding: int = config.DETECT_PADDING, size: int = config.INPUT_SIZE,
                  keep_crops: bool = False, draw: bool = False, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M8: P1 -> detect -> P2/P3 -> P4/P5 -> M7 -> M1 -> M3 -> M4 -> A3. The classifier is optional.

    ``frames(frame_id, image)``; returns ``(detections, best, frame table)``, the last with quality,
    reason, error and timings of every frame, corrupt ones included, the columns ``carry`` of the frames, and with
    ``draw`` the ``annotated`` frame. The models run when this is called,
    once a frame, however often the results are read: they are written to the shared checkpoint folder.
    """
    spark = frames.sparkSession
    ids = {r.cls_id for r in dim.select("cls_id").limit(MAX_CLASSES + 1).collect()}
    if len(ids) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} detector classes")
    seen = written(frame_pass(frames, ids, detector, detector_key, classifier, classifier_key or "classifier", conf, padding, size,
                              keep_crops=keep_crops, draw=draw, carry=carry), "frame-pass")
    boxes = seen.select("frame_id", F.col("width").alias("_w"), F.col("height").alias("_h"), F.inline("found"))
    dets = D.crop_window(D.detections(boxes, dim, conf), F.col("_w"), F.col("_h"), padding).drop("_w", "_h")
    if classifier is None:
        dets = dets.drop("logits").withColumn("species", F.lit(None).cast("string")).withColumn("species_confidence", F.lit(None).cast("float"))
    else:
        names = class_map if class_map is not None else spark.createDataFrame([], "idx int, class_name string")
        dets = VE.top1(dets, names).withColumn("species_confidence", F.col("top_prob").cast("float")).withColumn(
            "species", F.when(F.col("top_prob").isNotNull(), F.col("species"))).drop("logits", "top_idx", "top_prob")
    dets = dets if keep_crops else dets.drop("crop")
    counted = seen.withColumn("detections", F.size("found")).drop("found", "width", "height", *([] if draw else ["annotated"]))
    return dets, D.best_species(dets), counted


def tensor_of(bgr: np.ndarray, size: int = config.INPUT_SIZE) -> np.ndarray:
    """M1 for a single array (driver-side helper for tests and tools)."""
    return K.tensorize(bgr, size)
