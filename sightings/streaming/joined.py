"""T5 as a stream-stream join: frames and their boxes meet within a bounded delay, and state goes.

Boxes of a frame come after it (the detector takes time) and perhaps in several files. Both streams carry
event time; a box belongs to the frame of its id if it was made between the frame's time and
``max_delay`` later. With that range and both watermarks Spark knows when a frame or a box can no longer
find a partner and drops it, so the state holds the rows of the delay and not the history of the frames.
The events of a frame are nested by an aggregation that closes with the watermark as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators import detections as D
from ..operators import events as EV


def detection_events_stream(boxes: DataFrame, frames: DataFrame, dim: DataFrame, *, watermark: str = "30 seconds",
                            max_delay: str = "1 minute", conf: float = config.DETECT_CONF,
                            base_url: F.Column | str | None = None) -> DataFrame:
    """P3 -> J1 -> P4 -> join -> A4 / A3 -> the events of ``build_events``, one per frame with detections.

    ``frames`` needs frame_id, source, epoch_s and ``scheduled_at`` (its time as TIMESTAMP), ``boxes`` the columns
    of the detector stage and ``detected_at``. An event is out (append mode) when the watermark shows that no box
    of its frame can come; boxes later than that are dropped and counted by Spark."""
    f = frames.select("frame_id", "source", "epoch_s", "scheduled_at").withWatermark("scheduled_at", watermark)
    b = D.detections(boxes, dim, conf).withColumnRenamed("frame_id", "box_frame").withWatermark("detected_at", watermark)
    near = (F.col("detected_at") >= F.col("scheduled_at")) & (
        F.col("detected_at") <= F.col("scheduled_at") + F.expr(f"INTERVAL {max_delay}"))
    joined = f.join(b, (F.col("frame_id") == F.col("box_frame")) & near)
    aggs, cols = D.nesting(with_best=True)
    nested = joined.groupBy("scheduled_at", "frame_id", "source", "epoch_s").agg(*aggs)
    return EV.event_columns(nested.select("frame_id", "source", "epoch_s", *cols), base_url)
