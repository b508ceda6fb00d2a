"""Counters of running streams, added up by a listener and kept outside the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

COUNTER_SCHEMA = "query STRING, batch_id LONG, name STRING, counter STRING, value LONG"


class CounterListener(StreamingQueryListener):
    """Adds up the observed metrics ``name`` (``observe_counters``) of all queries of the session.

    Each micro-batch counts once, however often its progress is reported: totals are kept by query and batch. With
    ``path`` a batch's counters are also written there as one small JSON file, so that ``read_counters`` has the
    totals of runs that ended; a restarted query continues its batch numbers, and a replayed batch replaces its file."""

    def __init__(self, name: str = "run_counters", path: str | None = None) -> None:
        self.name, self.path = name, path
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.name)
        if row is None:
            return
        counters = {k: int(v or 0) for k, v in row.asDict().items()}
        if not any(counters.values()) and (str(p.id), p.batchId) in self.batches:
            return  # an idle trigger reports the batch before it again, without rows
        self.batches[str(p.id), p.batchId] = counters
        if self.path is not None:
            from ..sinks.writers import _put
            lines = [json.dumps({"query": str(p.id), "batch_id": p.batchId, "name": self.name, "counter": k, "value": v})
                     for k, v in counters.items()]
            _put(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), f"{self.path}/{p.id}-{p.batchId:09d}.json", "\n".join(lines))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict[str, int]:
        """The counters over all batches seen, and ``frames_without_detections`` where it follows from them."""
        out: dict[str, int] = {}
        for counters in self.batches.values():
            for k, v in counters.items():
                out[k] = out.get(k, 0) + v
        if {"frames_processed", "frames_with_detections"} <= out.keys():
            out["frames_without_detections"] = out["frames_processed"] - out["frames_with_detections"]
        return out


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Totals by name and counter of all batches written below ``path``."""
    return spark.read.schema(COUNTER_SCHEMA).json(path).groupBy("name", "counter").agg(F.sum("value").alias("value"))
