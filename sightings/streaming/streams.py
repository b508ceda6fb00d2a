"""Structured Streaming versions of the runtime: sources (S6), capture ticks (T1), conflation (T2),
stateful announcement (T3) and failure monitor (T4), per-batch detections (T5), live state (T6),
event de-duplication (T7), windowed species counts (T8) and run counters (T9).

T3 and T4 follow the batch rules of ``operators.alerts`` run by run: a change of species (a success
after failures) begins a run, whose first row always emits, and within a run a cooldown decides. So
the state of a camera is the run it is in, the time of that run's last emission, and (T3) one song
clock per species; a clock that hasn't run yet is absent, not zero. Input is expected in event-time
order per camera inside the stream; rows that arrive out of order should pass a watermark buffer
first. Rows without a time are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config
from ..operators import events as EV
from ..operators.images import IMAGE_TYPE
from ..operators.rules import announce_rows, failure_rows
from ..sources.files import with_frame_identity

ATTEMPT_SCHEMA = "attempt_id LONG, source STRING, ts TIMESTAMP, ok BOOLEAN"
BEST_SCHEMA = "frame_id LONG, source STRING, epoch_s DOUBLE, best_species STRING, best_species_conf DOUBLE"


# ---- S6 sources ---------------------------------------------------------------------------

def stream_frames(spark: SparkSession, path: str, max_files: int | None = None, source: str | None = None) -> DataFrame:
    """New image files as frames with identity and time (S1's columns); undecodable files carry a
    ``reason``."""
    r = spark.readStream.format("image").schema(T.StructType([T.StructField("image", IMAGE_TYPE)]))
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return with_frame_identity(r.load(path), source)


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """S6 + S3: event JSON lines of both versions -> (events, rejects) streams."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return EV.read_events(r.load(path))


def stream_table(spark: SparkSession, path: str, schema: "str | T.StructType", fmt: str = "parquet",
                 max_files: int | None = None) -> DataFrame:
    """An unbounded table (attempts, best frames, boxes) from files with a fixed schema."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path)


def stream_attempts(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Capture attempts ``(attempt_id, source, ts, ok)`` as an unbounded table."""
    return stream_table(spark, path, ATTEMPT_SCHEMA, fmt, max_files)


def stream_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Event messages from Kafka as a ``value`` string column (needs the Kafka connector)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).load().select(F.col("value").cast("string").alias("value")))


# ---- T1 / T2 ---------------------------------------------------------------------------------

def capture_trigger(interval_s: float = config.CAPTURE_INTERVAL_S) -> dict:
    """Keyword arguments for ``writeStream.trigger``: one micro-batch per capture interval."""
    return {"processingTime": f"{interval_s} seconds"}


def conflate_stream(frames: DataFrame, slot_s: float, watermark: str, t_col: str = "scheduled_at",
                    key: str = "source", tie: str = "frame_id") -> DataFrame:
    """The latest frame per (source, slot) in event time (ties by ``tie``, as in batch); a slot is emitted once the watermark
    passes its end (append mode), older frames of the slot are dropped."""
    cols = [c for c in frames.columns]
    return (
        frames.withWatermark(t_col, watermark)
        .groupBy(key, F.window(t_col, f"{slot_s} seconds").alias("slot"))
        .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(t_col, tie)).alias("_l"),
             F.count(F.lit(1)).alias("frames_in_slot"))
        .select(F.col("slot.start").alias("slot_start"), "frames_in_slot", *[F.col(f"_l.{c}").alias(c) for c in cols if c != key], key)
    )


def _released(waiting: list, new: pd.DataFrame, columns: list[str], time: str, tie: str, state: GroupState, timed: bool) -> tuple[pd.DataFrame, list]:
    """The rows that are final, in order, and those that still wait for the watermark."""
    rows = pd.concat([pd.DataFrame(waiting, columns=columns), new[columns]]) if waiting else new[columns]
    rows = rows.sort_values([time, tie], kind="stable", ignore_index=True)
    if not timed:
        return rows, []
    final = rows[time] <= state.getCurrentWatermarkMs() / 1000.0
    later = rows[~final]
    if len(later):
        state.setTimeoutTimestamp(int(later[time].iloc[0] * 1000))
    return rows[final], json.loads(later.to_json(orient="values", double_precision=15))


# ---- T3 announce ------------------------------------------------------------------------------

ANNOUNCE_OUT = ("frame_id LONG, source STRING, epoch_s DOUBLE, best_species STRING, changed BOOLEAN, "
                "speak BOOLEAN, play_song BOOLEAN")
ANNOUNCE_STATE = "species STRING, spoken DOUBLE, songs STRING, waiting STRING"


def announce_stream(best: DataFrame, min_conf: float = config.MIN_ALERT_CONF,
                    repeat_s: float = config.SAME_SPECIES_REPEAT_S, song_s: float = config.SONG_EVERY_S,
                    songs_enabled: bool = config.SONGS_ENABLED, watermark: str | None = None) -> DataFrame:
    """W6 with state per source (the species shown, when it was last spoken, song clocks).

    Without ``watermark`` rows are applied as they arrive (input in order per source). With a
    ``watermark`` (e.g. "30 seconds") rows wait in state until the event-time watermark passes them
    and are then applied in (epoch_s, frame_id) order, so out-of-order arrival within the delay gives
    the batch result; rows later than the watermark are dropped by Spark.
    """
    timed = watermark is not None
    src = best.where(F.col("best_species").isNotNull() & (F.col("best_species_conf") >= F.lit(float(min_conf)))
                     & F.col("epoch_s").isNotNull())
    if timed:
        src = src.withColumn("_et", F.timestamp_seconds("epoch_s")).withWatermark("_et", watermark)
    columns = ["frame_id", "source", "epoch_s", "best_species"]

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        species, spoken, songs, waiting = state.get if state.exists else (None, None, "{}", "[]")
        clocks = json.loads(songs)
        new = pd.concat([pd.DataFrame(columns=columns), *([] if state.hasTimedOut else [p[columns] for p in pdfs])])
        ready, later = _released(json.loads(waiting), new, columns, "epoch_s", "frame_id", state, timed)
        out, (species, spoken) = announce_rows(ready, (species, spoken), clocks, repeat_s, song_s, songs_enabled)
        state.update((species, spoken, json.dumps(clocks), json.dumps(later)))
        yield out

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return src.groupBy("source").applyInPandasWithState(step, ANNOUNCE_OUT, ANNOUNCE_STATE, "append", timeout)


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def announce_stream_tws(best: DataFrame, min_conf: float = config.MIN_ALERT_CONF,
                        repeat_s: float = config.SAME_SPECIES_REPEAT_S, song_s: float = config.SONG_EVERY_S,
                        songs_enabled: bool = config.SONGS_ENABLED) -> DataFrame:
    """T3 on ``transformWithStateInPandas``: a value state (the run) and a map state (song clocks) per
    source, kept in the RocksDB state store (``spark.sql.streaming.stateStore.providerClass`` must
    name it). Input in order per source."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Announce(StatefulProcessor):
        def init(self, handle) -> None:
            self.run = handle.getValueState("run", "species STRING, spoken DOUBLE")
            self.songs = handle.getMapState("songs", "species STRING", "t DOUBLE")

        def handleInputRows(self, key, rows, timerValues):
            new = pd.concat(list(rows)).sort_values(["epoch_s", "frame_id"], kind="stable", ignore_index=True)
            seen = new["best_species"].unique().tolist()
            clocks = {n: self.songs.getValue((n,))[0] for n in seen if self.songs.containsKey((n,))}
            run = tuple(self.run.get()) if self.run.exists() else (None, None)
            out, run = announce_rows(new, run, clocks, repeat_s, song_s, songs_enabled)
            for name, t in clocks.items():
                self.songs.updateValue((name,), (t,))
            self.run.update(run)
            yield out

        def close(self) -> None:
            pass

    src = best.where(F.col("best_species").isNotNull() & (F.col("best_species_conf") >= F.lit(float(min_conf)))
                     & F.col("epoch_s").isNotNull())
    return src.groupBy("source").transformWithStateInPandas(
        statefulProcessor=Announce(), outputStructType=ANNOUNCE_OUT, outputMode="Append", timeMode="None")


# ---- T4 failure monitor -------------------------------------------------------------------------

FAILURE_OUT = "attempt_id LONG, source STRING, fail_n LONG, backoff_s DOUBLE, logged BOOLEAN"
FAILURE_STATE = "failures LONG, logged_at DOUBLE, waiting STRING"


def failure_monitor_stream(attempts: DataFrame, quiet_s: float = config.FAILURE_LOG_QUIET_S,
                           watermark: str | None = None) -> DataFrame:
    """T4: W4 with state per source (consecutive failures, time of the last printed failure).

    With ``watermark`` attempts wait in state until the event-time watermark passes them and are
    then applied in (ts, attempt_id) order, as in ``announce_stream``.
    """
    timed = watermark is not None
    src = attempts.where(F.col("ts").isNotNull())
    src = src.withWatermark("ts", watermark) if timed else src
    columns = ["t", "attempt_id", "source", "ok"]

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, logged_at, waiting = state.get if state.exists else (0, None, "[]")
        frames = [pd.DataFrame(columns=columns)]
        for pdf in [] if state.hasTimedOut else pdfs:
            # epoch seconds from integer microseconds, exactly as the batch operator computes them
            micros = pd.to_datetime(pdf["ts"], utc=True).astype("datetime64[us, UTC]").astype("int64")
            frames.append(pdf.assign(t=micros / 1e6)[columns])
        ready, later = _released(json.loads(waiting), pd.concat(frames), columns, "t", "attempt_id", state, timed)
        out, failures, logged_at = failure_rows(ready, int(failures), logged_at, quiet_s)
        state.update((int(failures), logged_at, json.dumps(later)))
        yield out

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return src.groupBy("source").applyInPandasWithState(step, FAILURE_OUT, FAILURE_STATE, "append", timeout)


# ---- T5 / T6 / T7 / T8 / T9 ----------------------------------------------------------------------

def detections_batch_fn(frames: DataFrame, dim: DataFrame, on_events, conf: float = config.DETECT_CONF):
    """T5: ``foreachBatch`` over a stream of boxes whose frames arrive whole in one batch: P3 -> J1
    -> P4 -> A3 -> events, handed to ``on_events(events_df, batch_id)`` (K1/K2/K3 writers)."""
    from ..operators import detections as D

    def run(boxes: DataFrame, batch_id: int) -> None:
        dets = D.detections(boxes, dim, conf)
        on_events(EV.build_events(frames, dets), batch_id)

    return run


def detections_stream(boxes: DataFrame, frames: DataFrame, dim: DataFrame, on_events,
                      conf: float = config.DETECT_CONF):
    """T5: a configured ``DataStreamWriter`` over a stream of boxes; each micro-batch runs the
    detection operators and hands the events to ``on_events`` (start it with ``.start()``)."""
    return boxes.writeStream.foreachBatch(detections_batch_fn(frames, dim, on_events, conf))


def latest_state_stream(events: DataFrame, key: str = "source") -> DataFrame:
    """K3 as a live table: newest event per source (update mode)."""
    cols = [c for c in events.columns]
    return events.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct("epoch_s", "event_id")).alias("_l")
    ).select("_l.*")



def dedupe_events(events: DataFrame, ts_col: str, watermark: str) -> DataFrame:
    """Drop repeated ``event_id`` deliveries (QoS >= 1) within the watermark."""
    return events.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(["event_id"])


def species_counts_stream(rows: DataFrame, ts_col: str, watermark: str, window: str | None = None,
                          slide: str | None = None, session_gap: str | None = None,
                          species_col: str = "best_species") -> DataFrame:
    """Tumbling / sliding / session counts per species; rows later than the watermark are
    dropped (Spark reports them as ``numRowsDroppedByWatermark``)."""
    w = rows.withWatermark(ts_col, watermark)
    if session_gap:
        win = F.session_window(ts_col, session_gap)
    else:
        win = F.window(ts_col, window, slide) if slide else F.window(ts_col, window)
    return w.groupBy(win.alias("w"), species_col).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), species_col, "n")


def observe_counters(frames: DataFrame, has_detection_col: str = "has_detection", name: str = "run_counters"):
    """T9 / A8 per micro-batch: processed frames and frames with detections as observed metrics
    (read them from ``query.lastProgress['observedMetrics']`` or a listener)."""
    return frames.observe(
        name,
        F.count(F.lit(1)).alias("frames_processed"),
        F.sum(F.col(has_detection_col).cast("long")).alias("frames_with_detections"),
    )
