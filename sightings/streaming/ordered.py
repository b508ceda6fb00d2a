"""Ordered work over late data on ``transformWithStateInPandas`` (T3, T4, and W9's visits).

Rows wait until the watermark has passed them and are then applied in time order. They wait in slots
of ``slot_s`` seconds: a map state from slot to its rows, and one event-time timer a slot. A batch reads
and writes only the slots that it adds rows to or that its watermark closes, however many rows wait.
What a rule keeps of the past (the run, the song clocks, the open visit) are states of their own.

The session must use the RocksDB state store (``ROCKSDB_PROVIDER``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .. import config
from .streams import ANNOUNCE_OUT, FAILURE_OUT, announce_rows, failure_rows

SLOT_S = 30.0
VISIT_OUT = ("source STRING, visit_no LONG, species STRING, start_epoch_s DOUBLE, end_epoch_s DOUBLE, frames LONG, "
             "max_conf DOUBLE")


class InOrder(StatefulProcessor):
    """Collects rows by slot and hands each slot, sorted, to ``apply`` once no row of it can come.

    ``fields`` are the columns that are kept, as (name, type), ``time`` (epoch seconds) and ``tie`` their order."""

    fields: tuple[tuple[str, str], ...]
    time: str
    tie: str

    def __init__(self, slot_s: float) -> None:
        self.slot_s = slot_s

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot LONG", ", ".join(f"{n} ARRAY<{t}>" for n, t in self.fields))

    def closing_time(self, slot: int) -> int:
        """When a slot ends, in milliseconds."""
        return int(round((slot + 1) * self.slot_s * 1000))

    def slot_of(self, t: float) -> int:
        return int(np.floor(t / self.slot_s))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [n for n, _ in self.fields]
        new = pd.concat([r[names] for r in rows])
        slots = np.floor(new[self.time].to_numpy(float) / self.slot_s).astype(np.int64)
        for slot in np.unique(slots).tolist():
            part = new[slots == slot]
            lists = [part[n].tolist() for n in names]
            if self.slots.containsKey((slot,)):
                lists = [list(a) + b for a, b in zip(self.slots.getValue((slot,)), lists)]
            else:
                self.handle.registerTimer(self.closing_time(slot))
            self.slots.updateValue((slot,), tuple(lists))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        slot = int(round(at / 1000 / self.slot_s)) - 1
        out = []
        if self.slots.containsKey((slot,)):
            rows = pd.DataFrame(dict(zip([n for n, _ in self.fields], self.slots.getValue((slot,)))))
            self.slots.removeKey((slot,))
            out.append(self.apply(key, rows.sort_values([self.time, self.tie], kind="stable", ignore_index=True)))
        out.append(self.passed(key, timerValues.getCurrentWatermarkInMs()))
        return iter([o for o in out if o is not None and len(o)])

    def apply(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def passed(self, key, watermark_ms: int) -> pd.DataFrame | None:
        """Called when a slot has been applied or a timer of the rule's own has come: rows from before the
        watermark are applied, or wait in slots whose timers follow in this batch."""
        return None

    def close(self) -> None:
        pass


class Announce(InOrder):
    """The run a camera is in, and one song clock a species."""

    fields = (("frame_id", "LONG"), ("epoch_s", "DOUBLE"), ("best_species", "STRING"))
    time, tie = "epoch_s", "frame_id"

    def __init__(self, slot_s: float, repeat_s: float, song_s: float, songs_enabled: bool) -> None:
        super().__init__(slot_s)
        self.rule = (repeat_s, song_s, songs_enabled)

    def init(self, handle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", "species STRING, spoken DOUBLE")
        self.songs = handle.getMapState("songs", "species STRING", "t DOUBLE")

    def apply(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        seen = rows["best_species"].unique().tolist()
        clocks = {n: self.songs.getValue((n,))[0] for n in seen if self.songs.containsKey((n,))}
        run = tuple(self.run.get()) if self.run.exists() else (None, None)
        out, run = announce_rows(rows.assign(source=key[0]), run, clocks, *self.rule)
        for name, t in clocks.items():
            if t is not None:
                self.songs.updateValue((name,), (t,))
        self.run.update(run)
        return out


class Failures(InOrder):
    """Failures in a row, and when one was last printed."""

    fields = (("t", "DOUBLE"), ("attempt_id", "LONG"), ("ok", "BOOLEAN"))
    time, tie = "t", "attempt_id"

    def __init__(self, slot_s: float, quiet_s: float) -> None:
        super().__init__(slot_s)
        self.quiet_s = quiet_s

    def init(self, handle) -> None:
        super().init(handle)
        self.past = handle.getValueState("past", "failures LONG, logged_at DOUBLE")

    def apply(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        failures, logged_at = tuple(self.past.get()) if self.past.exists() else (0, None)
        out, failures, logged_at = failure_rows(rows.assign(source=key[0]), int(failures), logged_at, self.quiet_s)
        self.past.update((int(failures), logged_at))
        return out


class Visits(InOrder):
    """The open visit of a camera. It ends with another species, or when the watermark shows that no
    row within ``gap_s`` of its end can come."""

    fields = (("frame_id", "LONG"), ("epoch_s", "DOUBLE"), ("best_species", "STRING"), ("best_species_conf", "DOUBLE"))
    time, tie = "epoch_s", "frame_id"

    def __init__(self, slot_s: float, gap_s: float) -> None:
        super().__init__(slot_s)
        self.gap_s = gap_s

    def init(self, handle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "species STRING, start DOUBLE, finish DOUBLE, frames LONG, conf DOUBLE")
        self.number = handle.getValueState("number", "n LONG")

    def _closed(self, key, visits: list[tuple]) -> pd.DataFrame:
        n = self.number.get()[0] if self.number.exists() else 0
        if visits:
            self.number.update((n + len(visits),))
        names = ["species", "start_epoch_s", "end_epoch_s", "frames", "max_conf"]
        out = pd.DataFrame(visits, columns=names)
        out.insert(0, "visit_no", np.arange(n + 1, n + 1 + len(visits), dtype=np.int64))
        out.insert(0, "source", key[0])
        return out

    def apply(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        done, now = [], tuple(self.open.get()) if self.open.exists() else None
        species, times = rows["best_species"].to_numpy(object), rows["epoch_s"].to_numpy(float)
        confs = rows["best_species_conf"].to_numpy(float)
        breaks = np.flatnonzero((species[1:] != species[:-1]) | (np.diff(times) > self.gap_s)) + 1
        for lo, hi in zip([0, *breaks.tolist()], [*breaks.tolist(), len(rows)]):
            conf = float(confs[lo:hi].max())
            if now is not None and now[0] == species[lo] and times[lo] - now[2] <= self.gap_s:
                now = (now[0], now[1], float(times[hi - 1]), now[3] + hi - lo, max(now[4], conf))
                continue
            if now is not None:
                done.append(now)
            now = (species[lo], float(times[lo]), float(times[hi - 1]), hi - lo, conf)
        self.open.update(now)
        return self._closed(key, done)

    def passed(self, key, watermark_ms: int) -> pd.DataFrame | None:
        if not self.open.exists():
            return None
        now = tuple(self.open.get())
        first, last = self.slot_of(now[2]), self.slot_of(now[2] + self.gap_s)  # where rows could be that belong to it
        if self.closing_time(last) > watermark_ms:
            self.handle.registerTimer(self.closing_time(last))
            return None
        if any(self.slots.containsKey((s,)) for s in range(first, last + 1)):
            return None
        self.open.clear()
        return self._closed(key, [now])


def _run(df: DataFrame, time: str, watermark: str, processor: InOrder, out: str) -> DataFrame:
    timed = df.where(F.col(time).isNotNull()).withColumn("_at", F.timestamp_seconds(time)).withWatermark("_at", watermark)
    return timed.groupBy("source").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def _announceable(best: DataFrame, min_conf: float) -> DataFrame:
    return best.where(F.col("best_species").isNotNull() & (F.col("best_species_conf") >= F.lit(float(min_conf))))


def announce_in_order(best: DataFrame, watermark: str, min_conf: float = config.MIN_ALERT_CONF,
                      repeat_s: float = config.SAME_SPECIES_REPEAT_S, song_s: float = config.SONG_EVERY_S,
                      songs_enabled: bool = config.SONGS_ENABLED, slot_s: float = SLOT_S) -> DataFrame:
    """T3 for rows that arrive out of order: W6 of the rows that came within the watermark. A slot's rows are
    out when the watermark has passed its end."""
    return _run(_announceable(best, min_conf), "epoch_s", watermark, Announce(slot_s, repeat_s, song_s, songs_enabled), ANNOUNCE_OUT)


def failures_in_order(attempts: DataFrame, watermark: str, quiet_s: float = config.FAILURE_LOG_QUIET_S,
                      slot_s: float = SLOT_S) -> DataFrame:
    """T4 for attempts that arrive out of order: W4 of those that came within the watermark."""
    t = (F.unix_micros("ts") / F.lit(1_000_000.0)).cast("double")
    return _run(attempts.withColumn("t", t), "t", watermark, Failures(slot_s, quiet_s), FAILURE_OUT)


def visits_stream(best: DataFrame, gap_s: float, watermark: str, min_conf: float = config.MIN_ALERT_CONF,
                  slot_s: float = SLOT_S) -> DataFrame:
    """One row per finished visit of a camera, as ``species_visits`` gives them."""
    return _run(_announceable(best, min_conf), "epoch_s", watermark, Visits(slot_s, gap_s), VISIT_OUT)
