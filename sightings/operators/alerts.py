"""Ordered per-camera operators: capture failure runs (W4), species changes (W5), announcement
cooldowns (W6), visits (W9), aligned capture ticks (T1/F11) and conflation (T2).

All ordered work goes through ``plans.blocks``, which cuts a camera into blocks of time, so a single busy
camera never has to fit into one task; the rules themselves (``operators.rules``) are those of the streams. A null source is a camera of its own. Rows without a time come
first among a camera's rows; they neither emit nor move a clock.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..plans.blocks import BLOCK_S, blockwise
from . import rules as R


def epoch_seconds(ts_col: str) -> F.Column:
    """TIMESTAMP -> epoch seconds (DOUBLE, microsecond precision)."""
    return (F.unix_micros(F.col(ts_col)) / F.lit(1_000_000.0)).cast("double")


def _times(rows: pa.Table, col: str) -> np.ndarray:
    """Times as doubles, NaN where there is none."""
    return rows[col].to_numpy().astype(float)


def failure_runs(attempts: DataFrame, quiet_s: float = config.FAILURE_LOG_QUIET_S, block_s: float = BLOCK_S) -> DataFrame:
    """W4 over ``attempts(attempt_id, source, ts, ok)``; one row per failed attempt with

    * ``fail_n``: consecutive failures so far (a success resets; a corrupt frame counts as success),
    * ``backoff_s``: min(0.2 * n, 5.0),
    * ``logged``: the producer prints when n = 1 or more than ``quiet_s`` seconds passed since the
      last printed failure (greedy, strict ``>``); never without a time,
    * ``island``: successes so far.
    """
    a = attempts.select("attempt_id", "source", epoch_seconds("ts").alias("t"), "ok")

    def finish(rows: pa.Table, state: dict | None) -> list:
        state = state or {"ok": 0, "failures": 0, "logged": None}
        ok, t = rows["ok"].to_numpy(), _times(rows, "t")
        if np.isnan(t).any():  # the block without times
            t, quiet = np.zeros(len(t)), np.inf
        else:
            quiet = quiet_s
        fail_n, logged, _, _ = R.failure_flags(ok, t, state["failures"], state["logged"], quiet)
        return [state["ok"] + np.cumsum(ok), fail_n, logged & np.isfinite(quiet)]

    out = blockwise(a, "source", "t", "attempt_id", "island bigint, fail_n bigint, logged boolean",
                    lambda rows: R.failure_summary(rows["ok"].to_numpy(), _times(rows, "t"), quiet_s),
                    lambda state, block: R.failure_after(state, block, quiet_s), finish, block_s)
    return out.where(~F.col("ok")).select("attempt_id", "source", "t", "island", "fail_n", S.backoff_s("fail_n").alias("backoff_s"), "logged")


def announceable(best_frames: DataFrame, min_conf: float = config.MIN_ALERT_CONF) -> DataFrame:
    """Frames whose best species exists and has confidence >= min_conf."""
    return best_frames.where(F.col("best_species").isNotNull() & (F.col("best_species_conf") >= F.lit(float(min_conf))))


def _strings(rows: pa.Table, col: str) -> np.ndarray:
    return rows[col].to_numpy().astype(object)


def species_changes(best_frames: DataFrame, min_conf: float = config.MIN_ALERT_CONF, block_s: float = BLOCK_S) -> DataFrame:
    """``changed`` when first ever or different from the previous announceable best of the same
    source (ordered by epoch_s, frame_id). Frames without a best are ignored (A, none, A = no change).
    ``prev_species`` is that best, and ``run_id`` numbers the stretches between changes from 1.

    ``best_frames`` needs frame_id, source, epoch_s, best_species, best_species_conf.
    """

    def summarise(rows: pa.Table) -> dict:
        species = _strings(rows, "best_species")
        return {"first": species[0], "last": species[-1], "inner": int((species[1:] != species[:-1]).sum())}

    def advance(state: dict | None, block: dict) -> dict:
        runs = (state["runs"] if state else 0) + block["inner"] + int(state is None or state["species"] != block["first"])
        return {"species": block["last"], "runs": runs}

    def finish(rows: pa.Table, state: dict | None) -> list:
        species = _strings(rows, "best_species")
        before = np.concatenate([[state["species"] if state else None], species[:-1]])
        changed = (species != before).astype(bool)
        return [pa.array(before, pa.string()), changed, (state["runs"] if state else 0) + np.cumsum(changed)]

    return blockwise(announceable(best_frames, min_conf), "source", "epoch_s", "frame_id",
                     "prev_species string, changed boolean, run_id bigint", summarise, advance, finish, block_s)


def announce(best_frames: DataFrame, min_conf: float = config.MIN_ALERT_CONF,
             repeat_s: float = config.SAME_SPECIES_REPEAT_S, song_s: float = config.SONG_EVERY_S,
             songs_enabled: bool = config.SONGS_ENABLED, block_s: float = BLOCK_S) -> DataFrame:
    """Per announceable frame, ``speak`` and ``play_song``.

    speak: on a species change, else when >= repeat_s since this species was last spoken (a change always speaks,
    so only the run a camera is in matters). song: when >= song_s since this species' song last played. Both, and
    the changes, come from one walk over a camera's blocks.
    """
    cols = ["frame_id", "source", "epoch_s", "best_species", "best_species_conf"]

    def finish(rows: pa.Table, state: dict | None) -> list:
        state = state or {"species": None, "spoken": None, "songs": {}}
        species, t = _strings(rows, "best_species"), _times(rows, "epoch_s")
        if np.isnan(t).any():  # the block without times
            changed, nothing = species != np.concatenate([[state["species"]], species[:-1]]), np.zeros(len(t), bool)
            return [changed.astype(bool), nothing, nothing]
        changed, speak, play, _ = R.announce_flags(species, t, (state["species"], state["spoken"]), dict(state["songs"]), repeat_s, song_s, songs_enabled)
        return [changed, speak, play]

    out = blockwise(announceable(best_frames, min_conf).select(*cols), "source", "epoch_s", "frame_id",
                    "changed boolean, speak boolean, play_song boolean",
                    lambda rows: R.announce_summary(_strings(rows, "best_species"), _times(rows, "epoch_s"), repeat_s, song_s),
                    lambda state, block: R.announce_after(state, block, repeat_s, song_s), finish, block_s)
    return out.withColumn("spoken_text", S.spoken_text("best_species"))


def species_visits(best_frames: DataFrame, gap_s: float, min_conf: float = config.MIN_ALERT_CONF, block_s: float = BLOCK_S) -> DataFrame:
    """Consecutive announceable frames of one species no more than ``gap_s`` apart form a
    visit: (source, visit_no, species, start, end, frames, max confidence)."""

    def breaks(species: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether each row but the first begins a visit: rows without a time stay together."""
        untimed = np.isnan(t)
        far = np.where(untimed[1:] | untimed[:-1], untimed[1:] != untimed[:-1], t[1:] - t[:-1] > gap_s)
        return (species[1:] != species[:-1]) | far

    def with_state(rows: pa.Table, state: dict | None) -> tuple[np.ndarray, np.ndarray]:
        species, t = _strings(rows, "best_species"), _times(rows, "epoch_s")
        if state:
            species = np.concatenate([[state["species"]], species])
            t = np.concatenate([[np.nan if state["t"] is None else state["t"]], t])
        return species, t

    def summarise(rows: pa.Table) -> dict:
        species, t = with_state(rows, None)
        ends = [None if np.isnan(x) else float(x) for x in (t[0], t[-1])]
        return {"first": [species[0], ends[0]], "last": [species[-1], ends[1]], "inner": int(breaks(species, t).sum())}

    def advance(state: dict | None, block: dict) -> dict:
        opens = state is None or bool(breaks(np.array([state["species"], block["first"][0]], object),
                                             np.array([np.nan if x is None else x for x in (state["t"], block["first"][1])]))[0])
        return {"species": block["last"][0], "t": block["last"][1], "visits": (state["visits"] if state else 0) + block["inner"] + int(opens)}

    def finish(rows: pa.Table, state: dict | None) -> list:
        opens = breaks(*with_state(rows, state))
        if state is None:
            opens = np.concatenate([[True], opens])
        return [(state["visits"] if state else 0) + np.cumsum(opens)]

    best = announceable(best_frames, min_conf).select("frame_id", "source", "epoch_s", "best_species", "best_species_conf")
    v = blockwise(best, "source", "epoch_s", "frame_id", "visit_no bigint", summarise, advance, finish, block_s)
    return v.groupBy("source", "visit_no").agg(
        F.max("best_species").alias("species"),
        F.min("epoch_s").alias("start_epoch_s"),
        F.max("epoch_s").alias("end_epoch_s"),
        F.count(F.lit(1)).alias("frames"),
        F.max("best_species_conf").alias("max_conf"),
    )


def aligned_ticks(df: DataFrame, t_col: str, interval_s: float = config.CAPTURE_INTERVAL_S,
                  phase_s: float = config.CAPTURE_PHASE_S) -> DataFrame:
    """The next aligned capture time strictly after ``t_col`` (epoch seconds)."""
    return df.withColumn("next_tick", S.next_aligned(t_col, interval_s, phase_s))


def conflate(frames: DataFrame, slot_s: float, t_col: str = "epoch_s", key: str = "source",
             tie: str = "frame_id") -> DataFrame:
    """Latest frame per (source, slot); older frames of the slot are dropped.

    ``max_by`` of whole rows: each task sorts its rows by key and keeps the latest of each before the shuffle,
    so only winners travel, however many frames a source has.
    """
    slot = (F.floor(F.col(t_col) / F.lit(float(slot_s))) * F.lit(float(slot_s))).cast("double")
    cols = [c for c in frames.columns]
    agg = frames.withColumn("slot_start", slot).groupBy(key, "slot_start").agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(t_col), F.col(tie))).alias("_l"),
        F.count(F.lit(1)).alias("frames_in_slot"),
    )
    return agg.select("slot_start", "frames_in_slot", *[F.col(f"_l.{c}").alias(c) for c in cols])
