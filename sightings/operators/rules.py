"""The ordered rules of a camera over arrays of its next rows: announcements (W6) and failures.

Batch (``operators.alerts``, block by block) and streams (``streaming``) call the same functions with the state
that the rows before have left. Besides the rules there is, for each, what a block of rows does to a state that
isn't known yet: ``*_summary`` says it, ``*_after`` applies it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .. import config
from ..plans.cooldown import first_far, last_reached, marked, next_rows


def emissions(times: np.ndarray, last: float | None, gap: float, strict: bool = False) -> tuple[np.ndarray, float | None]:
    """Which of the ascending ``times`` emit if the one before them was ``last`` (None: none yet), and
    the last emission."""
    n = len(times)
    flags = np.zeros(n, bool)
    if n < 24:  # too few for whole arrays to pay
        for i, t in enumerate(times.tolist()):
            if last is None or (t - last > gap if strict else t - last >= gap):
                flags[i], last = True, t
        return flags, last
    end, gaps = np.full(n, n), np.full(n, float(gap))
    since = np.array([-np.inf if last is None else last])
    first = first_far(times, np.array([0]), end[:1], since, gaps[:1], strict)
    if first[0] == n:
        return flags, last
    flags = marked(first, next_rows(times, end, gaps, strict), end)
    return flags, float(times[np.flatnonzero(flags)[-1]])


def _stretches(first: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the stretches that begin where ``first`` is true (and at the start)."""
    at = np.flatnonzero(np.concatenate([[True], first[1:]])) if len(first) else np.zeros(0, int)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(first)]))


def announce_flags(species: np.ndarray, times: np.ndarray, run: tuple[str | None, float | None], songs: dict[str, float], repeat_s: float,
                   song_s: float, songs_enabled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[str | None, float | None]]:
    """W6 for a camera's next rows in order; ``run`` is the species it shows and when that was last spoken. ``songs`` is
    updated. Returns changed, speak and play_song of each row, and the new ``run``."""
    before = np.concatenate([[run[0]], species[:-1]]) if len(species) else species
    changed = np.array([a != b for a, b in zip(species, before)], bool)
    speak, play = np.zeros(len(species), bool), np.zeros(len(species), bool)
    for lo, hi in _stretches(changed):
        speak[lo:hi], spoken = emissions(times[lo:hi], None if changed[lo] else run[1], repeat_s)
        run = (species[lo], spoken)
    for name, at in pd.Series(np.arange(len(species))).groupby(species).groups.items() if songs_enabled else ():
        play[at], songs[name] = emissions(times[at], songs.get(name), song_s)
    return changed, speak, play, run


def announce_rows(rows: pd.DataFrame, run: tuple[str | None, float | None], songs: dict[str, float], repeat_s: float,
                  song_s: float, songs_enabled: bool) -> tuple[pd.DataFrame, tuple[str | None, float | None]]:
    """``announce_flags`` of a frame of rows, as its columns."""
    species, times = rows["best_species"].to_numpy(object), rows["epoch_s"].to_numpy(float)
    changed, speak, play, run = announce_flags(species, times, run, songs, repeat_s, song_s, songs_enabled)
    return rows[["frame_id", "source", "epoch_s", "best_species"]].assign(changed=changed, speak=speak, play_song=play), run


def failure_flags(ok: np.ndarray, times: np.ndarray, failures: int, logged_at: float | None, quiet_s: float) -> tuple[np.ndarray, np.ndarray, int, float | None]:
    """W4 for a camera's next attempts in order; ``failures`` in a row so far, the last one printed at ``logged_at``.
    Returns fail_n and logged of each attempt (0 and false for a success), and both numbers anew."""
    fail_n, logged = np.zeros(len(ok), np.int64), np.zeros(len(ok), bool)
    for lo, hi in _stretches(ok):
        if ok[lo]:
            failures, logged_at, lo = 0, None, lo + 1
        fail_n[lo:hi] = failures + np.arange(1, hi - lo + 1)
        logged[lo:hi], logged_at = emissions(times[lo:hi], logged_at, quiet_s, strict=True)
        failures += hi - lo
    return fail_n, logged, failures, logged_at


def failure_rows(rows: pd.DataFrame, failures: int, logged_at: float | None, quiet_s: float) -> tuple[pd.DataFrame, int, float | None]:
    """``failure_flags`` of a frame of attempts: the failed ones, and both numbers anew."""
    ok, times = rows["ok"].to_numpy(bool), rows["t"].to_numpy(float)
    fail_n, logged, failures, logged_at = failure_flags(ok, times, failures, logged_at, quiet_s)
    out = rows[["attempt_id", "source"]].assign(
        fail_n=fail_n, backoff_s=np.minimum(config.BACKOFF_STEP_S * fail_n, config.BACKOFF_CAP_S), logged=logged)
    return out[~ok], failures, logged_at


# ---- a block's effect on a state that isn't known yet ---------------------------------------------

def first_emissions(times: np.ndarray, gap: float, strict: bool = False) -> list[list[float]]:
    """``[time, last emission that follows]`` of each row that could emit first: those less than a gap after the first
    one, and the next. The one that does is the first that is far enough from the emission before."""
    if not len(times):
        return []
    end, gaps = np.full(len(times), len(times)), np.full(len(times), float(gap))
    reach = int(np.searchsorted(times, times[0] + gap, "right")) + 1
    last = times[last_reached(next_rows(times, end, gaps, strict), end)]
    return np.column_stack([times, last])[:reach].tolist()


def emission_after(entries: list[list[float]], last: float | None, gap: float, strict: bool = False) -> float | None:
    """The last emission after the rows of ``first_emissions``."""
    for t, reached in entries:
        if last is None or (t - last > gap if strict else t - last >= gap):
            return reached
    return last


def announce_summary(species: np.ndarray, times: np.ndarray, repeat_s: float, song_s: float) -> dict:
    """A block of W6: its first and last species, whether that is one run, the last run's emissions, and each species'
    song emissions. Rows without a time (NaN) neither emit nor move a clock."""
    timed = ~np.isnan(times)
    starts = _stretches(np.concatenate([[True], species[1:] != species[:-1]]))
    lo = starts[-1][0]
    songs = {name: first_emissions(times[timed & (species == name)], song_s) for name in dict.fromkeys(species.tolist())}
    return {"species": species[-1], "whole": lo == 0, "spoken": first_emissions(times[lo:][timed[lo:]], repeat_s), "songs": songs}


def announce_after(state: dict | None, block: dict, repeat_s: float, song_s: float) -> dict:
    """``{"species", "spoken", "songs"}`` after a block."""
    state = state or {"species": None, "spoken": None, "songs": {}}
    goes_on = block["whole"] and state["species"] == block["species"]
    spoken = emission_after(block["spoken"], state["spoken"] if goes_on else None, repeat_s)
    songs = {name: emission_after(entries, state["songs"].get(name), song_s) for name, entries in block["songs"].items()}
    return {"species": block["species"], "spoken": spoken, "songs": {**state["songs"], **songs}}


def failure_summary(ok: np.ndarray, times: np.ndarray, quiet_s: float) -> dict:
    """A block of W4: successes, failures after the last of them, and their emissions."""
    lo = int(np.flatnonzero(ok)[-1]) + 1 if ok.any() else 0
    tail = times[lo:]
    return {"ok": int(ok.sum()), "failures": len(tail), "logged": first_emissions(tail[~np.isnan(tail)], quiet_s, strict=True)}


def failure_after(state: dict | None, block: dict, quiet_s: float) -> dict:
    """``{"ok", "failures", "logged"}`` after a block."""
    state = state or {"ok": 0, "failures": 0, "logged": None}
    fresh = block["ok"] > 0
    return {"ok": state["ok"] + block["ok"], "failures": block["failures"] + (0 if fresh else state["failures"]),
            "logged": emission_after(block["logged"], None if fresh else state["logged"], quiet_s, strict=True)}
