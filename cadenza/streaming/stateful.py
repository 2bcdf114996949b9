"""Streaming versions of the operators that look back: state per stream is what the batch windows would see.

Input rows of a stream must arrive in order of their index (within a batch they are sorted); a batch may hold any number of
rows of any number of streams. State is a few numbers or a bounded list, whatever the length of the stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import slices, tempo

STATE = "state string"


def _stateful(df: DataFrame, step: Callable[[dict, pd.DataFrame], list[tuple]], order: str, schema: str) -> DataFrame:
    """Applies step(state, rows in order) to each stream of each batch; state is kept as JSON."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(order)
        out = step(held, rows)
        state.update((json.dumps(held),))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=columns)

    return df.groupBy("stream_id").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def novelty_step(state: dict, rows: pd.DataFrame) -> list[tuple]:
    out = []
    for n, bands in zip(rows["frame_no"].tolist(), rows["bands"]):
        x = np.asarray(bands, dtype=np.int64)
        rise = np.maximum(x - np.asarray(state.get("bands", x)), 0)
        parts = [int(rise[a : b + 1].sum()) for a, b in (tempo.BASS, tempo.SNARE, tempo.HIGH)]
        raw = parts[0] + 0.8 * parts[1] + 0.2 * parts[2]
        state["recent"] = [*state.get("recent", []), raw][-9:]
        state["bands"] = x.tolist()
        out.append((n, *parts, raw, max(raw - sum(state["recent"]) / len(state["recent"]), 0.0)))
    return out


def novelty(frames: DataFrame) -> DataFrame:
    """The streaming form of tempo.novelty: frames(stream_id long, frame_no, bands)."""
    return _stateful(frames, novelty_step, "frame_no", "stream_id long, frame_no long, bass long, snare long, high long, raw double, novelty double")


def beat_step(period: float, start: float = 30.0, on: float = 20.0) -> Callable[[dict, pd.DataFrame], list[tuple]]:
    def step(state: dict, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for n, x in zip(rows["frame_no"].tolist(), rows["novelty"].tolist()):
            last = state.get("last")
            since = n - last if last is not None else 0
            if x > start if last is None else since >= 0.85 * period and (x > on or since >= 1.15 * period):
                out.append((state.get("beat", 0), n, last is not None and x <= on))
                state["last"], state["beat"] = n, state.get("beat", 0) + 1
        return out

    return step


def beats(nov: DataFrame, period: float) -> DataFrame:
    """Beats as they come: stream_id, beat, frame_no, interpolated. Bars need the whole stream (their phase is its best) and are left to the batch form."""
    return _stateful(nov, beat_step(period), "frame_no", "stream_id long, beat int, frame_no long, interpolated boolean")


def onset_step(gap: int, sensitivity: float = 0.5, hop: int = slices.HOP_SIZE, alpha: float = 0.95, floor: float = slices.NOISE_FLOOR, least: float = slices.LEAST_NOVELTY, reach: int = 64) -> Callable[[dict, pd.DataFrame], list[tuple]]:
    k = 3.5 - 3 * sensitivity

    def step(state: dict, rows: pd.DataFrame) -> list[tuple]:
        out = []
        # The samples of the hop that isn't whole yet, and as many before it as a zero crossing may reach back.
        x = np.concatenate([np.asarray(state.get("tail", []), dtype=np.int64), rows["v"].to_numpy(dtype=np.int64)])
        at = state.get("at", 0)  # number of the first sample in x
        begin = state.get("next", 0)  # of the first sample of the next hop
        history, before = state.get("history", []), state.get("energy", 0.0)
        while begin + hop <= at + len(x):
            i = begin - at
            part = x[i : i + hop]
            previous = np.concatenate([[x[i - 1] if i else 0], part[:-1]])
            energy = float(np.abs(part - alpha * previous).sum())
            nov, before = max(energy - before, 0.0), energy
            mean, deviation = (float(np.mean(history)), float(np.std(history))) if history else (0.0, 0.0)
            history = [*history, nov][-slices.HISTORY :]
            if nov > mean + k * deviation + floor and nov > least and ("last" not in state or begin - state["last"] >= gap):
                peak = begin + int(np.argmax(np.abs(part)))
                zero = next((j for j in range(peak, max(peak - reach, 0), -1) if (x[j - 1 - at] <= 0 <= x[j - at]) or (x[j - 1 - at] >= 0 >= x[j - at])), peak)
                out.append((state.get("k", 0), zero))
                state["last"], state["k"] = zero, state.get("k", 0) + 1
            begin += hop
        keep = max(0, begin - reach - hop - 1 - at)
        state.update(tail=x[keep:].tolist(), at=at + keep, next=begin, history=history, energy=before)
        return out

    return step


def onsets(samples: DataFrame, gap: int, **options: float) -> DataFrame:
    """The streaming form of slices.onsets: samples(stream_id long, n, v); equal to the batch form whatever the batches."""
    return _stateful(samples, onset_step(gap, **options), "n", "stream_id long, k int, start_sample long")


def envelope(samples: DataFrame, chunk: int = 128, shift: int = 8) -> DataFrame:
    """Chunks as they become whole: stream_id, chunk_no, v_min, v_max (the last, partial one stays in the state)."""

    def step(state: dict, rows: pd.DataFrame) -> list[tuple]:
        x = np.concatenate([np.asarray(state.get("tail", []), dtype=np.int64), np.clip(rows["v"].to_numpy(dtype=np.int64) >> shift, -128, 127)])
        whole = len(x) // chunk
        parts = x[: whole * chunk].reshape(-1, chunk)
        first = state.get("chunk", 0)
        state.update(tail=x[whole * chunk :].tolist(), chunk=first + whole)
        return [(first + k, int(min(p.min(), 0)), int(max(p.max(), 0))) for k, p in enumerate(parts)]

    return _stateful(samples, step, "n", "stream_id long, chunk_no long, v_min int, v_max int")
