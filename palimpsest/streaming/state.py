"""Stateful stream operators: noise floor, speech segments, loudness gate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.segments import SegmentRules

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ordered(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    parts = [p for p in rows if len(p)]
    return pd.concat(parts).sort_values(list(by)) if parts else pd.DataFrame()


class _Keyed(StatefulProcessor):
    """One value of state per key, read before and written after each micro-batch."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.schema)

    def load(self) -> tuple | None:
        return tuple(self.value.get()) if self.value.exists() else None

    def close(self) -> None:
        pass


# --- noise floor ------------------------------------------------------------------------


class NoiseFloor(_Keyed):
    """Speech probability of each frame from its level above an adaptive noise floor.

    The floor follows the minimum level of the last ``window`` frames: halfway at once when it
    falls, by a twentieth per frame when it rises. The window's levels are kept as a queue of
    candidates for the minimum, so a frame costs constant time.
    """

    schema = "n bigint, floor double, at array<bigint>, level array<double>"

    def __init__(self, margin_db=12.0, gate_db=-45.0, window_s=8.0, softness_db=3.0, frame_s=0.032):
        self.margin, self.gate = margin_db, gate_db
        self.softness = max(softness_db, 1e-3)
        self.window = max(1, round(window_s / frame_s))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = _ordered(rows, "frame_no")
        if not len(frames):
            return
        n, floor, at, level = self.load() or (0, None, [], [])
        at, level = list(at), list(level)
        floors, probs = [], []
        for db in frames["level_db"]:
            while level and level[-1] >= db:
                at.pop(), level.pop()
            at.append(n)
            level.append(db)
            if at[0] <= n - self.window:
                at.pop(0), level.pop(0)
            lowest = level[0]
            if floor is None:
                floor = lowest
            else:
                floor += (lowest - floor) * (0.5 if lowest < floor else 0.05)
            above = (db - floor - self.margin) / self.softness
            probs.append(0.0 if db < self.gate else 1.0 / (1.0 + math.exp(-above)))
            floors.append(floor)
            n += 1
        self.value.update((n, floor, at, level))
        yield pd.DataFrame(
            {
                "device": key[0],
                "frame_no": frames["frame_no"].to_numpy(),
                "ts": frames["ts"].to_numpy(),
                "floor_db": floors,
                "prob": probs,
            }
        )


def speech_probability(frames: DataFrame, **rules) -> DataFrame:
    """(device, frame_no, ts, floor_db, prob) for a stream of (device, frame_no, ts, level_db)."""
    schema = "device string, frame_no bigint, ts timestamp, floor_db double, prob double"
    return frames.groupBy("device").transformWithStateInPandas(
        NoiseFloor(**rules), schema, "append", "none"
    )


# --- segments ---------------------------------------------------------------------------


class Segments(_Keyed):
    """Utterances as runs of speech frames, cut into pieces of bounded length.

    State: first frame and last speech frame of the open utterance, its unfinished piece with the
    speech frames in it, and the last frame seen. The rules are those of ``segment_frames``. A row
    without ``prob`` ends the device's stream and closes the utterance; frames at or before the
    last one seen are repeats and change nothing.
    """

    schema = "start bigint, last bigint, piece bigint, speech bigint, seen bigint"
    empty = (None, None, None, 0, -1)

    def __init__(self, rules: SegmentRules = SegmentRules()):
        self.rules = rules

    def _settle(self, start, last, counts, seen, closed) -> tuple[list[tuple], tuple]:
        """Pieces (first frame, frames, speech frames) that are final, and the unfinished one."""
        rules = self.rules
        quiet_end = last + rules.silence
        stop = min(seen, quiet_end)
        final, rest = [], (None, 0)
        for piece, speech in sorted(counts.items()):
            first = start + piece * rules.longest
            end = first + rules.longest - 1
            if end > stop or end == stop == quiet_end:
                if not closed:
                    rest = (piece, speech)
                    continue
                end = min(stop, last + rules.pad)
            if speech >= rules.min_speech and end >= first:
                final.append((first, end - first + 1, speech))
        return final, rest

    def advance(self, state: tuple, numbers: np.ndarray, probs: np.ndarray) -> tuple[tuple, list[tuple]]:
        """The state after these frames, in frame order, and the pieces that became final."""
        start, last, piece, speech, seen = state
        new = numbers > seen
        numbers, probs = numbers[new], probs[new]
        if not len(numbers):
            return state, []
        ended = bool(np.isnan(probs[-1]))
        seen = int(numbers[-1])
        loud = numbers[probs > self.rules.threshold]
        if start is not None:
            loud = np.r_[last, loud]
        if not len(loud):
            return (None, None, None, 0, seen), []
        found: list[tuple] = []
        runs = np.split(loud, np.flatnonzero(np.diff(loud) > self.rules.silence) + 1)
        reach = seen - 1 if ended else seen  # the closing row is no frame
        for k, run in enumerate(runs):
            if k == 0 and start is not None:
                counts, run = ({piece: speech} if speech else {}), run[1:]
            else:
                start, counts = max(0, int(run[0]) - self.rules.pad), {}
            for own, n in zip(*np.unique((run - start) // self.rules.longest, return_counts=True)):
                counts[int(own)] = counts.get(int(own), 0) + int(n)
            last = int(run[-1]) if len(run) else last
            closed = ended or k + 1 < len(runs) or reach >= last + self.rules.silence
            final, (piece, speech) = self._settle(start, last, counts, reach, closed)
            found += final
        return ((None, None, None, 0, seen) if closed else (start, last, piece, speech, seen)), found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = _ordered(rows, "frame_no")
        if not len(frames):
            return
        numbers = frames["frame_no"].to_numpy(np.int64)
        state, found = self.advance(self.load() or self.empty, numbers, frames["prob"].to_numpy(float))
        self.value.update(state)
        if found:
            out = pd.DataFrame(found, columns=["first_frame", "n_frames", "speech_frames"])
            back = (numbers[-1] - out["first_frame"]) * self.rules.frame_s
            out["started_at"] = frames["ts"].iloc[-1] - pd.to_timedelta(back, unit="s")
            out["last_frame"] = out["first_frame"] + out["n_frames"] - 1
            out["duration_s"] = out["n_frames"] * self.rules.frame_s
            out["device"] = key[0]
            yield out[["device", "first_frame", "started_at", "n_frames", "speech_frames", "last_frame", "duration_s"]]


def stream_segments(frames: DataFrame, rules: SegmentRules = SegmentRules()) -> DataFrame:
    """Confirmed speech segments of a stream of (device, frame_no, ts, prob).

    Frames of a device arrive in frame order, repeats aside; none is dropped for its time. A row
    with the next frame number and no ``prob`` ends a device's stream.
    """
    schema = (
        "device string, first_frame bigint, started_at timestamp, n_frames bigint, "
        "speech_frames bigint, last_frame bigint, duration_s double"
    )
    return frames.groupBy("device").transformWithStateInPandas(Segments(rules), schema, "append", "none")


# --- loudness gate ----------------------------------------------------------------------


class Gate(_Keyed):
    """Spans of loud frames with hangover, pre-roll and a length cap (times in ms).

    A span runs from a loud frame to the first frame more than ``hangover_ms`` after its last loud
    one, or to the first at ``max_ms``; if that one is loud, the next span begins there without
    pre-roll. A row without level closes the span. State: end of the previous span (or first
    frame), begin, last loud frame and pre-roll of the open span.
    """

    schema = "since bigint, begun bigint, voiced bigint, preroll bigint"

    def __init__(self, threshold_db, hangover_ms=300, preroll_ms=250, max_ms=30_000, min_ms=500):
        self.threshold = threshold_db
        self.hangover, self.preroll = hangover_ms, preroll_ms
        self.max, self.min = max(1, max_ms), min_ms

    def advance(self, state: tuple | None, at: np.ndarray, level: np.ndarray) -> tuple[tuple, list[tuple]]:
        since, begun, voiced, preroll = state or (int(at[0]), None, None, 0)
        loud = level >= self.threshold
        far = np.iinfo(np.int64).min // 2
        heard = np.maximum.accumulate(np.where(loud, at, far))
        heard = np.maximum(heard, far if voiced is None else voiced)
        onsets = np.flatnonzero(loud)
        quiet = np.flatnonzero(~loud & ((at - heard > self.hangover) | np.isnan(level)))
        found, i = [], 0
        while i < len(at):
            if begun is None:
                k = int(np.searchsorted(onsets, i))
                if k == len(onsets):
                    break
                i = int(onsets[k])
                begun, preroll = int(at[i]), min(self.preroll, int(at[i]) - since)
            k = int(np.searchsorted(quiet, i))
            fades = int(quiet[k]) if k < len(quiet) else len(at)
            fills = max(i, int(np.searchsorted(at, begun + self.max)))
            i = min(fades, fills)
            if i == len(at):
                break
            since = int(at[i])
            if since - begun - self.hangover >= self.min:
                found.append((begun - preroll, since))
            begun, preroll = (since, 0) if fills < fades and loud[i] else (None, 0)
            i += begun is None
        last = int(heard[-1])
        return (since, begun, last if last > far else None, preroll), found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = _ordered(rows, "ts")
        if not len(frames):
            return
        at = np.array([int(t.value // 1_000_000) for t in frames["ts"]], dtype=np.int64)
        state, found = self.advance(self.load(), at, frames["level_db"].to_numpy(float))
        self.value.update(state)
        if found:
            out = pd.DataFrame(found, columns=["from_ms", "to_ms"])
            out.insert(0, "device", key[0])
            yield out.assign(duration_s=(out["to_ms"] - out["from_ms"]) / 1000.0)


def stream_gate(levels: DataFrame, threshold_db: float, **rules) -> DataFrame:
    """(device, from_ms, to_ms, duration_s) for a stream of (device, ts, level_db)."""
    schema = "device string, from_ms bigint, to_ms bigint, duration_s double"
    return levels.groupBy("device").transformWithStateInPandas(
        Gate(threshold_db, **rules), schema, "append", "none"
    )
