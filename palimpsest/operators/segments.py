"""Speech segments from scored frames, as a batch job."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.scale import bucketed_islands

FRAME_S = 512 / 16000
FRAMES_PER_BUCKET = 1_000_000


@dataclass(frozen=True)
class SegmentRules:
    """Thresholds in seconds; frame counts follow from the frame length."""

    threshold: float = 0.5
    min_speech_s: float = 0.6
    silence_end_s: float = 0.8
    max_segment_s: float = 30.0
    pad_s: float = 0.25
    frame_s: float = FRAME_S

    @property
    def min_speech(self) -> int:
        return max(1, math.ceil(self.min_speech_s / self.frame_s))

    @property
    def silence(self) -> int:
        return max(1, math.ceil(self.silence_end_s / self.frame_s))

    @property
    def longest(self) -> int:
        return max(self.min_speech, math.ceil(self.max_segment_s / self.frame_s))

    @property
    def pad(self) -> int:
        return max(0, round(self.pad_s / self.frame_s))


def segment_frames(frames: DataFrame, rules: SegmentRules = SegmentRules()) -> DataFrame:
    """(device, first_frame, last_frame, n_frames, speech_frames) of confirmed segments.

    ``frames``: device, frame_no (consecutive from 0), prob. Speech frames less than
    ``silence`` apart form one utterance; it starts ``pad`` frames early and ends ``pad`` frames
    after its last speech frame. Utterances are cut every ``longest`` frames, and pieces with
    too little speech are dropped. Only speech frames are looked at, bucketed by frame number.
    """
    speech = frames.filter(F.col("prob") > rules.threshold).select("device", "frame_no")
    last = frames.groupBy("device").agg(F.max("frame_no").alias("_end"))
    # An utterance closes on the `silence`-th quiet frame: speech at distance <= silence joins.
    runs = bucketed_islands(
        speech, ["device"], F.floor(F.col("frame_no") / FRAMES_PER_BUCKET), "frame_no", rules.silence
    )
    bounds = runs.groupBy("device", "island").agg(
        F.min("frame_no").alias("_a"), F.max("frame_no").alias("_z")
    )
    # Pre-roll reaches back to the stream's start at most; it may overlap earlier segments.
    spans = (
        bounds.withColumn("_start", F.greatest(F.lit(0), F.col("_a") - rules.pad))
        .join(last, "device")
        .withColumn("_stop", F.least(F.col("_end"), F.col("_z") + rules.silence))
    )
    piece = F.floor((F.col("frame_no") - F.col("_start")) / rules.longest)
    pieces = (
        runs.join(spans, ["device", "island"])
        .withColumn("piece", piece)
        .groupBy("device", "island", "piece", "_start", "_stop", "_z")
        .agg(F.count("*").alias("speech_frames"))
        .filter(F.col("speech_frames") >= rules.min_speech)
    )
    first = F.col("_start") + F.col("piece") * rules.longest
    full_end = first + rules.longest - 1
    # A full piece is emitted whole; the closing piece keeps `pad` frames of its quiet tail.
    whole = full_end <= F.col("_stop")
    closes_now = (full_end == F.col("_stop")) & (F.col("_stop") == F.col("_z") + rules.silence)
    trimmed = F.least(F.col("_stop"), F.col("_z") + rules.pad)
    end = F.when(whole & ~closes_now, full_end).otherwise(trimmed)
    return pieces.select(
        "device",
        first.alias("first_frame"),
        end.alias("last_frame"),
        (end - first + 1).alias("n_frames"),
        "speech_frames",
    ).filter("n_frames > 0")
