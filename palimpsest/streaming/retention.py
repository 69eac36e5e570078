"""Live retention: a spool per device that never exceeds its bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Retention(StatefulProcessor):
    """Keeps the newest entries of a device whose sizes add up to ``max_bytes`` at most.

    State: the entries kept, which the cap bounds, and the newest entry ever evicted. What is as
    old as that one or older goes at once: the entries above it exceeded the cap, and only more
    come. So every order of arrival ends with the same entries as one batch.
    """

    def __init__(self, max_bytes: int):
        self.cap = max_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "at bigint, uid bigint, size bigint")
        self.evicted = handle.getValueState("evicted", "at bigint, uid bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bound = tuple(self.evicted.get()) if self.evicted.exists() else None
        held = {(at, uid): size for at, uid, size in self.entries.get()}
        known, gone = set(held), []
        for part in rows:
            for at, uid, size in zip(part["at"].tolist(), part["uid"].tolist(), part["size"].tolist()):
                if bound is not None and (at, uid) <= bound:
                    gone.append((at, uid, size))
                else:
                    held.setdefault((at, uid), size)
        total, kept = 0, []
        for at, uid in sorted(held, reverse=True):
            total += held[at, uid]
            if total > self.cap:
                if bound is None or (at, uid) > bound:
                    bound = (at, uid)
                gone.append((at, uid, held[at, uid]))
            else:
                kept.append((at, uid, held[at, uid]))
        if set((a, u) for a, u, _ in kept) != known:
            if kept:
                self.entries.put(kept)
            else:
                self.entries.clear()
        if bound is not None:
            self.evicted.update(bound)
        fresh = [(a, u, s, False) for a, u, s in kept if (a, u) not in known]
        out = fresh + [(*g, True) for g in gone]
        if out:
            frame = pd.DataFrame(out, columns=["at", "uid", "size", "evicted"])
            yield frame.assign(device=key[0])[["device", "at", "uid", "size", "evicted"]]


def stream_retention(entries: DataFrame, max_bytes: int) -> DataFrame:
    """(device, at, uid, size, evicted) for a stream of (device, uid, ts, size).

    An entry comes out when it is kept and again when it is evicted; one that is too old on arrival
    comes out as evicted only. What is kept now is what came out and was not evicted.
    """
    schema = T.StructType(
        [
            T.StructField("device", entries.schema["device"].dataType),
            T.StructField("at", T.LongType()),
            T.StructField("uid", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("evicted", T.BooleanType()),
        ]
    )
    rows = entries.select(
        "device", F.unix_micros("ts").alias("at"), F.col("uid").cast("long"), F.col("size").cast("long")
    )
    return rows.groupBy("device").transformWithStateInPandas(Retention(max_bytes), schema, "append", "none")


def kept_entries(events: DataFrame) -> DataFrame:
    """(device, uid) of the entries that are kept after the events so far."""
    return events.groupBy("device", "uid").agg(F.max("evicted").alias("gone")).filter(~F.col("gone")).drop("gone")
