"""Live turns that are revised when a late message splits, merges or lengthens them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.scale import bucketed_rank
from palimpsest.operators.turns import BURST_GAP_S


class RevisedTurns(StatefulProcessor):
    """Turns of one conversation, whatever the order in which its messages arrive.

    State: the messages by (time in microseconds, id), and of every turn that is out, by its first
    message, the revision and a digest. A micro-batch adds its messages, merges the conversation
    anew and lets out what changed: turns with their next revision, and a retraction for those whose
    first message now belongs to another turn. Repeated messages change nothing.

    With ``keep_s``, messages that many seconds behind the newest leave the state with their turn.
    A message from before that point comes out at once as a turn of its own, marked ``late``.
    """

    def __init__(self, gap_s: int = BURST_GAP_S, keep_s: int | None = None):
        self.gap = gap_s * 1_000_000
        self.keep = None if keep_s is None else keep_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = "at bigint, id bigint"
        self.messages = handle.getMapState("messages", key, "role string, line string, name string")
        self.turns = handle.getMapState("turns", key, "revision int, digest string")
        self.settled = handle.getValueState("settled", "at bigint")

    def close(self) -> None:
        pass

    def _lines(self, rows: Iterator[pd.DataFrame]) -> dict[tuple, tuple]:
        found = {}
        for part in rows:
            for m in part.itertuples():
                line = (m.text or "").strip()
                if not line or pd.isna(m.is_me):
                    continue
                role = "assistant" if m.is_me else "user"
                name = m.sender_name if isinstance(m.sender_name, str) and m.sender_name else "Them"
                if role == "user" and m.is_group:
                    line = f"{name}: {line}"
                found[int(m.at), int(m.id)] = (role, line, name if role == "user" else "")
        return found

    def _merged(self, messages: dict[tuple, tuple]) -> dict[tuple, tuple]:
        """First message of every turn -> (role, text, last time, names, number of messages)."""
        out: dict[tuple, list] = {}
        first = None
        for (at, number), (role, line, name) in sorted(messages.items()):
            turn = out.get(first)
            if turn is None or turn[0] != role or at - turn[2] > self.gap:
                first = at, number
                turn = out[first] = [role, [], at, [], 0]
            turn[1].append(line)
            turn[2] = at
            if name and name not in turn[3]:
                turn[3].append(name)
            turn[4] += 1
        return {k: (r, "\n".join(t), at, names, n) for k, (r, t, at, names, n) in out.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = self._lines(rows)
        settled = self.settled.get()[0] if self.settled.exists() else None
        late = {k: v for k, v in arrived.items() if settled is not None and k[0] <= settled}
        messages = {tuple(k): tuple(v) for k, v in self.messages.iterator()}
        new = {k: v for k, v in arrived.items() if k not in late and k not in messages}
        out = [(*k, 1, False, True, *self._merged({k: v})[k]) for k, v in sorted(late.items())]
        if new:
            for k, v in new.items():
                self.messages.updateValue(k, v)
            messages |= new
            turns, known = self._merged(messages), {tuple(k): tuple(v) for k, v in self.turns.iterator()}
            for k, turn in turns.items():
                digest = hashlib.md5(repr(turn).encode()).hexdigest()
                revision, before = known.pop(k, (0, ""))
                if digest != before:
                    self.turns.updateValue(k, (revision + 1, digest))
                    out.append((*k, revision + 1, False, False, *turn))
            for k, (revision, before) in known.items():
                if before:
                    self.turns.updateValue(k, (revision + 1, ""))
                    out.append((*k, revision + 1, True, False, None, None, None, None, None))
            if self.keep is not None:
                self._settle(messages, turns, known)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS[1:]).assign(conversation_id=key[0])[_COLUMNS]

    def _settle(self, messages: dict, turns: dict, retracted: dict) -> None:
        """Forget turns that no message after the horizon can change."""
        horizon = max(messages)[0] - self.keep
        old = [k for k, turn in turns.items() if turn[2] + self.gap < horizon]
        if not old:
            return
        point = max(turns[k][2] for k in old)
        self.settled.update((point,))
        for k in messages:
            if k[0] <= point:
                self.messages.removeKey(k)
        for k in [*old, *(k for k in retracted if k[0] <= point)]:
            self.turns.removeKey(k)


_COLUMNS = [
    "conversation_id", "first_at", "first_id", "revision", "retracted", "late", "role", "text", "last_at",
    "names", "n_messages",
]


def stream_turns(messages: DataFrame, gap_s: int = BURST_GAP_S, keep_s: int | None = None) -> DataFrame:
    """Turn revisions of a message stream (conversation_id, id, ts, is_me, is_group, sender_name, text).

    A turn is named by (conversation_id, first_at, first_id); its highest revision counts, unless
    that one is retracted (see ``current_turns``).
    """
    schema = T.StructType(
        [
            T.StructField("conversation_id", messages.schema["conversation_id"].dataType),
            T.StructField("first_at", T.LongType()),
            T.StructField("first_id", T.LongType()),
            T.StructField("revision", T.IntegerType()),
            T.StructField("retracted", T.BooleanType()),
            T.StructField("late", T.BooleanType()),
            T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("last_at", T.LongType()),
            T.StructField("names", T.ArrayType(T.StringType())),
            T.StructField("n_messages", T.LongType()),
        ]
    )
    rows = messages.withColumn("at", F.unix_micros("ts")).drop("ts")
    return rows.groupBy("conversation_id").transformWithStateInPandas(
        RevisedTurns(gap_s, keep_s), schema, "append", "none"
    )


def current_turns(revisions: DataFrame) -> DataFrame:
    """The turns that stand after the revisions so far, numbered within their conversation."""
    name = ["conversation_id", "first_at", "first_id"]
    rest = [c for c in revisions.columns if c not in name]
    last = (
        revisions.groupBy(*name)
        .agg(F.max_by(F.struct(*rest), "revision").alias("_r"))
        .select(*name, "_r.*")
        .filter(~F.col("retracted"))
    )
    day = F.col("first_at").cast("double") / 86_400_000_000
    return bucketed_rank(
        last, ["conversation_id"], F.floor(day), [F.col("first_at"), F.col("first_id")], "turn_no"
    ).withColumn("ts", F.timestamp_micros("last_at"))
