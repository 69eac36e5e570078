"""Row layouts shared by sources, operators and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTERS = ("text", "email", "speech", "doc")
CAPTURE_STATUSES = ("pending", "processing", "done", "failed", "discarded")
MEMORY_KINDS = ("note", "fact", "preference", "todo", "number", "event", "person")

_s, _ts, _b, _l, _d = (
    T.StringType(),
    T.TimestampType(),
    T.BooleanType(),
    T.LongType(),
    T.DoubleType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# What every source produces. `seq` is the position inside the source; it breaks time ties.
CANONICAL = _struct(
    conversation_external_id=_s,
    text=_s,
    ts=_ts,
    is_me=_b,
    register=_s,
    external_id=_s,
    conversation_title=_s,
    is_group=_b,
    sender_handle=_s,
    sender_name=_s,
    meta=T.MapType(_s, _s),
    seq=_l,
)
SOURCE_REF = _struct(kind=_s, label=_s, locator=_s)
MESSAGE_BATCH = _struct(source=SOURCE_REF, messages=T.ArrayType(CANONICAL))

CAPTURES = _struct(
    uid=_s,
    device_uid=_s,
    kind=_s,
    origin=_s,
    client_ts=_ts,
    received_at=_ts,
    text=_s,
    duration_s=_d,
    speaker_vec=T.ArrayType(T.FloatType()),
)
FRAMES = _struct(device=_s, frame_no=_l, ts=_ts, level_db=_d, prob=_d)
MEMORIES = _struct(
    uid=_s,
    kind=_s,
    text=_s,
    source_kind=_s,
    source_ref=_s,
    confidence=_d,
    created_at=_ts,
    updated_at=_ts,
    expires_at=_ts,
    archived=_b,
)
EMBEDDINGS = _struct(
    owner_kind=_s, owner_id=_l, model=_s, dim=T.IntegerType(), vec=T.ArrayType(T.FloatType())
)
PROFILE = _struct(name=_s, centroid=T.ArrayType(_d), n_samples=_l)


def conform(df: DataFrame, schema: T.StructType = CANONICAL) -> DataFrame:
    """Select the columns of ``schema`` in order, filling missing ones with typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
