"""Timestamps: ISO rendering, device epochs, locale dates of chat exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEVICE_EPOCH_S = 978_307_200  # 2001-01-01T00:00:00Z
NANOSECOND_THRESHOLD = 1e11


def to_iso(ts: Column) -> Column:
    """ISO-8601 UTC with milliseconds (session time zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(value: Column) -> Column:
    """ISO-8601 text to a timestamp; no zone means UTC; unreadable becomes NULL."""
    return F.trim(value).try_cast("timestamp")


def device_time(value: Column) -> Column:
    """Seconds, or nanoseconds when the number is too large, since 2001-01-01 UTC."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    seconds = F.when(F.abs(v) > NANOSECOND_THRESHOLD, v / 1e9).otherwise(v)
    return F.timestamp_micros(((seconds + DEVICE_EPOCH_S) * 1_000_000).cast("long"))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def date_fields(date: Column) -> Column:
    """First, second and third number of a date and whether it is dotted."""
    part = lambda i: F.get(F.split(date, r"[./-]"), F.lit(i)).try_cast("int")
    return F.struct(
        part(0).alias("a"), part(1).alias("b"), part(2).alias("c"), date.contains(".").alias("dot")
    )


def build_datetime(fields: Column, time: Column, order: Column) -> Column:
    """Timestamp from export date numbers, clock text and field order; invalid is NULL."""
    year = F.when(order == "ymd", fields["a"]).otherwise(fields["c"])
    month = F.when(order == "mdy", fields["a"]).otherwise(fields["b"])
    day = (
        F.when(order == "ymd", fields["c"])
        .when(order == "dmy", fields["a"])
        .otherwise(fields["b"])
    )
    year = F.when(year < 100, year + 2000).otherwise(year)
    clock = rf"^(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?[\s\x{{202F}}\xa0]*([AaPp]|ÖÖ|ÖS)?"
    piece = lambda i: F.regexp_extract(time, clock, i)
    hour = piece(1).try_cast("int")
    half = F.upper(piece(4))
    hour = (
        F.when(half.isin("P", "ÖS") & (hour < 12), hour + 12)
        .when(half.isin("A", "ÖÖ") & (hour == 12), F.lit(0))
        .otherwise(hour)
    )
    second = F.coalesce(piece(3).try_cast("int"), F.lit(0))
    valid = (hour < 24) & (piece(2).try_cast("int") < 60) & (second < 60)
    return F.when(
        valid,
        F.try_make_timestamp(year, month, day, hour, piece(2).try_cast("int"), second),
    )
