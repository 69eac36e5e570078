"""Handles, names and salted hashes: who is who without keeping identifiers in the clear."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import WS, casefold, strip

# Fixed values.
OWNER_HANDLE = "__me__"
PHONE_PATTERN = rf"^\+?[\p{{Nd}}{WS}().-]{{6,}}$"
HOLDOUT_BUCKETS = 10_000


def normalize_handle(handle: Column) -> Column:
    """Canonical phone number, address or user name."""
    h = strip(handle)
    digits = F.regexp_replace(h, r"[^\p{Nd}]", "")
    national = F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).otherwise(digits)
    return (
        F.when(h == "", "")
        .when(h.contains("@"), F.lower(h))
        .when(h.rlike(PHONE_PATTERN), F.concat(F.lit("+"), national))
        .otherwise(F.lower(h))
    )


def sha256_parts(*parts: Column) -> Column:
    """SHA-256 over the parts, each ended by a NUL byte."""
    end = F.lit("\x00")
    return F.sha2(F.concat(*[piece for part in parts for piece in (part, end)]), 256)


def handle_hash(salt: str, handle: Column) -> Column:
    return sha256_parts(F.lit(salt), normalize_handle(handle))


def normalize_name(name: Column) -> Column:
    return F.regexp_replace(casefold(strip(name)), rf"[{WS}]+", " ")


def name_hash(salt: str, name: Column) -> Column:
    return sha256_parts(F.lit(salt), F.lit("name"), casefold(strip(name)))


def contact_key(
    salt: str, handle: Column, name: Column, is_me: Column, keep_names: bool = True
) -> tuple[Column, Column]:
    """(salted hash, display name): the owner is never named, others only on request."""
    has_handle = F.coalesce(handle, F.lit("")) != ""
    has_name = F.coalesce(name, F.lit("")) != ""
    key = (
        F.when(is_me, handle_hash(salt, F.lit(OWNER_HANDLE)))
        .when(has_handle, handle_hash(salt, handle))
        .when(has_name, name_hash(salt, name))
    )
    shown = F.when(~is_me & (has_handle | has_name), name) if keep_names else F.lit(None)
    return key, shown.cast("string")


def content_hash(ts_iso: Column, text: Column) -> Column:
    return sha256_parts(ts_iso, text)


def is_owner(
    handle: Column,
    name: Column,
    names: Sequence[str] = (),
    emails: Sequence[str] = (),
    phones: Sequence[str] = (),
) -> Column:
    """True when the handle or the name is one of the owner's."""
    handles = [h for h in (*emails, *phones) if h.strip()]
    known_names = [n for n in names if n.strip()]
    by_handle = F.lit(False)
    if handles:
        mine = F.array(*[normalize_handle(F.lit(h)) for h in handles])
        by_handle = F.coalesce(
            (F.coalesce(handle, F.lit("")) != "") & F.array_contains(mine, normalize_handle(handle)),
            F.lit(False),
        )
    by_name = F.lit(False)
    if known_names:
        mine = F.array(*[normalize_name(F.lit(n)) for n in known_names])
        by_name = F.coalesce(
            (F.coalesce(name, F.lit("")) != "") & F.array_contains(mine, normalize_name(name)),
            F.lit(False),
        )
    return by_handle | by_name


def jid_to_handle(jid: Column) -> Column:
    """Messenger id to a handle: person ids become ``+digits``, groups and status NULL."""
    user = F.substring_index(jid, "@", 1)
    domain = F.when(jid.contains("@"), F.expr("NULL")).otherwise(F.lit(""))
    domain = F.coalesce(domain, F.regexp_extract(jid, r"(?s)^[^@]*@(.*)$", 1))
    return (
        F.when(jid.isNull() | (jid == ""), F.lit(None))
        .when(
            (domain == "s.whatsapp.net") & user.rlike(r"^\p{Nd}+$"), F.concat(F.lit("+"), user)
        )
        .when(domain.isin("g.us", "broadcast", "status", ""), F.lit(None))
        .otherwise(jid)
    )


def hash_long(*parts: Column) -> Column:
    """A positive 60-bit id from a SHA-256 prefix; the same in any engine."""
    return F.conv(F.substring(sha256_parts(*parts), 1, 15), 16, 10).cast("long")


def seeded_order(seed: int, *keys: Column) -> Column:
    """A deterministic stand-in for a seeded random draw: sort by this."""
    joined = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("long")


def in_holdout(conversation_id: Column, fraction: float = 0.05, seed: int = 7) -> Column:
    """Stable split: little-endian uint32 of sha256("seed:id") modulo 10 000 below the fraction."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), conversation_id.cast("string")), 256)
    swapped = F.concat(*[F.substring(digest, at, 2) for at in (7, 5, 3, 1)])
    bucket = F.conv(swapped, 16, 10).cast("long") % HOLDOUT_BUCKETS
    return bucket < int(fraction * HOLDOUT_BUCKETS)
