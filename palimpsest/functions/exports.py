"""Chat-export lines: header layouts, sender and body, notices, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import WS, strip

# --- fixed values -----------------------------------------------------------------------
MARKS = "\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}"
DATE = r"(\d{1,4}[./-]\d{1,2}[./-]\d{1,4})"
TIME = rf"(\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:[{WS}]*(?:[AaPp]\.?[{WS}]?[Mm]\.?|ÖÖ|ÖS))?)"
BRACKETED = rf"^[{MARKS}]*\[{DATE},?[{WS}]+{TIME}\][{WS}]?(.*)$"
DASHED = rf"^[{MARKS}]*{DATE},?[{WS}]+{TIME}[{WS}][-–—][{WS}](.*)$"
SENDER = rf"(?s)^([^:\n]{{1,80}}?):[{WS}]?(.*)$"
PHONE_SENDER = rf"^\+?[\p{{Nd}}{WS}().\-]{{6,}}$"
MEDIA = (
    r"(?iu)omitted|attached:|dahil edilmedi|deleted|silindi|missed|cevapsız|location:|konum:"
)
NOTICE = (
    r"(?iu)^(?:messages and calls are end-to-end encrypted"
    r"|mesajlar ve aramalar uçtan uca şifreli|your security code with"
    r"|.{1,60}? (?:created group|grubu oluşturdu|changed the subject"
    r"|konuyu .{0,80}değiştirdi|changed this group's|changed the group description"
    r"|joined using this group's invite link|davet bağlantısı))"
)
TITLE_PREFIXES = [
    "WhatsApp Chat with ",
    "WhatsApp Chat - ",
    "WhatsApp Sohbeti - ",
    "WhatsApp Chat ",
]
MEDIA_TEXT = "<Media omitted>"
# ----------------------------------------------------------------------------------------


def header(line: Column) -> Column:
    """struct(date, time, rest) for a line that starts a message, else NULL."""
    bracketed = line.rlike(BRACKETED)
    part = lambda i: F.when(bracketed, F.regexp_extract(line, BRACKETED, i)).otherwise(
        F.regexp_extract(line, DASHED, i)
    )
    date = part(1)
    # One separator throughout: "1.2/24" is not a date.
    uniform = F.size(F.array_distinct(F.regexp_extract_all(date, F.lit(r"[./-]"), F.lit(0)))) == 1
    return F.when(
        (bracketed | line.rlike(DASHED)) & uniform,
        F.struct(date.alias("date"), part(2).alias("time"), part(3).alias("rest")),
    )


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{MARKS}]", "")


def sender_and_body(rest: Column) -> Column:
    """struct(sender, body) of a chat line, NULL for a system line.

    Marked text was written by the app: media becomes a placeholder, the rest is a notice.
    """
    sender = strip(without_marks(F.regexp_extract(rest, SENDER, 1)))
    raw = F.regexp_extract(rest, SENDER, 2)
    marked = strip(raw).rlike(r"^[\x{200E}\x{200F}]")
    body = strip(without_marks(raw))
    shown = F.when(marked, F.when(body.rlike(MEDIA), F.lit(MEDIA_TEXT))).otherwise(
        F.when(~body.rlike(NOTICE), body)
    )
    return F.when(
        rest.rlike(SENDER) & (sender != "") & shown.isNotNull(),
        F.struct(sender.alias("sender"), shown.alias("body")),
    )


def title_from_name(name: Column) -> Column:
    title = name
    for prefix in reversed(TITLE_PREFIXES):
        title = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 20)).otherwise(
            title
        )
    return title
