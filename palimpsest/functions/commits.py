"""Cleaning commit messages down to what a person wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import WS, strip

# Fixed values.
BOILERPLATE = (
    r"(?i)^(?:merge\b|initial commit\b|bump version|bump \S+ from|release v?\d"
    r"|v?\d+\.\d+(?:\.\d+)?$|update (?:readme(?:\.md)?|\S+\.md)$"
    r"|apply suggestions from code review|revert \"|chore\(deps|\[skip ci\]|wip$)"
)
BOT = (
    r"(?i)co-authored-by:.*(?:claude|copilot|\[bot\]|anthropic|openai|dependabot)"
    r"|generated with \[?claude|\x{1F916} generated"
)
TRAILER = (
    r"(?i)^(?:signed-off-by|co-authored-by|change-id|reviewed-by|acked-by|tested-by|cc|fixes"
    r"|closes|resolves|refs?|see-also|claude-session|ticket|jira):[" + WS + "]"
)


def clean_commit_message(body: Column) -> Column:
    """Message without trailers; NULL for bots, boilerplate and empty remains."""
    lines = F.transform(
        F.split(strip(body), "\n"), lambda x: F.regexp_replace(x, rf"[{WS}]+\z", "")
    )
    kept = F.filter(lines, lambda x: ~F.regexp_like(strip(x), F.lit(TRAILER)))
    text = strip(F.array_join(kept, "\n"))
    human = ~body.rlike(BOT) & ~strip(F.get(lines, F.lit(0))).rlike(BOILERPLATE)
    return F.when(human & (text != ""), text)
