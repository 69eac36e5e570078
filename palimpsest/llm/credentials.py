"""Secret scans: base patterns, and parts of a credential that only count together.

Base spans are assignments to a secret's name, access identifiers and long hexadecimal strings.
Further parts are too weak to report alone:

    key_id    a named identifier (``user``, ``login``, ``client_id``, ``account`` ...) and its value
    opaque    a string of 20 or more of [A-Za-z0-9+/_=-] with lower case, upper case and digits
    endpoint  a URL with a host, or a named ``host``/``endpoint``/``server`` and its value

Parts are intervals. A weak part is reported when it lies within ``REACH`` code points of a
complementary part, base spans included, in one scope: an identifier needs a secret, a secret an
identifier or an endpoint, and an endpoint both a secret and an identifier. Scopes are the
paragraphs of a text (blank lines part them). The join sweeps each scope's intervals by start.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.arrays import frame, over_texts, strings

KINDS = ("assign", "access", "hex")
WEAK = ("key_id", "opaque", "endpoint")
REACH = 200

_NAMES = re.compile("passw|secret|token|api_?key", re.I | re.A)
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A,
)
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}+")
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}+")
_KEY_ID = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_id|access_id|key_id)["']?\x20{0,8}[:=]\x20{0,8}["']?([A-Za-z0-9@+/_.-]{3,}+)""",
    re.I | re.A,
)
_OPAQUE = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
_ENDPOINT = re.compile(
    r"""(?:(?:https?|ftp|ssh|jdbc|postgres|mysql|redis|amqp)://[A-Za-z0-9.-]+[^\s"'<>]*|(?<![A-Za-z0-9])(?:host|endpoint|server)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9.-]{3,}+(?::[0-9]+)?)""",
    re.I | re.A,
)
_SCOPE = re.compile(r"\n[\x20\t\r]*+\n")
# what a part stands for: an identifier, a secret or an endpoint
_ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "id", "key_id": "id", "endpoint": "endpoint"}
_NEEDS = {"id": ({"secret"},), "secret": ({"id", "endpoint"},), "endpoint": ({"secret"}, {"id"})}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The three kinds, each leftmost and non-overlapping; matches that fail are dropped."""
    spans: list[Span] = []
    if _NAMES.search(text):
        spans += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    spans += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[0], (*KINDS, *WEAK).index(span[2])


def weak_parts(text: str) -> list[Span]:
    """Parts that count only beside complementary ones."""
    parts = [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)] if ":" in text or "=" in text else []
    if ":" in text or "=" in text:
        parts += [(*m.span(), "key_id") for m in _KEY_ID.finditer(text)]
    for m in _OPAQUE.finditer(text):
        value = m.group()
        if (
            re.search("[0-9]", value)
            and re.search("[a-z]", value)
            and re.search("[A-Z]", value)
        ):
            parts.append((*m.span(), "opaque"))
    return sorted(parts, key=_order)


def linked(text: str, base: list[Span]) -> list[Span]:
    """Weak parts with all the complementary parts they need nearby in their scope."""
    taken = ([s[0] for s in base], list(accumulate((s[1] for s in base), max)))
    weak = [w for w in weak_parts(text) if not _near(w, taken, -1)]
    if not weak:
        return []
    marks = [m.start() for m in _SCOPE.finditer(text)]
    scope_of = lambda s: bisect_left(marks, s[0])
    found = []
    # starts, and the largest end so far, of each role in each scope: both ascend
    by: dict[tuple[int, str], tuple[list[int], list[int]]] = {}
    for part in sorted(base + weak):
        starts, tops = by.setdefault((scope_of(part), _ROLE[part[2]]), ([], []))
        starts.append(part[0])
        tops.append(max(part[1], tops[-1] if tops else 0))
    for part in weak:
        if all(
            any(_near(part, by.get((scope_of(part), role))) for role in wanted)
            for wanted in _NEEDS[_ROLE[part[2]]]
        ):
            found.append(part)
    return found


def _near(part: Span, others: tuple[list[int], list[int]] | None, reach: int = REACH) -> bool:
    """Is one of the intervals (starts and largest ends so far) at most ``reach`` away?

    Touching intervals are 0 apart; -1 asks for an overlap.
    """
    if others is None:
        return False
    before = bisect_left(others[0], part[1] + reach + 1)
    return before > 0 and others[1][before - 1] >= part[0] - reach


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``.

    Offsets count code points, ends are exclusive; spans holds base spans and linked weak parts by
    start, then kind. A null text is empty. Repeated rows are reported each. Other columns are not
    read.
    """
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(f"n_{k}", pa.int64()) for k in KINDS]
        + [("base_sha256", pa.string()), ("spans", pa.string())]
    )

    def fn(batches):
        for ids, texts in strings(batches):
            rows: dict[str, list] = {f.name: [] for f in schema}
            for text in texts:
                base = base_spans(text)
                spans = sorted(base + linked(text, base), key=_order)
                named = [",".join(f"{k}:{a}:{b}" for a, b, k in x) for x in (base, spans)]
                for kind in KINDS:
                    rows[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                rows["base_sha256"].append(hashlib.sha256(named[0].encode()).hexdigest())
                rows["spans"].append(named[1])
            rows["doc_id"] = ids
            yield frame(schema, **rows)

    return over_texts(
        docs, fn, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
