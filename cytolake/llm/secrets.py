"""Secret scans with multipart credential linking.

Strong spans (kinds ``assign``, ``access`` and ``hex``) are reported wherever they stand. Weak candidates are reported
only when complementary parts co-occur within one scope, the ``scope`` code points between two spans of a text:

* ``ident``, a user or client name after its keyword: near an assigned or an opaque secret;
* ``opaque``, a long token of mixed letters and digits: near an access id or an identity;
* ``endpoint``, a URL, connection string or host: near both a secret and an access id or identity.

The link is an interval join: the spans of each side are sorted by start, and for each candidate a binary search finds
whether the running furthest end of the other side reaches its scope. Texts are the widest scope, so the join runs where
the text is, and nothing is shuffled. All offsets are code points, ends exclusive. A null text is an empty one: no
spans, and the hash of the empty string.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns of the strong spans.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
IDENT = re.compile(r"\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]{3,})", re.I | re.A)
ENDPOINT = re.compile(r"\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\s\"'<>]+|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+(?::[0-9]+)?", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_IDENT_WORDS = ("user", "login", "account", "client", "access")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def strong(text: str) -> dict[str, list[tuple[int, int]]]:
    low = text.lower()
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if any(w in low for w in _ASSIGN_WORDS) else [],
        "access": [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def _mixed(token: str) -> bool:
    """Whether a token looks drawn at random: ten kinds of characters and four digits beside four others, or capitals and
    small letters that change about as often as in a random key (names in camel case change seldom)."""
    digits, n = sum(c.isdigit() for c in token), len(token)
    if len(set(token)) < 10:
        return False
    kinds = ["A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "-" for c in token]
    changes = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
    return digits >= 4 and n - digits >= 4 or {"A", "a"} <= set(kinds) and 10 * changes >= 4 * (n - 1)


def weak(text: str, base: dict) -> dict[str, list[tuple[int, int]]]:
    """Weak candidates that overlap no strong span; none where a text has no access id and no identity, without which
    nothing weak can be complete."""
    taken = sorted(s for spans in base.values() for s in spans)
    starts = [a for a, _ in taken]
    furthest = list(itertools.accumulate((b for _, b in taken), max))

    def free(spans: list) -> list:
        """Those that begin at or behind the furthest end of all strong spans that begin before they end."""
        return [(a, b) for a, b in spans if not (i := bisect.bisect_left(starts, b)) or furthest[i - 1] <= a]

    low = text.lower()
    ident = free([m.span() for m in IDENT.finditer(text)]) if any(w in low for w in _IDENT_WORDS) else []
    if not ident and not base["access"]:
        return {"ident": [], "opaque": [], "endpoint": []}
    return {"ident": ident, "opaque": free([m.span() for m in OPAQUE.finditer(text) if _mixed(m[0])]), "endpoint": free([m.span() for m in ENDPOINT.finditer(text)])}


def near(left: list[tuple[int, int]], right: list[tuple[int, int]], scope: int) -> list[bool]:
    """Whether each left span has a right span with at most ``scope`` code points between them."""
    if not left or not right:
        return [False] * len(left)
    right = sorted(right)
    starts, furthest = np.array([a for a, _ in right]), np.maximum.accumulate([b for _, b in right])
    at = np.searchsorted(starts, np.array([b for _, b in left]) + scope, side="right") - 1
    return [i >= 0 and furthest[i] >= a - scope for i, (a, _) in zip(at, left, strict=True)]


def link(base: dict, found: dict, scope: int) -> dict[str, list[tuple[int, int]]]:
    """The weak candidates whose complement stands within their scope."""
    secrets, names = base["assign"] + found["opaque"], base["access"] + found["ident"]
    keep = lambda spans, *sides: [s for s, ok in zip(spans, zip(*(near(spans, x, scope) for x in sides), strict=True), strict=True) if all(ok)]
    return {"ident": keep(found["ident"], secrets), "opaque": keep(found["opaque"], names), "endpoint": keep(found["endpoint"], secrets, names)}


def listed(spans: dict) -> str:
    rows = sorted((a, KINDS.index(k), b) for k, xs in spans.items() for a, b in xs)
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def scan(text, scope: int = 300) -> tuple:
    text = text or ""
    base = strong(text)
    more = link(base, weak(text, base), scope)
    digest = hashlib.sha256(listed(base).encode()).hexdigest()
    return len(base["assign"]), len(base["access"]), len(base["hex"]), digest, listed(base | more)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """One row per document: counts of strong spans, the hash of their list, and the list of all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(scan(t, scope) for t in batch.column(1).to_pylist()), strict=True)) or [()] * 5
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
