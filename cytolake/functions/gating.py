"""Boolean gating over marker columns: text to tree to column, and rule encodings.

Grammar: ``or := and ('|' and)*``, ``and := unit ('&' unit)*``, ``unit := '!' unit | '(' or ')' | name``. Signs other than
these are skipped. Markers without a column vanish when the column is built: a negation of nothing is nothing, and of a
pair with one side missing the other side remains. This differs from SQL's three-valued logic on purpose.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[\w-]+|[&|!()]")


@dataclass(frozen=True)
class Gate:
    kind: str  # name, not, and, or
    name: str = ""
    parts: tuple[Gate, ...] = ()

    def markers(self) -> list[str]:
        return [self.name] if self.kind == "name" else list(dict.fromkeys(m for p in self.parts for m in p.markers()))

    def __str__(self) -> str:
        if self.kind == "name":
            return self.name
        if self.kind == "not":
            return f"!{self.parts[0]}" if self.parts[0].kind in ("name", "not") else f"!({self.parts[0]})"
        return (" & " if self.kind == "and" else " | ").join(f"({p})" if p.kind in ("and", "or") else str(p) for p in self.parts)


def parse(text: str, known: Collection[str] | None = None) -> Gate:
    """The tree of an expression. known: the markers that may occur; others are an error."""
    tokens = _TOKEN.findall(text)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("unexpected end of expression")
        at += 1
        return tokens[at - 1]

    def chain(sign: str, kind: str, below) -> Gate:
        parts = [below()]
        while peek() == sign:
            take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Gate(kind, parts=tuple(parts))

    def unit() -> Gate:
        t = take()
        if t == "!":
            return Gate("not", parts=(unit(),))
        if t == "(":
            inner = either()
            if peek() != ")":
                raise ValueError("missing )")
            take()
            return inner
        if t in "&|)":
            raise ValueError(f"unexpected {t}")
        if known is not None and t not in known:
            raise ValueError(f"unknown marker {t}")
        return Gate("name", t)

    def both() -> Gate:
        return chain("&", "and", unit)

    def either() -> Gate:
        return chain("|", "or", both)

    gate = either()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()}")
    return gate


def mask(gate: Gate, columns: Collection[str]) -> Column | None:
    """The gate as a boolean column over the existing columns; None if none of its markers has one."""
    if gate.kind == "name":
        return F.col(gate.name) if gate.name in columns else None
    parts = [m for m in (mask(p, columns) for p in gate.parts) if m is not None]
    if not parts:
        return None
    if gate.kind == "not":
        return ~parts[0]
    out = parts[0]
    for m in parts[1:]:
        out = out & m if gate.kind == "and" else out | m
    return out


def operands(gate: Gate) -> dict[str, list[str]]:
    """Markers by role: ``must``, ``either`` (below any OR) and ``never`` (directly negated)."""
    out: dict[str, list[str]] = {"must": [], "either": [], "never": []}

    def walk(g: Gate, below_or: bool) -> None:
        if g.kind == "name":
            out["either" if below_or else "must"].append(g.name)
        elif g.kind == "not" and g.parts[0].kind == "name":
            out["never"].append(g.parts[0].name)
        else:
            for p in g.parts:
                walk(p, below_or or g.kind == "or")

    walk(gate, False)
    return out


def encoding(channels: list[str], primary: str, secondary: str = "", tertiary: str = "") -> dict[str, int]:
    """Per channel: 1 must, 2 one of, -3 explicitly not, 0 optional, -1 not in the rule. ``secondary`` and ``tertiary``, markers
    apart by ``|``, only fill what the primary expression leaves open."""
    out = dict.fromkeys(channels, -1)
    if primary and primary.strip():
        roles = operands(parse(primary))
        for role, code in (("must", 1), ("either", 2), ("never", -3)):
            out.update({m: code for m in roles[role] if m in out})
    for m in f"{secondary or ''}|{tertiary or ''}".split("|"):
        if out.get(m.strip()) == -1:
            out[m.strip()] = 0
    return out


def encoded(rules: DataFrame, channels: list[str]) -> DataFrame:
    """(rule, channel, code) of a marker table (cell_type, primary, secondary, tertiary), one row per cell type, whose rules are read
    on the driver: a table of a panel's few types."""
    rows = rules.select("cell_type", "primary", "secondary", "tertiary").collect()
    return rules.sparkSession.createDataFrame([(r[0], c, code) for r in rows for c, code in encoding(channels, *r[1:]).items()], "rule string, channel string, code int")


def soft_not(own: dict[str, int], other: dict[str, int]) -> dict[str, int]:
    """own, with channels that only the overlapping other rule requires marked -3."""
    if not any(own[c] > 0 and other.get(c, -1) > 0 for c in own):
        return dict(own)
    covered = all(own[c] >= 0 for c in own if other.get(c) == 1)
    return {c: -3 if v == -1 and (other.get(c) == 1 or other.get(c) == 2 and covered) else v for c, v in own.items()}
