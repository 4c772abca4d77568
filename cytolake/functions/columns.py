"""Column expressions: transforms, missing values, labels and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MERGED = "-mergedInto("


def nz(c: Column) -> Column:
    """NaN as NULL: aggregates then skip what was not measured."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def feature(c: Column) -> Column:
    """A model feature: missing is 0."""
    return F.coalesce(nz(c.cast("double")), F.lit(0.0))


def arcsinh(c: Column, cofactor: float = 1.0) -> Column:
    if cofactor <= 0:
        raise ValueError("cofactor must be positive")
    return F.asinh(c / F.lit(float(cofactor)))


def square_root(c: Column) -> Column:
    return F.sqrt(F.greatest(c, F.lit(0.0)))


def symlog(c: Column) -> Column:
    """log10(1 + x) for positive values, 0 below (linear threshold 1)."""
    return F.log10(F.lit(1.0) + F.greatest(c, F.lit(0.0)))


def transformed(columns: Sequence[str], transforms: dict[str, str], cofactors: dict[str, float] | None = None) -> list[Column]:
    """A select list: each column as a feature, transformed by name ("arcsinh", "sqrt"); other names leave it as it is."""
    out = []
    for name in columns:
        c = feature(F.col(name))
        kind = (transforms.get(name) or "none").lower()
        if kind == "arcsinh":
            c = arcsinh(c, (cofactors or {}).get(name, 1.0))
        elif kind == "sqrt":
            c = square_root(c)
        out.append(c.alias(name))
    return out


def vector(columns: Sequence[str], transforms: dict[str, str] | None = None, cofactors: dict[str, float] | None = None) -> Column:
    return F.array(*transformed(columns, transforms or {}, cofactors))


def effective_class(raw: Column) -> Column:
    """The class that a raw label counts as: what the first merge leads to."""
    at = F.instr(raw, MERGED)
    merged = (at > 0) & F.endswith(raw, F.lit(")"))
    start = at + len(MERGED)
    return F.when(merged, F.substr(raw, start, F.length(raw) - start)).otherwise(raw)


def original_class(raw: Column) -> Column:
    """The innermost class of a raw label."""
    return F.substring_index(raw, MERGED, 1)


def merged_label(raw: Column, sources: Sequence[str], target: str) -> Column:
    """Labels of the source classes, redirected to target."""
    e = effective_class(raw)
    return F.when(e.isin(*sources) & (e != target), F.concat(original_class(raw), F.lit(f"{MERGED}{target})"))).otherwise(raw)


def unmerged_label(raw: Column, target: str) -> Column:
    return F.when(F.endswith(raw, F.lit(f"{MERGED}{target})")), original_class(raw)).otherwise(raw)


def renamed_label(raw: Column, old: str, new: str) -> Column:
    return F.when(effective_class(raw) == old, F.lit(new)).otherwise(raw)


def argmax(a: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def average_label(p1: Column, p2: Column, classes: Column) -> Column:
    return F.element_at(classes, argmax(F.zip_with(p1, p2, lambda a, b: (a + b) / 2)) + 1)


def all_label(m1: Column, m2: Column) -> Column:
    return F.when(m1 == m2, m1).otherwise(F.concat_ws("/", m1, m2))


def confidence(label: Column, probs: Column, classes: Column) -> Column:
    """Probability of a row's own label; that of the first class for an unknown one."""
    return F.element_at(probs, F.greatest(F.array_position(classes, label), F.lit(1)).cast("int"))


def diversity(fractions: Column, n_types: int) -> Column:
    """Shannon entropy over its largest value, at most 1; 0 for fewer than two types."""
    if n_types < 2:
        return F.lit(0.0)
    h = F.aggregate(F.filter(fractions, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log(p))
    return F.least(h / F.log(F.lit(float(n_types))), F.lit(1.0))


def marker_group(name: Column) -> Column:
    """The part of a measurement name that stands for its marker."""
    head = F.when(F.instr(name, ": ") > 1, F.substring_index(name, ": ", 1)).otherwise(F.regexp_extract(name, r"^([^_ ]+)[_ ]", 1))
    return F.lower(F.when(head == "", name).otherwise(head))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def annotation_label(name: Column, kind: Column) -> Column:
    has_name, has_kind = F.coalesce(F.trim(name) != "", F.lit(False)), F.coalesce(F.trim(kind) != "", F.lit(False))
    tag = F.concat(F.lit("["), kind, F.lit("]"))
    return F.when(has_name & has_kind, F.concat_ws(" ", name, tag)).when(has_name, name).when(has_kind, tag).otherwise("Annotation")


def wkt(points: Column, scale: float = 1.0) -> Column:
    """POLYGON text of an array of (x, y), closed, two decimals."""
    closed = F.concat(points, F.slice(points, 1, 1))
    text = F.transform(closed, lambda p: F.format_string("%.2f %.2f", p["x"] * scale, p["y"] * scale))
    return F.concat(F.lit("POLYGON (("), F.array_join(text, ", "), F.lit("))"))


def inside(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Even-odd containment in a literal polygon."""
    hits = F.lit(0)
    for (xi, yi), (xj, yj) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
        if yi == yj:
            continue
        crosses = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < (xj - xi) * (y - yi) / (yj - yi + (1e-12 if abs(yj - yi) < 1e-12 else 0.0)) + xi)
        hits = hits + crosses.cast("int")
    return hits % 2 == 1


def inside_array(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd containment in a polygon column, an array of (x, y)."""
    n = F.size(polygon)
    edges = F.zip_with(polygon, F.concat(F.slice(polygon, n, 1), F.slice(polygon, 1, n - 1)), lambda a, b: F.struct(a["x"].alias("xi"), a["y"].alias("yi"), b["x"].alias("xj"), b["y"].alias("yj")))
    crosses = lambda e: ((e["yi"] > y) != (e["yj"] > y)) & (x < (e["xj"] - e["xi"]) * (y - e["yi"]) / F.when(e["yj"] == e["yi"], 1e-12).otherwise(e["yj"] - e["yi"]) + e["xi"])
    return F.aggregate(edges, F.lit(0), lambda s, e: s + F.when(crosses(e), 1).otherwise(0)) % 2 == 1
