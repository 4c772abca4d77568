"""Fixed-value tables for checking resampling: value(i, f) = ((31 i + 7 f) mod 97) / 97 + class * spread, i counting rows
of all classes in order, rows then taken in steps of 7919."""

from __future__ import annotations

import numpy as np

#: Rows per class, features, spread.
CASES = {"moderate": ((200, 60, 20), 8, 0.30), "severe": ((500, 5, 40), 6, 0.25), "wide": ((160, 90, 50), 40, 0.05)}


def rows(name: str) -> list[tuple[int, list[float], int]]:
    counts, p, spread = CASES[name]
    classes = [c for c, n in enumerate(counts) for _ in range(n)]
    n = len(classes)
    made = [([float(np.float32((i * 31 + f * 7) % 97) / np.float32(97) + np.float32(c) * np.float32(spread)) for f in range(p)], c) for i, c in enumerate(classes)]
    return [(k, *made[k * 7919 % n]) for k in range(n)]
