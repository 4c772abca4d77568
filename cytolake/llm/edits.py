"""Whether many pairs of lines are within a number of edits each, all at once.

The table of distances of two lines is walked along its antidiagonals, whose cells do not depend on one another: one step
takes the cells of all pairs. Alignments of at most ``most`` edits stay on ``most`` + 1 diagonals, so no others are
walked, and pairs all of whose cells are beyond that are left behind. Distances are held in bytes, and stop at ``CAP``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Distances are told apart below this; pairs that allow so many edits are not for ``within``.
CAP = 239
#: Steps after which distances are cut at CAP: they grow by one in each. Steps after which pairs are left behind.
_STEPS, _LOOK = 16, 64
#: Cells of one step, about, and pairs that take it together.
_CELLS, _PAIRS = 1 << 15, 2048
#: Pairs of one length that are worth a walk.
_WORTH = 96


def _codes(lines: list[bytes]) -> np.ndarray:
    """The characters of all lines, in as few bytes as hold them."""
    joined = b"".join(lines)
    if joined.isascii():
        return np.frombuffer(joined, np.uint8)
    points = np.frombuffer("".join(x.decode("utf-8", "surrogatepass") for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points.astype(np.uint8 if (top := points.max()) < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _columns(codes: np.ndarray, size: np.ndarray, rows: int, before: int) -> np.ndarray:
    """(rows, lines): a line's characters down a column, from row ``before`` on."""
    out = np.zeros((len(size), rows), codes.dtype)
    at = np.arange(rows) - before
    out[(at >= 0) & (at < size[:, None])] = codes
    return np.ascontiguousarray(out.T)


def _walked(a: list[bytes], b: list[bytes], m: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``within`` of pairs in the order of m + n, with m >= n and m - n <= most."""
    more, end = m - n, m + n
    low, high, last = -int(((most - more) // 2).max()), int((more + (most - more) // 2).max()), int(end[-1])
    x, y = _codes(a), _codes(b)
    kind = np.promote_types(x.dtype, y.dtype)
    # of a cell (i, j), i - j being its diagonal: row i + up of x, and row down - j of y, which is turned over
    up, rows = 1 - low, (last + high) // 2 + 3 - low
    x = _columns(x.astype(kind, copy=False), m, rows, up + 1)
    down = (last - low) // 2 + 1
    y = np.ascontiguousarray(_columns(y.astype(kind, copy=False), n, down + high + 2, high + 2)[::-1])
    down = len(y) - 1 - (high + 1)
    # a table for the diagonals low, low + 2 and so on, and one for those between; no cell stands above and below either
    tables = [np.full(((high - low - k) // 2 + 3, len(m)), CAP, np.uint8) for k in (0, 1)]
    caps, unlike, step = (np.full(tables[0].shape, CAP, np.uint8) for _ in range(3))
    tables[-low % 2][-low // 2 + 1] = 0
    out, at, done = np.zeros(len(m), bool), np.arange(len(m)), int(np.searchsorted(end, 0, "right"))
    out[:done] = True
    for s in range(1, last + 1):
        odd = (s + low) % 2
        own, other = tables[odd], tables[1 - odd]
        count, i, j = len(own) - 2, (s + low + odd) // 2 + up, down - (s - low - odd) // 2
        cells, differ, least = own[1 : count + 1], unlike[:count], step[:count]
        np.not_equal(x[i : i + count], y[j : j + count], out=differ.view(bool))
        np.add(cells, differ, out=cells)
        np.minimum(other[odd : odd + count], other[odd + 1 : odd + 1 + count], out=least)
        np.add(least, np.uint8(1), out=least)
        np.minimum(cells, least, out=cells)
        if s % _STEPS == 0:
            for table in tables:
                np.minimum(table, caps[: len(table)], out=table)
        if done < len(end) and end[done] == s:
            to = int(np.searchsorted(end, s, "right"))
            now = np.arange(done, to)
            out[at[now]] = own[(more[now] - low - odd) // 2 + 1, now] <= most[now]
            done = to
        if s % _LOOK == 0:
            left = np.minimum(tables[0].min(0), tables[1].min(0)) <= most
            left[:done] = False
            if not left.any():
                break
            if 4 * left.sum() < 3 * len(left):
                x, y, caps, unlike, step, *tables = (np.ascontiguousarray(z[:, left]) for z in (x, y, caps, unlike, step, *tables))
                at, more, end, most, done = at[left], more[left], end[left], most[left], 0
    return out


def within(a: list[bytes], b: list[bytes], m: np.ndarray, n: np.ndarray, most: np.ndarray, alone: Callable[[int], bool]) -> np.ndarray:
    """Whether the edit distance of each pair of lines, of m and n characters, is at most its number, which is below CAP. Pairs of which
    too few have about their length are left to ``alone``, by their place."""
    out = np.zeros(len(a), bool)
    plain, both = np.array([x.isascii() and y.isascii() for x, y in zip(a, b, strict=True)], bool), m + n
    order = np.lexsort((both, plain))
    order = order[np.abs(m - n)[order] <= most[order]]
    lo = 0
    while lo < len(order):
        part = order[lo : lo + _PAIRS]
        part = part[(plain[part] == plain[part[0]]) & (both[part] <= 1.5 * both[part[0]] + 64)]
        part = part[: max(64, 2 * _CELLS // (1 + int(most[part[-1]])))]
        lo += len(part)
        if both[part].sum() < _WORTH * both[part[-1]]:
            out[part] = [alone(k) for k in part.tolist()]
            continue
        swap = m[part] < n[part]
        long, short = zip(*((b[k], a[k]) if s else (a[k], b[k]) for k, s in zip(part.tolist(), swap.tolist(), strict=True)), strict=True)
        out[part] = _walked(list(long), list(short), np.maximum(m[part], n[part]), np.minimum(m[part], n[part]), most[part])
    return out
