"""Words of whole texts and their hashes, by batches. A word is a run of ``[^\\x20\\x09-\\x0D]``: exactly what
``bytes.split()`` separates in UTF-8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MIX = np.uint64(0x9E3779B97F4A7C15)


def encode(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def stacked(values: pa.Array | pa.ChunkedArray | np.ndarray | list[bytes], kind: type = np.uint8) -> np.ndarray:
    """Rows of numbers: the bytes of values that are all of one length, none null."""
    if isinstance(values, np.ndarray):
        return np.ascontiguousarray(values).view(kind)
    if isinstance(values, list):
        return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)
    if isinstance(values, pa.ChunkedArray):
        return np.concatenate([stacked(x, kind) for x in values.chunks if len(x)])
    edge = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[edge[0] : edge[-1]].view(kind).reshape(len(values), -1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    z = y >> np.uint64(27)
    y ^= z
    y *= np.uint64(0x94D049BB133111EB)
    np.right_shift(y, np.uint64(31), out=z)
    y ^= z
    return y


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words; the whole sequence where there are fewer; none of no words."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(width), np.uint64)
        for i in range(width):
            out = mix(out * _MIX + h[i : i + n])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


_ODD = 0x9FB21C651E98DF25
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _MIX)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, up to n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        steps = np.empty((2, n), np.uint64)
        steps[0, 1:], steps[1, 1:], steps[:, 0] = _ODD, pow(_ODD, -1, 2**64), 1
        with np.errstate(over="ignore"):
            found = list(np.multiply.accumulate(steps, axis=1))
        if n > 1 << 21:
            return found
        _POWERS[:] = found
    return _POWERS


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges start to end of bytes, none empty: equal ones for equal bytes. A sum of the bytes' values, each times the
    power of its place, is divided by the power of the start."""
    powers, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        total = _BYTES[data]
        total *= powers[: len(data)]
        np.cumsum(total, out=total)
        before = np.where(start > 0, total[start - 1], np.uint64(0))
        return mix((total[end - 1] - before) * inverse[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list, width: int, lower: bool = True) -> list[np.ndarray]:
    """Of each whole text the sorted distinct hashes of its shingles; A-Z is lower-cased first."""
    parts = [x.lower() if lower else x for x in map(encode, texts)]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    space = _SPACE[data]
    after = np.r_[True, space[:-1]]
    start, end = np.flatnonzero(~space & after), np.flatnonzero(space & ~after)
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    h = run_hashes(data, start, end)
    edge = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in parts)])).tolist()
    whole = shingles(h, width) if len(h) >= width else h[:0]
    out = []
    for a, b in zip(edge, edge[1:], strict=False):
        found = whole[a : b - width + 1] if b - a >= width else shingles(h[a:b], width)
        found = np.sort(found)
        out.append(found[np.r_[True, found[1:] != found[:-1]]] if len(found) > 1 else found)
    return out


def runs(texts: list, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` characters together; a longer text is alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = 64 + len(t or "")
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
