"""Fuzzy line dedup: near-equal lines of all documents, of which one occurrence stays per connected group.

Lines are normalised (lower case, digits to 0, signs to spaces); those of which nothing is left are left alone. Lines of
fewer than ``min_words`` words and fewer than ``LONG`` bytes are grouped by their exact normalised form only. Equal
normalised lines are one class by a 128-bit hash. Of every other class a ``BITS``-bit SimHash of its words is cut into
``BLOCKS`` pigeonhole blocks: two fingerprints that differ in fewer bits than there are blocks share one. An edit
similarity of ``least`` percent is far beyond that bound, so the join has ``MINIMA`` further keys a line, the smallest
hashes of its windows: of characters in lines of few words, of three words in longer and of five in long ones, with two kinds
in between. Classes with a common key are candidates. Those pass whose lengths and, in lines of few
words, counts of character pairs allow the edit distance (bounds that lose nothing); of lines with WORDY words no larger share of the words, and two
more, may differ than of the characters. The distance of the normalised lines itself confirms a similarity (1 - distance / longer length) of at
least ``least`` percent. So long lines in which most words are misspelt are not found. Groups are the connected components;
how keys that many lines share are treated is told in ``linking``.

Within a group the first occurrence stays, in order of (document id, line number); all others go from their documents, whose
other lines keep their text and order. Only the few numbers of a line occurrence are shuffled, the texts of candidates
are read again by document and line, and texts are rewritten where they are read from the numbers of their dropped lines.

Null texts stay null; empty ones stay empty. Rows with one id and different texts are separate documents, in the order of
a hash; repeated rows (equal id and text) are one document and get equal results. Null ids come last. Other columns pass
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edits import CAP, within
from .linking import BUCKETS, PACKED, buckets, link, packed, verified
from .shared import FORGET, Tables, lean, semi, small_enough
from .words import encode, mix, run_hashes, runs, stacked

BITS, BLOCKS = 96, 3
#: Keys of the windows of a line.
MINIMA = 6
#: Kinds of windows: their width and the numbers of words from which and below which a line has them. A line with two kinds
#: has half of the keys of each.
CHARACTERS, THREE, FIVE = (6, 0, 10), (3, 7, 25), (5, 16, 1 << 31)
#: Pairs of characters of lines of few words are counted in so many bins, and words in so many, which count from WORDY words on.
PAIRS, BINS, WORDY = 64, 128, 5
#: Lines of few words are compared too if they have so many bytes of UTF-8: scripts without spaces have long words.
LONG = 24
_OCCURRENCES = "doc_id long, row long, line long, h binary, id long, sig binary"
#: Words after a difference in which lines are looked through for a common one.
AHEAD = 6
#: Lines of which a smaller percentage of the words is common are not aligned by words.
COMMON = 70
#: Lines of so many characters have their pairs of characters compared before the edit distance.
COUNTED = 256
#: Lines of so many characters have them compared before their words are aligned; words of lines of fewer than ALIGNED are not aligned.
COUNTED_FIRST, ALIGNED = 1024, 96
#: Columns of the table of distances between two looks at what they have come to.
_COLUMNS = 16
#: Stands for no id, above all of them.
_NONE = 1 << 62
#: Signs become spaces and digits 0; letters are lower-cased before.
_PLAIN = bytes(48 if 48 <= c <= 57 else c if c == 10 or c >= 128 or 97 <= c <= 122 or 65 <= c <= 90 else 32 for c in range(256))
#: Spaces of longer texts are put together by arrays.
_SHORT = 1 << 12
#: So many words are counted in one byte; longer lines are summed by parts.
_PART = 255
#: The eight bits of each byte as eight counters of a byte.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(256)
#: New lines that are looked at together, and their bytes.
_LINES, _BYTES = 2048, 1 << 18
#: Hashes of lines that a task remembers before it forgets them all, so that a line is signed once.
_SEEN = 1 << 18


def lines_of(text) -> list[str]:
    return (text or "").split("\n")


def normalised(text) -> list[bytes]:
    """Of each line its words in lower case, digits as 0 and signs as spaces, one space apart."""
    flat = encode((text or "").lower()).translate(_PLAIN)
    if len(flat) > _SHORT:
        space = np.frombuffer(flat, np.uint8) == 32
        space[1:] &= space[:-1].copy()
        space[0] = False
        flat = np.frombuffer(flat, np.uint8)[~space].tobytes()
    while b"  " in flat:
        flat = flat.replace(b"  ", b" ")
    return [line.strip(b" ") for line in flat.split(b"\n")]


def compared(flat: bytes, min_words: int) -> bool:
    """Whether a normalised line is compared with others, rather than grouped by its exact form only."""
    return len(flat) >= LONG or flat.count(b" ") + 1 >= min_words and bool(flat)


def simhash(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(lines, BITS / 8) bytes: for each bit whether more than half of the line's words have it. h: hashes of the words."""
    octets = np.stack([h, mix(h + np.uint64(0x9E3779B97F4A7C15))], 1).view(np.uint8)[:, : BITS // 8]
    parts = -(-size // _PART)
    line = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = start[line] + nth * _PART
    sums = np.empty((len(line), BITS // 8), np.uint64)
    for k in range(BITS // 8):  # a row of numbers is summed faster than rows of them
        sums[:, k] = np.add.reduceat(_LANES[octets[:, k]], at)
    counts = sums.view(np.uint8).reshape(len(line), BITS).astype(np.int64)
    if len(line) > len(size):
        counts = np.add.reduceat(counts, np.cumsum(parts) - parts, axis=0)
    return np.packbits(2 * counts > size[:, None], axis=1)


def minima(x: np.ndarray, owner: np.ndarray, width: int, lines: int, most: np.ndarray) -> np.ndarray:
    """(lines, MINIMA) of the smallest different hashes of windows of ``width`` elements within a line, at most ``most`` of each, else 0."""
    out = np.zeros((lines, MINIMA), np.int64)
    n = len(x) - width + 1
    if n <= 0:
        return out
    inside = owner[:n] == owner[width - 1 :]
    window = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for k in range(width):
            window *= np.uint64(0x9E3779B97F4A7C15)
            window += x[k : k + n]
            window = mix(window)
    # in one sort: line number above, hash below
    both = np.sort(owner[:n][inside].astype(np.uint64) << np.uint64(50) | window[inside] >> np.uint64(14))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    line = (both >> np.uint64(50)).astype(np.int64)
    begin = np.searchsorted(line, np.arange(lines))
    place = np.arange(len(line)) - begin[line]
    keep = place < most[line]
    out[line[keep], place[keep]] = (both[keep] & np.uint64((1 << 50) - 1)).astype(np.int64) | width << 50
    return out


def _binned(line: np.ndarray, at: np.ndarray, lines: int, bins: int) -> np.ndarray:
    """(lines, bins / 2) counts up to 15 in half bytes."""
    counts = np.minimum(np.bincount(line * bins + at, minlength=lines * bins).reshape(-1, bins), 15).astype(np.uint8)
    return counts[:, ::2] | counts[:, 1::2] << 4


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the differences of counts in half bytes."""
    u, v = (np.concatenate([z & 15, z >> 4], 1).view(np.int8) for z in (x, y))
    return np.abs(u - v).sum(1, dtype=np.int64)


def signature(lines: list[bytes]) -> np.ndarray:
    """(lines, bytes): fingerprint, keys of the windows, length, number of words, counts of character pairs and of words of each line."""
    joined = b"\n".join(lines) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    end = np.flatnonzero(data <= 32)
    last = data[end] == 10
    owner = np.cumsum(last) - last
    size = np.bincount(owner)
    h = run_hashes(data, np.r_[0, end[:-1] + 1], end)
    prints = simhash(h, np.cumsum(size) - size, size)
    inner = (data & 0xC0) == 0x80
    stop = end[last]
    length = np.diff(np.r_[0, stop + 1]) - 1 - np.diff(np.r_[0, np.cumsum(inner)[stop]])
    few = np.flatnonzero(size < CHARACTERS[2])
    points = np.frombuffer("".join(lines[i].decode("utf-8", "surrogatepass") for i in few.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    code, of = points.astype(np.uint64), np.repeat(few, length[few])
    share = np.full(len(lines), MINIMA)
    share[(size >= THREE[1]) & (size < CHARACTERS[2]) | (size >= FIVE[1]) & (size < THREE[2])] //= 2
    keys, filled = np.zeros((len(lines), MINIMA), np.int64), np.zeros(len(lines), bool)
    for (width, least, most), (x, owned) in ((CHARACTERS, (code, of)), (THREE, (h, owner)), (FIVE, (h, owner))):
        has = np.flatnonzero((size >= least) & (size < most))
        if not len(has):
            continue
        place = np.full(len(lines), -1)
        place[has] = np.arange(len(has))
        mine = place[owned] >= 0
        got = minima(mix(x[mine]) if x is code else x[mine], place[owned[mine]], width, len(has), share[has])
        second = filled[has]
        keys[has[~second]] = got[~second]
        keys[has[second], MINIMA // 2 :] = got[second, : MINIMA // 2]
        filled[has] = True
    inside = of[1:] == of[:-1]
    pair = (mix(code[:-1] * np.uint64(1000003) + code[1:]) % np.uint64(PAIRS)).astype(np.int64)
    word = (h % np.uint64(BINS)).astype(np.int64)
    counts = np.c_[_binned(of[:-1][inside], pair[inside], len(lines), PAIRS), _binned(owner, word, len(lines), BINS)]
    numbers = np.stack([length, size], 1).astype(np.uint32)
    return np.concatenate([prints, keys.view(np.uint8), numbers.view(np.uint8), counts], 1)


#: Ends of the fingerprint, and begins of the parts behind the keys, counted from the signature's end.
_KEYS, _WORDS = BITS // 8, -(BINS // 2)
_COUNTS = _WORDS - PAIRS // 2
_LENGTH = _COUNTS - 8


def line_keys(signatures: list[bytes] | np.ndarray) -> np.ndarray:
    """The keys of the fingerprint's blocks and of the line's windows, the first window's where there are fewer."""
    x = stacked(signatures)
    blocks = np.ascontiguousarray(x[:, :_KEYS]).view(np.uint32).astype(np.int64) | (np.arange(BLOCKS) + 1) << 56
    windows = np.ascontiguousarray(x[:, _KEYS:_LENGTH]).view(np.int64)
    at = np.argmax(windows > 0, axis=1)
    own = np.where(windows[np.arange(len(x)), at] > 0, windows[np.arange(len(x)), at], blocks[:, 0])
    return np.c_[blocks, np.where(windows > 0, windows, own[:, None])]


def may_be_similar(least: int):
    """A score of rows of two signatures: above 0 if they may have the edit similarity, by length and counts. An edit changes
    the length by one at most and the counts of character pairs by four; counts that stop at 15 differ by less, never by more."""

    def score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (a, m), (b, n) = (np.ascontiguousarray(z[:, _LENGTH:_COUNTS]).view(np.uint32).astype(np.int64).T for z in (x, y))
        most = (100 - least) * np.maximum(a, b) // 100
        at = np.flatnonzero(np.abs(a - b) <= most)
        short = np.maximum(m, n)[at] < CHARACTERS[2]
        at = at[~short | (_apart(x[at, _COUNTS:_WORDS], y[at, _COUNTS:_WORDS]) <= 4 * most[at])]
        words, both = np.maximum(m, n)[at], ((m >= WORDY) & (n >= WORDY))[at]
        apart = _apart(x[at, _WORDS:], y[at, _WORDS:])
        out = np.zeros(len(x), np.int64)
        out[at] = np.where(~both | (apart <= 2 * ((100 - least) * words // 100 + 2)), 1 + np.maximum(0, 1000 - 500 * apart // np.maximum(1, words)), 0)
        return out

    return score


def length_place(least: int):
    """Logarithms of lengths, such that those of lines with the edit similarity differ by 1 at most."""

    def place(x: np.ndarray) -> np.ndarray:
        length = np.ascontiguousarray(x[:, _LENGTH : _LENGTH + 4]).view(np.uint32)[:, 0]
        return np.log(np.maximum(1, length)) / np.log(100 / least) if least < 100 else length.astype(float)

    return place


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger: common ends go first, then Myers' bit vectors."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < hi - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    for c in set(b).difference(place):
        place[c] = 0
    full = (1 << len(a)) - 1
    up, down = full, 0
    for j in range(0, len(b), _COLUMNS):
        part = b[j : j + _COLUMNS]
        # bits beyond those of a change none of them, and are cut off now and then
        for eq in map(place.__getitem__, part):
            diagonal = ((eq & up) + up ^ up) | eq | down
            plus = (down | (diagonal | up) ^ full) << 1 | 1
            up, down = (up & diagonal) << 1 | (diagonal | plus) ^ full, plus & diagonal
        up, down, done = up & full, down & full, j + len(part)
        if (edge := len(a) - len(b) + done) > 0:
            # at least the distance of the beginnings that leave equally long ends
            first = (1 << edge) - 1
            score = done + (up & first).bit_count() - (down & first).bit_count()
            if score > most:
                return most + 1
    return score


def _at_most(a: str, b: str, most: int) -> bool:
    """Whether an alignment of the words bounds the edit distance by ``most``: where they differ, the nearest place within
    AHEAD words at which they are equal again goes on, and else the next word. What lies between counts in full, of two single words without common ends."""
    x, y = a.split(" "), b.split(" ")
    i, j, n, m, cost = 0, 0, len(x), len(y), 0
    p, q = set(x), set(y)
    if 100 * len(p & q) < COMMON * min(len(p), len(q)):
        return False
    while i < n and j < m:
        u, v = x[i], y[j]
        if u == v:
            i, j = i + 1, j + 1
            continue
        p, q = 1, 1
        if not (i + 1 < n and j + 1 < m and x[i + 1] == y[j + 1]):
            p, q = next(((p, s - p) for s in range(1, AHEAD) for p in range(s + 1) if i + p < n and j + s - p < m and x[i + p] == y[j + s - p]), (1, 1))
        if p == q == 1:
            k, most_ends = 0, min(len(u), len(v))
            while k < most_ends and u[k] == v[k]:
                k += 1
            z = 0
            while z < most_ends - k and u[-1 - z] == v[-1 - z]:
                z += 1
            cost += max(len(u), len(v)) - k - z
        else:
            cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        if cost > most:
            return False
        i, j = i + p, j + q
    return cost + sum(map(len, x[i:])) + n - i + sum(map(len, y[j:])) + m - j <= most


@lru_cache(maxsize=2048)
def pair_counts(flat: bytes) -> np.ndarray:
    """Counts of the pairs of neighbouring characters in 1,024 bins, those of letters each in its own."""
    x = np.frombuffer(flat.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) & 31
    return np.bincount(x[:-1] << 5 | x[1:], minlength=1 << 10).astype(np.int32)


FORGET.append(pair_counts.cache_clear)


def similar_lines(least: int):
    """Which lines have an edit similarity of ``least`` percent with a centre. An edit changes the counts of character pairs by
    four at most, so lines of COUNTED characters whose counts are further apart need no edit distance. ``together`` takes pairs of lines, whose distances
    are found in common walks where enough of them have about one length."""

    def far(x: bytes, y: bytes, most: int) -> bool:
        return int(np.abs(pair_counts(x) - pair_counts(y)).sum()) > 4 * most

    def together(pairs: list[tuple[bytes, bytes]]) -> list[bool]:
        out, rest = [False] * len(pairs), []
        for k, (x, y) in enumerate(pairs):
            a, b = x.decode("utf-8", "surrogatepass"), y.decode("utf-8", "surrogatepass")
            most, shorter = (100 - least) * max(len(a), len(b)) // 100, min(len(a), len(b))
            # of the two bounds the one goes first that settles most lines of that length
            if abs(len(a) - len(b)) > most or shorter >= COUNTED_FIRST and far(x, y, most):
                continue
            if shorter >= ALIGNED and _at_most(a, b, most):
                out[k] = True
            elif not (COUNTED <= shorter < COUNTED_FIRST and far(x, y, most)):
                if most < CAP:
                    rest.append((k, x, y, len(a), len(b), most))
                else:
                    out[k] = edit_distance(a, b, most) <= most
        if rest:
            at, x, y, m, n, most = zip(*rest, strict=True)
            alone = lambda k: edit_distance(x[k].decode("utf-8", "surrogatepass"), y[k].decode("utf-8", "surrogatepass"), most[k]) <= most[k]
            for k, good in zip(at, within(x, y, np.array(m), np.array(n), np.array(most), alone).tolist(), strict=True):
                out[k] = good
        return out

    def check(centre: bytes, members: list[bytes]) -> list[bool]:
        return together([(centre, m) for m in members])

    check.together = together
    return check


def _parts(new: list[bytes]) -> Iterator[list[bytes]]:
    """Lines in runs of at most _LINES and about _BYTES bytes."""
    end, lo = np.cumsum([len(x) for x in new]), 0
    while lo < len(new):
        hi = int(np.searchsorted(end, (end[lo - 1] if lo else 0) + _BYTES, "right"))
        hi = min(max(lo + 1, hi), lo + _LINES)
        yield new[lo:hi]
        lo = hi


def _binary(rows: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """n values of bytes: rows of them stand at the given places, in order, and nulls elsewhere."""
    there = np.zeros(n, bool)
    there[at] = True
    offsets = np.r_[0, np.cumsum(there) * rows.shape[1]].astype(np.int32)
    buffers = np.packbits(there, bitorder="little"), offsets, np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), n, [pa.py_buffer(x) for x in buffers])


def _occurrences(min_words: int):
    """The lines of a task; a class's signature stands, under an id of its own, at its first line of those that are remembered together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        given = (context.partitionId() if context else 0) << 40
        digest = xxhash.xxh3_128_digest
        seen: set[bytes] = set()
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in runs(texts):
                if len(seen) > _SEEN:
                    seen.clear()
                lines = normalised("\n".join(texts[lo:hi]))
                sizes = np.array([t.count("\n") + 1 for t in texts[lo:hi]])
                full = [k for k, flat in enumerate(lines) if flat]
                if not full:
                    continue
                hashes = [digest(lines[k]) for k in full]
                at, new = [], []
                for k, (i, h) in enumerate(zip(full, hashes, strict=True)):
                    if h not in seen:
                        seen.add(h)
                        if compared(lines[i], min_words):
                            at.append(k)
                            new.append(lines[i])
                n = len(full)
                of = np.repeat(np.arange(lo, hi), sizes)[full]
                line = np.arange(len(lines))[full] - (np.cumsum(sizes) - sizes)[of - lo]
                ids, mask = np.zeros(n, np.int64), np.ones(n, bool)
                ids[at], mask[at] = given + np.arange(len(at)), False
                given += len(at)
                sig = np.concatenate([signature(part) for part in _parts(new)]) if new else np.zeros((0, 0), np.uint8)
                h = _binary(np.frombuffer(b"".join(hashes), np.uint8).reshape(n, -1), np.arange(n), n)
                cols = [*(batch.column(i).take(pa.array(of)) for i in range(2)), pa.array(line), h, pa.array(ids, mask=mask), _binary(sig, np.array(at, np.int64), n)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "line", "h", "id", "sig"])

    return run


def _packed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (h, id), packed by the hash: of each of those looked at together its smallest id, _NONE if there is none, and the number n of rows; and with
    n = 0 its other ids."""

    def reduced(held: list) -> Iterator[pa.RecordBatch]:
        h, h2, ids = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((ids, h2, h))
        h, h2, ids = h[order], h2[order], ids[order]
        begin = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
        n = np.zeros(len(h), np.int64)
        n[begin] = np.diff(np.r_[begin, len(h)])
        keep = (n > 0) | (ids != _NONE)
        columns = [c[keep] for c in (h, h2, ids, n)]
        yield from packed(columns[0] % BUCKETS, columns, ["h", "h2", "id", "n"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            h = stacked(batch.column(0), np.int64)
            held.append((h[:, 0], h[:, 1], batch.column(1).fill_null(_NONE).to_numpy()))
            size += len(h)
        if size >= PACKED:
            yield from reduced(held)
            held, size = [], 0
    if size:
        yield from reduced(held)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows (h, id, n): the ids for which a smaller one of the same hash stands, and the hashes of several rows."""
    for h, h2, ids, n in buckets(batches):
        spare = ids[n == 0]
        h, h2, ids, n = (c[n > 0] for c in (h, h2, ids, n))
        order = np.lexsort((ids, h2, h))
        h, h2, ids, n = h[order], h2[order], ids[order], n[order]
        again = np.r_[False, (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])]
        begin = np.flatnonzero(~again)
        several = begin[np.add.reduceat(n, begin) > 1] if len(begin) else begin
        spare = np.r_[spare, ids[again & (ids != _NONE)]]
        both = np.ascontiguousarray(np.stack([h[several], h2[several]], 1)).tobytes()
        hashes = [both[k : k + 16] for k in range(0, len(both), 16)]
        cols = [pa.array([*hashes, *[None] * len(spare)], pa.binary()), pa.array(np.r_[np.zeros(len(several), np.int64), spare], pa.int64(), mask=np.r_[np.ones(len(several), bool), np.zeros(len(spare), bool)])]
        yield pa.RecordBatch.from_arrays(cols, ["h", "id"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, data): the normalised lines of texts at the given places."""
    for batch in batches:
        wanted, chosen = batch.column(1), []
        places = wanted.flatten()
        line, edge = places.field("line").to_pylist(), np.cumsum(wanted.value_lengths().to_numpy()).tolist()
        for text, lo, hi in zip(batch.column(0).to_pylist(), [0, *edge], edge, strict=False):
            lines = text.split("\n")
            chosen += [lines[k] for k in line[lo:hi]]
        data = normalised("\n".join(chosen)) if chosen else []
        yield pa.RecordBatch.from_arrays([places.field("id"), pa.array(data, pa.binary())], ["id", "data"])


def _drop_lines(text, dropped) -> str | None:
    if text is None or dropped is None:
        return text
    gone = set(dropped)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)


def _by_row(docs: DataFrame, rows: DataFrame, row_bytes: int, held: str, how: str) -> DataFrame:
    """docs (doc_id, row, ...) joined with rows (doc_id, row, held): the latter's rows are broadcast if a count of their bytes allows."""
    rows = rows.withColumnsRenamed({"doc_id": "__d", "row": "__r"})
    size = rows.agg(F.count("*") * 40 + F.sum(F.size(held)) * row_bytes).first()[0] or 0
    joined = docs.join(F.broadcast(rows) if size <= 32 << 20 else rows, F.col("__r").eqNullSafe(F.col("row")) & F.col("__d").eqNullSafe(F.col("doc_id")), how)
    return joined.drop("__d", "__r")


def line_groups(docs: DataFrame, items: DataFrame, tables: Tables, least: int, spent: Callable[[], DataFrame] | None = None) -> DataFrame:
    """(id, component) of the lines that are linked with one of a smaller id. docs: doc_id, row, text; items: id, sig, doc_id, row, line.
    spent: called when no signature is read any more; returns items without them, which are read from then on."""
    placed = [items]

    def lighter() -> None:
        placed[0] = spent()

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        places = semi(placed[0], ids, "id").select("doc_id", "row", F.struct("id", "line").alias("x"))
        places = tables.cut(places.groupBy("doc_id", "row").agg(F.collect_list("x").alias("wanted")), f"{name}-places")
        held = _by_row(docs.where("text is not null"), places, 16, "wanted", "inner").select("text", "wanted").mapInArrow(lean("lines", _chosen), "id long, data binary")
        out = tables.cut(held.dropDuplicates(["id"]), name)
        tables.drop(f"{name}-places")
        return out

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        ids = tables.cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), f"{name}-ids")
        edges = tables.cut(verified(pairs, texts_of(ids, f"{name}-lines"), similar_lines(least)), f"{name}-kept")
        tables.drop(f"{name}-lines", f"{name}-ids")
        return edges

    near = may_be_similar(least), np.uint8
    return link(tables, items, line_keys, near, verify, "lines", _KEYS + 8 * MINIMA, length_place(least), (texts_of, similar_lines(least)), lighter if spent else None)


def dedup_lines(docs: DataFrame, min_words: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated lines removed from ``text_col``, and columns ``n_lines``, ``n_dropped``."""
    tables = Tables(docs.sparkSession)
    names = docs.columns
    flat = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
    doc_id, body = f"__{names.index(id_col)}", f"__{names.index(text_col)}"
    row = F.xxhash64(doc_id, body)
    texts = flat.select(F.col(doc_id).cast("long").alias("doc_id"), row.alias("row"), F.col(body).alias("text"))
    seen = tables.cut(texts.mapInArrow(lean("lines", _occurrences(min_words)), _OCCURRENCES), "occurrences")
    # a class's smallest id stands for it; the few others come from lines that several batches hold
    signed = seen.where("id is not null")
    hashed = seen.select("h", "id").mapInArrow(lean("lines", _packed_hashes), "bucket long, h binary, h2 binary, id binary, n binary")
    hashed = hashed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean("lines", _repeated), "h binary, id long")
    hashed = tables.cut(hashed, "repeated")
    tables.free()
    spare = hashed.where("id is not null").select("id")
    items = signed.join(F.broadcast(spare) if small_enough(spare, 16) else spare, "id", "left_anti")

    def without_signatures() -> DataFrame:
        nonlocal seen
        # most of the bytes are signatures, which need not stay on disk with the shuffles to come
        seen = tables.cut(seen.drop("sig"), "unsigned")
        tables.drop("occurrences")
        return seen.where("id is not null")

    found = line_groups(texts, items, tables, least, without_signatures)
    signed = seen.where("id is not null")
    linked = found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
    linked = tables.cut(linked, "linked")
    linked = signed.select("h", "id").join(F.broadcast(linked) if small_enough(linked, 24) else linked, "id").select("h", F.col("component").cast("string").cast("binary").alias("group"))
    again = hashed.where("h is not null").select("h").join(linked, "h", "full").select("h", F.coalesce("group", "h").alias("group"))
    again = tables.cut(again, "affected")
    places = seen.select("doc_id", "row", "line", "h").join(F.broadcast(again) if small_enough(again, 48) else again, "h")
    places = tables.cut(places.select("group", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row", "line").alias("place")), "places")
    first = tables.cut(places.groupBy("group").agg(F.min("place").alias("keep")), "first")
    later = places.join(F.broadcast(first) if small_enough(first, 64) else first, "group").where("not (place <=> keep)").select("place.*")
    gone = tables.cut(later.groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone")), "gone")
    tables.drop("unsigned", "repeated", "linked", "affected", "places", "first", "lines-found")
    tables.free()
    joined = _by_row(flat.withColumns({"row": row, "doc_id": F.col(doc_id).cast("long")}), gone, 8, "gone", "left").drop("row", "doc_id")
    schema = T.StructType([*[f for f in flat.schema.fields], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array([_drop_lines(t, g) for t, g in zip(texts, gone, strict=True)], batch.schema.field(at).type)
            counts = pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()), pa.array([len(g or ()) for g in gone], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, *counts], [f.name for f in schema.fields])

    out = joined.mapInArrow(lean("lines", run), schema)
    if {"n_lines", "n_dropped"} & set(names):  # columns of the input keep their names
        out = out.drop("n_lines", "n_dropped")
    return out.withColumnsRenamed({f"__{i}": c for i, c in enumerate(names)})
