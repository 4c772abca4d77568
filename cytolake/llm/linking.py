"""Connected groups of similar items: candidate pairs from shared keys, exact verification, components.

``link`` gets items (id, signature) and a way to make keys and to verify pairs. Items that share a key are candidates.

1. Within each map task, of a key that many items hold only the smallest item goes on, with one pair for each of the others,
   so a key that half of all items hold sends one row per task into the shuffle.
2. One shuffle brings the remaining items of a key together, sorted. Keys of at most ``SMALL`` items are kept whole, and all
   of their items are compared by signature in memory; of a larger key each item pairs with the smallest as the rows stream by.
3. Each item's likeliest partner in a small key, and the likely pairs of large keys, are verified exactly and make components.
   All other likely pairs of small keys that end in two components are verified after that.
4. A large key is open if one of its pairs has ended in two components: the smallest may be far from two
   items that are similar. Its items outside its largest component meet all items of the key in tiles of at most ``TILE``
   by ``TILE``, where signatures are compared in memory and each item's likely partners are ordered, best first. Rounds
   verify the next few of them (``WINDOWS``), and all that are left in the last one; partners that have come into one
   component meanwhile are passed over. So every two items that share a key are compared or end in one component,
   a few rows an item suffice where groups grow together, and no round emits the pairs of a group that is one already.
   Where the data of items is short enough to come with them (``inside``), a tile verifies its likely pairs itself, best
   first, and merges the components that it knows at once: one round, which returns fewer rows than the tiles have items.

The rows of step 2 are many and short. They are packed: a task cuts them by key into ``BUCKETS`` and sends a blob for each,
and the task that gets a bucket sorts its rows in memory, one bucket after the other. Where items have a ``place``, those of small
keys that are near no other go no further.

Components come from alternating large-star and small-star passes over tables, so no lineage grows and nothing is
collected; hot vertices are reduced by partial minima. Later edges are contracted to components first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, lean, semi, small_enough
from .words import mix, stacked

#: Items of an open key meet in tiles of at most about so many by so many.
TILE = 4096
#: Ends of the rounds' windows in the order of an item's likely partners in a tile; a last round takes the rest.
WINDOWS = (8, 128)
#: Pairs of a tile that are scored at once, and that are held together.
_AT_ONCE, _HELD = 1 << 14, 1 << 18
#: What differences of places may lose to rounding.
_ROUNDED = 1e-6
#: Items that a task looks at together, and how many of them make a key hot there.
GATHER, HOT = 8192, 32
#: Keys of at most so many items are compared whole.
SMALL = 64
#: Tiles whose items bring their data hold about so many bytes of it.
TILE_BYTES = 32 << 20
#: Tiles whose items bring their data are met together up to about so many bytes.
MEET_BYTES = 16 << 20
#: Buckets of packed rows, a power of two: of a thousand million rows one has a million. Rows that a task packs together, and blobs that leave it at once.
BUCKETS, PACKED, _BLOBS = 1024, 1 << 20, 128


def components(tables: Tables, edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every id in edges (a, b) but the smallest of each component: the smallest id that is reachable.
    Stops when a pass changes nothing."""
    now = tables.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    stats = _shape(now)
    turn = 0
    while stats[0]:
        turn += 1
        # every vertex links its larger neighbours to its smallest neighbour
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # and every vertex its smaller neighbours, and itself, to its smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = tables.cut(small.where("u <> v").distinct(), f"{name}-{turn}")
        tables.drop(f"{name}-{turn - 1}")
        now, new = after, _shape(after)
        if new == stats:
            break
        stats = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _shape(edges: DataFrame) -> tuple:
    """Equal for equal edge sets, but for a chance of 2**-64."""
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]


def _grown(tables: Tables, found: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Components (id, component) after further edges (a, b)."""
    ends = edges.join(_component(found, "a"), "a", "left").join(_component(found, "b"), "b", "left")
    ends = ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b")
    joined = components(tables, ends, f"{name}-cc")
    step = joined.select(F.col("id").alias("component"), F.col("component").alias("next"))
    moved = found.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    return tables.cut(moved.unionByName(joined), f"{name}-found")


def _component(found: DataFrame, column: str) -> DataFrame:
    return found.select(F.col("id").alias(column), F.col("component").alias(f"c_{column}"))


def _distinct_keys(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) in their order, without repeats, of items with a row of keys each."""
    by_id = np.argsort(ids)
    flat, owner = keys[by_id].reshape(-1), np.repeat(ids[by_id], keys.shape[1])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[new], owner[new]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and rows of the bytes of signatures of about GATHER items at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, GATHER):
            held.append(batch.slice(lo, GATHER))
            size += held[-1].num_rows
            if size >= GATHER:
                yield np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([stacked(b.column(1)) for b in held])
                held, size = [], 0
    if size:
        yield np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([stacked(b.column(1)) for b in held])


def _local_stars(batches: Iterator[pa.RecordBatch], keys_of: Callable, spot_of: Callable) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, null, hot, spot) of items; of keys that are hot among those looked at together only the smallest item, and
    (a, a, b) for the pairs of the others with it. hot: whether the key has such pairs."""
    for ids, signatures in _gathered(batches):
        order = np.argsort(ids)
        ids, signatures = ids[order], signatures[order]
        flat, place = _distinct_keys(np.arange(len(ids)), keys_of(signatures))
        owner = ids[place]
        first = np.r_[True, flat[1:] != flat[:-1]]
        group = np.cumsum(first) - 1
        hot = (np.bincount(group) >= HOT)[group]
        low = owner[np.flatnonzero(first)][group]
        single = ~hot | first
        left = hot & ~first
        pairs = np.unique(np.stack([low[left], owner[left]], 1), axis=0) if left.any() else np.zeros((0, 2), np.int64)
        n, m = int(single.sum()), len(pairs)
        b = pa.array(np.r_[np.zeros(n, np.int64), pairs[:, 1]], pa.int64(), mask=np.r_[np.ones(n, bool), np.zeros(m, bool)])
        spot = spot_of(signatures)[place[single]]
        cols = [pa.array(np.r_[flat[single], pairs[:, 0]]), pa.array(np.r_[owner[single], pairs[:, 0]]), b, pa.array(np.r_[hot[single], np.ones(m, bool)])]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.r_[spot, np.zeros(m, np.int64)])], ["key", "a", "b", "hot", "spot"])


def planes(x: np.ndarray) -> bytes:
    """Numbers of 64 bits by the places of their bytes, of which the high ones compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1) for b in blobs])


def packed(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(bucket, columns) of rows of 64-bit numbers: one row, of planes, for each bucket."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    columns = [x[order] for x in columns]
    full = np.flatnonzero(np.diff(edge))
    for at in range(0, len(full), _BLOBS):
        part = full[at : at + _BLOBS]
        blobs = [pa.array([planes(x[edge[k] : edge[k + 1]]) for k in part.tolist()], pa.binary()) for x in columns]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), *blobs], ["bucket", *names])


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of one bucket after the other, of packed rows sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if row[0] != at and held:
                yield [from_planes(list(x)) for x in zip(*held, strict=True)]
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield [from_planes(list(x)) for x in zip(*held, strict=True)]


_PACKED = "bucket long, key binary, a binary, b binary"
#: Steps of a place in packed rows, few so that they take little space there.
_STEPS = 4


def _spots(place: Callable | None, kind: type) -> Callable:
    """Of signatures their places in whole steps from 0 on, or zeros."""

    def spots(signatures: np.ndarray) -> np.ndarray:
        if not place:
            return np.zeros(len(signatures), np.int64)
        at = place(stacked(signatures, kind))
        return (np.clip(at, 0, 1 << 40) * _STEPS).astype(np.int64)

    return spots


def _packed_stars(batches: Iterator[pa.RecordBatch], keys_of: Callable, spot_of: Callable) -> Iterator[pa.RecordBatch]:
    """The rows of ``_local_stars``, packed by key; b, where it is null, tells hot and spot and is below 0. Ids are not below 0."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from packed((mix(key.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % BUCKETS, [key, a, b], ["key", "a", "b"])

    for batch in _local_stars(batches, keys_of, spot_of):
        key, a, hot, spot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
        b = batch.column(2).fill_null(-1).to_numpy()
        held.append((key, a, np.where(b < 0, -1 - (2 * spot + hot), b)))
        size += len(key)
        if size >= PACKED:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _sorted_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, a, b, hot) of one bucket after the other, sorted by key and a, but for keys of one row, which make no pair,
    and for the items of small keys of which no other has a place within 1."""
    for key, a, b in buckets(batches):
        made = b >= 0
        pairs = a[made], b[made]
        key, a, b = key[~made], a[~made], b[~made]
        order = np.argsort(key)
        near = key[order[1:]] == key[order[:-1]]
        order = order[np.r_[False, near] | np.r_[near, False]] if len(order) else order
        spot, hot = (-1 - b) >> 1, ((-1 - b) & 1).astype(bool)
        order = order[np.lexsort((spot[order], key[order]))]
        same = key[order[1:]] == key[order[:-1]]
        group = np.cumsum(np.r_[True, ~same][: len(order)]) - 1
        close = same & (spot[order[1:]] - spot[order[:-1]] <= _STEPS + 1)
        close = np.r_[False, close][: len(order)] | np.r_[close, False][: len(order)]
        order = order[close | (np.bincount(group, hot[order])[group] > 0) | (np.bincount(group)[group] > SMALL)]
        order = order[np.lexsort((a[order], key[order]))]
        n, m = len(order), len(pairs[0])
        cols = [np.r_[key[order], pairs[0]], np.r_[a[order], pairs[0]], np.r_[np.zeros(n, np.int64), pairs[1]], np.r_[hot[order], np.ones(m, bool)]]
        none = np.r_[np.ones(n, bool), np.zeros(m, bool)]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], mask=none), pa.array(cols[3])], ["key", "a", "b", "hot"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, a): (key, a, null) of keys with 2 to SMALL items; (null, a, b) for each item of larger and of hot keys
    with the key's first, and for the pairs that came along."""

    def starred(low: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
        cols = [pa.nulls(len(a), pa.int64()), pa.array(low, pa.int64()), pa.array(a, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["key", "a", "b"])

    def parted(keys: np.ndarray, a: np.ndarray, n: np.ndarray, low: np.ndarray, large: np.ndarray) -> Iterator[pa.RecordBatch]:
        small = ~large & (n > 1)
        if small.any():
            cols = [pa.array(keys[small]), pa.array(a[small]), pa.nulls(int(small.sum()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "a", "b"])
        pair = large & (low != a)
        if pair.any():
            yield starred(low[pair], a[pair])

    #: The last key and its smallest item if it is large, and the rows of a key that may go on.
    key, low = None, None
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    for batch in batches:
        made = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        if made.any():
            ready = batch.filter(pa.array(made))
            yield starred(ready.column(1).to_numpy(), ready.column(2).to_numpy())
        rows = tuple(np.r_[h, batch.column(i).to_numpy(zero_copy_only=False)[~made]] for h, i in zip(held, (0, 1, 3), strict=True))
        if not len(rows[0]):
            continue
        keys, a, hot = rows
        if low is not None and keys[0] == key:
            at = int(np.searchsorted(keys, key, "right"))
            yield starred(np.full(at, low), a[:at])
            keys, a, hot = keys[at:], a[at:], hot[at:]
            if not len(keys):
                held = keys, a, hot
                continue
        first = np.r_[True, keys[1:] != keys[:-1]]
        group = np.cumsum(first) - 1
        n, lows = np.bincount(group)[group], a[np.flatnonzero(first)][group]
        large = (n > SMALL) | (np.bincount(group, hot)[group] > 0)
        key, low = keys[-1], lows[-1] if large[-1] else None
        done = len(keys) if large[-1] else len(keys) - int(n[-1])
        held = keys[done:], a[done:], hot[done:]
        yield from parted(*(x[:done] for x in (keys, a, n, lows, large)))
    n = len(held[0])
    if n:
        yield from parted(held[0], held[1], np.full(n, n), np.full(n, held[1][0]), np.zeros(n, bool))


def _within(score: Callable, kind: type, place: Callable | None):
    """(a, b, first) of items (key, id, sig), sorted by key and id, of small keys: their pairs that may be similar. first: whether a is
    the likeliest of b's partners before it."""

    def meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids = (rows.column(c).to_numpy() for c in (0, 1))
        sig = stacked(rows.column(2), kind)
        at = place(sig) if place else None
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        before = np.arange(len(ids)) - np.repeat(begin, np.diff(np.r_[begin, len(ids)]))
        total, lo = np.cumsum(before), 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _AT_ONCE, "right")))
            m = before[lo:hi]
            v = np.repeat(np.arange(lo, hi), m)
            u = v - 1 - (np.arange(len(v)) - np.repeat(np.cumsum(m) - m, m))
            if at is not None:
                close = np.abs(at[u] - at[v]) <= 1 + _ROUNDED
                u, v = u[close], v[close]
            found = score(sig[u], sig[v]) if len(u) else np.zeros(0)
            near = np.flatnonzero(found > 0)
            near = near[np.lexsort((ids[u[near]], -found[near], v[near]))]
            u, v, lo = u[near], v[near], hi
            first = np.ones(len(v), bool)
            first[1:] = v[1:] != v[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64()), pa.array(first)], ["a", "b", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            key = rows.column(0).to_numpy()
            at = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if at:
                yield from meet(rows.slice(0, at))
            held = rows.slice(at)
        if held is not None and len(held):
            yield from meet(held)

    return run


def _keys(batches: Iterator[pa.RecordBatch], keys_of: Callable) -> Iterator[pa.RecordBatch]:
    """Distinct rows (key, id) of items (id, sig)."""
    for ids, signatures in _gathered(batches):
        flat, owner = _distinct_keys(ids, keys_of(signatures))
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(owner)], ["key", "id"])


def _compared(keys_of: Callable, score: Callable, kind: type):
    """(a, b, near, keys) of pairs with signatures: whether they may be similar, and the keys that both have, some of them more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (stacked(batch.column(i), kind) for i in (2, 3))
            mine, theirs = map(keys_of, (x, y))
            both = np.concatenate([(mine[k : k + 1024, :, None] == theirs[k : k + 1024, None, :]).any(2) for k in range(0, len(mine), 1024)])
            keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(both.sum(1))], pa.int32()), pa.array(mine[both], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score(x, y) > 0), keys], ["a", "b", "near", "keys"])

    return run


def _tiles(keys_of: Callable | None, score: Callable, kind: type, place: Callable | None, lo: int, hi: int | None):
    """Pairs (a, b) of items of different components that may be similar: of each left item those with the places lo to hi in the
    order of its likely partners in a tile. A pair belongs to the tile of the smallest key that both have: that key is open
    too, or small, and they have been compared. Without ``keys_of`` it may come from several tiles. Rows (key) alone tell that a tile has more. In: (key, i, j, left,
    id, component, sig) sorted by tile."""

    def meet(rows: pa.Table) -> tuple[np.ndarray, set[int]]:
        key, i, j, ids, component = (rows.column(c).to_numpy() for c in (0, 1, 2, 4, 5))
        left = rows.column(3).to_numpy()
        sig = stacked(rows.column(6), kind)
        spot = place(sig) if place else None
        ends = np.r_[np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, len(ids)]
        out, more, at, held, size = [np.zeros((0, 2), np.int64)], set(), 0, [], 0

        def flush() -> None:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            found = np.concatenate([score(sig[u[k : k + _AT_ONCE]], sig[v[k : k + _AT_ONCE]]) for k in range(0, len(u), _AT_ONCE)])
            near = np.flatnonzero(found > 0)
            near = near[np.lexsort((ids[v[near]], -found[near], u[near]))]
            u, v = u[near], v[near]
            nth = np.arange(len(u)) - np.searchsorted(u, u)
            other = component[u] != component[v]
            if hi is not None:
                more.update(key[u[other & (nth >= hi)]].tolist())
            now = other & (nth >= lo) & (nth < (hi or len(u) + 1))
            u, v = u[now], v[now]
            for k in range(0, len(u), 1024):
                x, y = u[k : k + 1024], v[k : k + 1024]
                if keys_of:
                    mine, theirs = (keys_of(sig[w]) for w in (x, y))
                    below = np.where(mine < key[x, None], mine, -1)
                    smaller = ((below[:, :, None] == theirs[:, None, :]) & (below[:, :, None] != -1)).any((1, 2))
                    x, y = x[~smaller], y[~smaller]
                x, y = ids[x], ids[y]
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
            held.clear()

        for end in ends.tolist():
            own = left[at:end]
            right = at + np.flatnonzero(~own)
            if len(right) and len(right) < end - at and (component[at:end] != component[right[0]]).any():
                lefts = at + np.flatnonzero(own)
                step = max(1, _HELD // len(right))
                for k in range(0, len(lefts), step):
                    part = lefts[k : k + step]
                    if spot is None:
                        pair = np.repeat(part, len(right)), np.tile(right, len(part))
                    else:
                        x, y = np.nonzero(np.abs(spot[part, None] - spot[right]) <= 1 + _ROUNDED)
                        pair = part[x], right[y]
                    held.append(pair)
                    size += len(pair[0])
                    if size >= _HELD:
                        flush()
                        size = 0
            at = end
        if held:
            flush()
        return np.unique(np.concatenate(out), axis=0), more

    def batch_of(pairs: np.ndarray, more: set[int]) -> pa.RecordBatch:
        n, m = len(pairs), len(more)
        of = lambda x, y, mask: pa.array(np.r_[x, y].astype(np.int64), pa.int64(), mask=mask)
        extra, none = np.r_[np.zeros(n, bool), np.ones(m, bool)], np.zeros(m, np.int64)
        cols = [of(pairs[:, 0], none, extra), of(pairs[:, 1], none, extra), of(np.zeros(n), np.array(sorted(more), np.int64), ~extra)]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = np.ones(len(rows), bool)
            for c in range(3):
                x = rows.column(c).to_numpy()
                last &= x == x[-1]
            at = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if at:
                yield batch_of(*meet(rows.slice(0, at)))
            held = rows.slice(at)
        if held is not None:
            yield batch_of(*meet(held))

    return run


def _inside(keys_of: Callable, score: Callable, kind: type, place: Callable | None, check: Callable):
    """Edges (a, b) that join the components of items with their data, tile by tile: each left item meets the right ones, and its likely
    partners are verified best first, but for those that have come into its component. Two items outside the main component
    meet twice, and the one of the smaller id is taken as left. A pair belongs to the tile of the smallest key that both have, as in
    ``_tiles``. In: (key, i, j, left, right, main, id, component, sig, data) sorted by tile."""

    def meet(rows: pa.Table) -> pa.RecordBatch:
        key, i, j, left, right, main, ids, component = (rows.column(c).to_numpy() for c in range(8))
        sig, data = stacked(rows.column(8), kind), rows.column(9).to_pylist()
        spot = place(sig) if place else None
        names, of = np.unique(component, return_inverse=True)
        root = np.arange(len(names))
        ends = np.r_[np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, len(ids)]
        out: list[tuple[int, int]] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def owned(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            mine, theirs = (keys_of(sig[w]) for w in (u, v))
            below = mine < key[u, None]
            return ~((mine[:, :, None] == theirs[:, None, :]) & below[:, :, None]).any((1, 2))

        def flush() -> None:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(u):
                return
            found = np.concatenate([score(sig[u[k : k + _AT_ONCE]], sig[v[k : k + _AT_ONCE]]) for k in range(0, len(u), _AT_ONCE)])
            near = np.flatnonzero(found > 0)
            near = near[np.lexsort((ids[v[near]], -found[near], u[near]))]
            u, v, width = u[near], v[near], 1
            while len(u):
                apart = root[of[u]] != root[of[v]]
                u, v = u[apart], v[apart]
                now = np.arange(len(u)) - np.searchsorted(u, u) < width
                x, y = u[now], v[now]
                for k in range(0, len(x), 1024):
                    p, q = x[k : k + 1024], y[k : k + 1024]
                    apart = root[of[p]] != root[of[q]]
                    p, q = p[apart], q[apart]
                    good = owned(p, q)
                    p, q = p[good].tolist(), q[good].tolist()
                    for b, c, same in zip(p, q, together(check, [(data[b], data[c]) for b, c in zip(p, q, strict=True)]), strict=True):
                        r, s = root[of[b]], root[of[c]]
                        if same and r != s:
                            root[root == s] = r
                            out.append((min(ids[b], ids[c]), max(ids[b], ids[c])))
                u, v, width = u[~now], v[~now], 4 * width

        at, size = 0, 0
        for end in ends.tolist():
            lefts, rights = at + np.flatnonzero(left[at:end]), at + np.flatnonzero(right[at:end])
            at = end
            step = max(1, _HELD // max(1, len(rights)))
            for k in range(0, len(lefts), step) if len(rights) else ():
                part = lefts[k : k + step]
                meets = (root[of[part]][:, None] != root[of[rights]]) & (main[rights] | (ids[part, None] < ids[rights]))
                if spot is not None:
                    meets &= np.abs(spot[part, None] - spot[rights]) <= 1 + _ROUNDED
                x, y = np.nonzero(meets)
                held.append((part[x], rights[y]))
                size += len(x)
                if size >= 4 * _HELD:
                    flush()
                    size = 0
        if held:
            flush()
        return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # several batches at a time, so that many pairs are verified together
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.nbytes for x in held) < MEET_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            last = np.ones(len(rows), bool)
            for c in range(3):
                x = rows.column(c).to_numpy()
                last &= x == x[-1]
            at = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if at:
                yield meet(rows.slice(0, at))
            held = rows.slice(at).to_batches()
        if held:
            yield meet(pa.Table.from_batches(held))

    return run


def _held(tables: Tables, pairs: DataFrame, items: DataFrame, found: DataFrame, keys_of: Callable, name: str) -> DataFrame | None:
    """(key, id, component) of the items of the open keys, if there are any."""
    ends = pairs.join(_component(found, "a"), "a", "left").join(_component(found, "b"), "b", "left")
    keys = ends.where("coalesce(c_a, a) <> coalesce(c_b, b)").select(F.explode("keys").alias("key")).distinct()
    keys = tables.cut(keys, f"{name}-open")
    if keys.isEmpty():
        return None
    every = items.mapInArrow(lean("link", lambda it: _keys(it, keys_of)), "key long, id long")
    held = every.join(F.broadcast(keys) if small_enough(keys, 16) else keys, "key", "left_semi").join(found, "id", "left")
    held = tables.cut(held.select("key", "id", F.coalesce("component", "id").alias("component")), f"{name}-held")
    tables.drop(f"{name}-open")
    return held


def _merged(tables: Tables, held: DataFrame, items: DataFrame, data: DataFrame, near: tuple, place: Callable | None, keys_of: Callable, check: Callable) -> DataFrame:
    """Edges (a, b) of the tiles of held items with their data: as in ``_open``, but an item that is left and right in a tile is one row."""
    sizes = data.select("id", F.length("data").alias("size"))
    sized = held.join(F.broadcast(sizes) if small_enough(sizes, 16) else sizes, "id")
    parts = sized.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max(F.struct("n", "component", "size")).alias("most"))
    pieces = lambda n, size: F.ceil(F.greatest(n / TILE, size / TILE_BYTES, F.lit(1e-9))).cast("int")
    whole = whole.where("n > most.n").select("key", "main", pieces(F.col("n"), F.col("size")).alias("nr"), pieces(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("nl"))
    dealt = held.join(F.broadcast(whole) if small_enough(held, 40) else whole, "key").withColumn("main", F.col("component") == F.col("main"))
    dealt = dealt.withColumns({"own_i": F.expr("cast(pmod(xxhash64(id, 1), nl) as int)"), "own_j": F.expr("cast(pmod(xxhash64(id), nr) as int)")})
    # an item is right in all tiles of its j, and left, unless it is of the main component, in all of its i; in one of them it is both
    dealt = dealt.withColumn("t", F.explode(F.expr("sequence(0, if(main, nl, nl + nr) - 1)"))).where("t < nl or t - nl <> own_j")
    dealt = dealt.withColumns({"i": F.expr("if(t < nl, t, own_i)"), "j": F.expr("if(t < nl, own_j, t - nl)"), "left": F.expr("not main and (t >= nl or t = own_i)"), "right": F.expr("t < nl")})
    full = items.select("id", "sig").join(data, "id")
    rows = dealt.select("key", "i", "j", "left", "right", "main", "id", "component").join(full, "id")
    rows = rows.select("key", "i", "j", "left", "right", "main", "id", "component", "sig", "data").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(lean("link", _inside(keys_of, *near, place, check)), "a long, b long")


def _open(tables: Tables, pairs: DataFrame, items: DataFrame, found: DataFrame, keys_of: Callable, name: str) -> DataFrame | None:
    """(key, i, j, left, id, component): the tiles of the open keys. The left items of a key, those outside its largest component, stay the same in
    all rounds, as do the chunks of right ones, so that each left item's order of partners does."""
    held = _held(tables, pairs, items, found, keys_of, name)
    if held is None:
        return None
    parts = held.groupBy("key", "component").agg(F.count("*").alias("n"))
    whole = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("k"))
    whole = whole.where("k > 1 and n > 2").select("key", "main", F.ceil(F.col("n") / TILE).cast("int").alias("nr"), F.ceil((F.col("n") - F.col("most")) / TILE).cast("int").alias("nl"))
    whole = tables.cut(whole, f"{name}-whole")
    dealt = held.join(F.broadcast(whole) if small_enough(whole, 40) else whole, "key")
    tiles = F.expr("transform(sequence(0, nl - 1), x -> struct(x as i, cast(pmod(xxhash64(id), nr) as int) as j, false as left))")
    mine = F.expr("transform(sequence(0, nr - 1), x -> struct(cast(pmod(xxhash64(id, 1), nl) as int) as i, x as j, true as left))")
    dealt = dealt.select("key", "id", "component", F.explode(F.when(F.col("component") == F.col("main"), tiles).otherwise(F.concat(tiles, mine))).alias("t"))
    out = tables.cut(dealt.select("key", "t.i", "t.j", "t.left", "id", "component"), f"{name}-tiles")
    tables.drop(f"{name}-held", f"{name}-whole")
    return out


def link(
    tables: Tables,
    items: DataFrame,
    keys_of: Callable[[np.ndarray], np.ndarray],
    near: tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], type],
    verify: Callable[[DataFrame, str], DataFrame],
    name: str = "link",
    unread: int = 0,
    place: Callable[[np.ndarray], np.ndarray] | None = None,
    inside: tuple[Callable[[DataFrame, str], DataFrame], Callable[[bytes, list[bytes]], list[bool]]] | None = None,
    spent: Callable[[], None] | None = None,
) -> DataFrame:
    """(id, component) of the linked ids but the smallest of each component. items: id, sig. near: a score of rows of two
    signatures, as numbers of a kind, above 0 if they may be similar and higher for likelier ones; and that kind. It does not
    read the first ``unread`` bytes of signatures, and gets them with and without these. place: a number
    of each such signature, of which those of similar items differ by 1 at most. verify(pairs, name) keeps the true ones of pairs (a, b), a < b. inside: the data
    (id, data) of distinct ids (id), written under a name, and a check of it as for ``verified``. spent: called once ``items`` is
    no longer read, before any data is."""
    items = items.select("id", "sig")
    keyed = items.mapInArrow(lean("link", lambda it: _packed_stars(it, keys_of, _spots(place, near[1]))), _PACKED)
    met = keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean("link", lambda it: _grouped(_sorted_stars(it))), "key long, a long, b long")
    met = tables.cut(met, f"{name}-stars")
    tables.free()
    # from here on only items that share a key with another
    ends = met.select(F.col("a").alias("id")).unionByName(met.where("b is not null").select(F.col("b").alias("id"))).distinct()
    ends = tables.cut(ends, f"{name}-ids")
    items = tables.cut(semi(items, ends, "id"), f"{name}-ends")
    if spent:
        spent()
    small = met.where("b is null").select("key", F.col("a").alias("id")).join(items.select("id", F.expr(f"substring(sig, {unread + 1})").alias("sig")), "id")
    small = small.select("key", "id", "sig").repartition("key").sortWithinPartitions("key", "id")
    small = small.mapInArrow(lean("link", _within(*near, place)), "a long, b long, first boolean").groupBy("a", "b").agg(F.max("first").alias("first"))
    small = tables.cut(small, f"{name}-small")
    tables.free()
    large = tables.cut(met.where("b is not null").select("a", "b").distinct(), f"{name}-large")
    ends = semi(items, large.select(F.col("a").alias("id")).unionByName(large.select(F.col("b").alias("id"))).distinct(), "id")
    a, b = (ends.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    large = large.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")
    pairs = tables.cut(large.mapInArrow(lean("link", _compared(keys_of, *near)), "a long, b long, near boolean, keys array<long>"), f"{name}-pairs")
    tables.drop(f"{name}-stars", f"{name}-ids", f"{name}-large")
    tables.free()
    likely = pairs.where("near").select("a", "b")
    tested = small.where("first").select("a", "b").unionByName(likely).distinct()
    found = tables.cut(components(tables, verify(tested, f"{name}-verify"), f"{name}-cc"), f"{name}-found")
    rest = small.where("not first").join(_component(found, "a"), "a", "left").join(_component(found, "b"), "b", "left")
    rest = rest.where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b").join(likely, ["a", "b"], "left_anti")
    rest = tables.cut(rest, f"{name}-rest")
    if inside:
        tables.free()
        read, check = inside
        held = _held(tables, pairs, items, found, keys_of, name)
        ends = rest.select(F.col("a").alias("id")).unionByName(rest.select(F.col("b").alias("id")))
        ends = tables.cut((ends if held is None else ends.unionByName(held.select("id"))).distinct(), f"{name}-left")
        if not ends.isEmpty():
            data = read(ends, f"{name}-left-data")
            edges = verified(rest, data, check)
            edges = edges if held is None else edges.unionByName(_merged(tables, held, semi(items, ends, "id"), data, near, place, keys_of, check))
            edges = tables.cut(edges, f"{name}-left-kept")
            found = found if edges.isEmpty() else _grown(tables, found, edges, f"{name}-left")
        tables.drop(*(f"{name}-{x}" for x in ("left", "left-data", "left-kept", "held", "pairs", "ends", "small", "rest")))
        return found
    if not rest.isEmpty():
        edges = verify(rest, f"{name}-verify-rest")
        found = found if edges.isEmpty() else _grown(tables, found, edges, f"{name}-rest")
    tested = small.select("a", "b").unionByName(likely)
    ends = items.select("id", F.expr(f"substring(sig, {unread + 1})").alias("sig"))
    tiles = _open(tables, pairs, items, found, keys_of, name)
    for turn, (lo, hi) in enumerate(zip((0, *WINDOWS), (*WINDOWS, None), strict=True)):
        if tiles is None:
            break
        # later rounds are of few keys: the signatures of other items stay where they are
        met = semi(ends, tiles.select("id").distinct(), "id") if turn else ends
        rows = tiles.join(met, "id").select("key", "i", "j", "left", "id", "component", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        met = tables.cut(rows.mapInArrow(lean("link", _tiles(None if unread else keys_of, *near, place, lo, hi)), "a long, b long, key long"), f"{name}-met{turn}")
        more = tables.cut(met.where("key is null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), f"{name}-more{turn}")
        if not more.isEmpty():
            edges = verify(more, f"{name}-verify{turn}")
            found = found if edges.isEmpty() else _grown(tables, found, edges, f"{name}-turn{turn}")
        left = tables.cut(met.where("key is not null").select("key").distinct(), f"{name}-left{turn}")
        tables.drop(f"{name}-met{turn}")
        if left.isEmpty():
            break
        # written, as three steps of a round read them
        tiles = tiles.drop("component").join(F.broadcast(left) if small_enough(left, 16) else left, "key", "left_semi").join(found, "id", "left")
        tiles = tables.cut(tiles.withColumn("component", F.coalesce("component", "id")), f"{name}-tiles{turn + 1}")
        tables.drop(f"{name}-tiles{turn}" if turn else f"{name}-tiles")
    tables.drop(*(f"{name}-tiles{turn}" for turn in range(1, 1 + len(WINDOWS))))
    tables.drop(f"{name}-pairs", f"{name}-tiles", f"{name}-ends", f"{name}-small", f"{name}-rest")
    return found


def together(check: Callable[[bytes, list[bytes]], list[bool]], pairs: list[tuple[bytes, bytes]]) -> list[bool]:
    """``check`` of pairs, in runs of one centre, or all at once by its own ``together``."""
    if hasattr(check, "together"):
        return check.together(pairs)
    out: list[bool] = []
    for centre, run in groupby(pairs, key=lambda x: x[0]):
        out += check(centre, [m for _, m in run])
    return out


def verified(pairs: DataFrame, payload: DataFrame, check: Callable[[bytes, list[bytes]], list[bool]], most: int = 256) -> DataFrame:
    """The pairs (a, b) for which ``check(data of a, data of several b)`` is true, of their payloads (id, data). Members go to
    their centre a, whose group is dealt over salts of about ``most`` members each; a group streams through its task."""
    count = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / most).cast("int"))
    salted = pairs.join(count, "a").withColumn("salt", F.pmod(F.hash("b"), F.col("salts")))
    data = payload.select("id", "data")
    members = salted.select("a", "salt", F.col("b").alias("id")).join(data, "id").select("a", "salt", F.col("id").alias("b"), "data")
    centres = count.select(F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(data, "id")
    centres = centres.select(F.col("id").alias("a"), "salt", F.lit(None).cast("long").alias("b"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            a, salt, b, d = (batch.column(i).to_pylist() for i in range(4))
            met, of, i = [], [], 0
            while i < len(a):
                if b[i] is None:
                    at, centre = (a[i], salt[i]), d[i]
                elif (a[i], salt[i]) == at:
                    met.append((centre, d[i]))
                    of.append(i)
                i += 1
            good = [i for i, same in zip(of, together(check, met), strict=True) if same]
            out_a, out_b = [a[i] for i in good], [b[i] for i in good]
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    rows = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(lean("link", run), "a long, b long")
