"""Tiles whose items bring their data verify pairs themselves and return few rows; packed rows and bounds by words lose nothing."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cytolake.llm import linededup, linking
from cytolake.llm.shared import Tables


def _linked(spark, rows, apart=2):
    """Components of items whose signature is (key, value): similar up to a difference of ``apart``, likely up to 4. The data is the value."""
    sig = lambda k, v: np.array([k, v], np.int64).tobytes()
    items = spark.createDataFrame([(i, bytearray(sig(k, v))) for i, k, v in rows], "id long, sig binary")
    value = spark.createDataFrame([(i, bytearray(str(v).encode())) for i, _, v in rows], "id long, data binary")
    tables = Tables(spark)
    check = lambda centre, members: [abs(int(centre) - int(m)) <= apart for m in members]

    def verify(pairs, name):
        return tables.cut(linking.verified(pairs, value, check), name)

    read = lambda sigs: np.frombuffer(b"".join(sigs), np.int64).reshape(len(sigs), -1)
    near = (lambda x, y: np.maximum(0, 5 - np.abs(x[:, -1] - y[:, -1]))), np.int64
    inside = (lambda ids, name: tables.cut(value.join(ids, "id", "left_semi"), name)), check
    found = linking.link(tables, items, lambda sigs: read(sigs)[:, :1], near, verify, "link", 8, lambda x: x[:, -1] / 4, inside)
    return {r["id"]: r["component"] for r in found.collect()}


@pytest.mark.parametrize("tile, small, size", [(8, 3, 1 << 25), (4096, 64, 1 << 25), (4096, 3, 40)])
def test_components_of_tiles(spark, monkeypatch, tile, small, size):
    monkeypatch.setattr(linking, "TILE", tile)
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(linking, "TILE_BYTES", size)
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 400)) for i in range(250)]
    want = {i: i for i, _, _ in rows}
    for _ in range(60):
        for i, k, v in rows:
            for j, m, w in rows:
                if k == m and abs(v - w) <= 2:
                    want[i] = want[j] = min(want[i], want[j])
    found = _linked(spark, rows)
    assert {i: found.get(i, i) for i in want} == want


def test_tiles_return_no_more_rows_than_items(spark, monkeypatch):
    """A key of likely items of which few are similar: all pairs are likely, and only those that join components come out."""
    made, real = {}, Tables.cut

    def spy(self, df, name):
        out = real(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Tables, "cut", spy)
    rows = [(0, 7, 1000)] + [(i, 7, 3 * (i % 2)) for i in range(1, 301)]
    assert _linked(spark, rows) == {i: 2 - i % 2 for i in range(3, 301)}
    assert 0 < made["link-left-kept"] <= 301 and max(made.values()) <= 2 * len(rows)


def test_packed_rows(monkeypatch):
    monkeypatch.setattr(linking, "_BLOBS", 5)
    rng = np.random.default_rng(3)
    x, y = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 5000))
    blobs = [r for b in linking.packed(x % linking.BUCKETS, [x, y], ["x", "y"]) for r in b.to_pylist()]
    blobs.sort(key=lambda r: r["bucket"])
    table = pa.Table.from_pylist(blobs, pa.schema([("bucket", pa.int64()), ("x", pa.binary()), ("y", pa.binary())]))
    parts = list(linking.buckets(iter(table.to_batches(7))))
    assert all(len(set((p[0] % linking.BUCKETS).tolist())) == 1 for p in parts)
    assert Counter(zip(x.tolist(), y.tolist(), strict=True)) == Counter(z for p in parts for z in zip(*(c.tolist() for c in p), strict=True))


@pytest.mark.parametrize("held", [50, 1 << 20])
def test_ids_and_hashes_of_several_rows(monkeypatch, held):
    monkeypatch.setattr(linededup, "PACKED", held)
    rng = random.Random(8)
    hashes = [rng.randbytes(16) for _ in range(300)]
    rows = [(rng.choice(hashes), i if rng.random() < 0.6 else None) for i in range(500)]
    table = pa.table({"h": pa.array([r[0] for r in rows], pa.binary()), "id": pa.array([r[1] for r in rows], pa.int64())})
    blobs = pa.Table.from_batches(list(linededup._packed_hashes(iter(table.to_batches(40))))).sort_by("bucket")
    got = [r for b in linededup._repeated(iter(blobs.to_batches(9))) for r in b.to_pylist()]
    count, ids = Counter(h for h, _ in rows), {}
    for h, i in rows:
        ids.setdefault(h, []).extend([] if i is None else [i])
    assert sorted(r["h"] for r in got if r["id"] is None) == sorted(h for h, n in count.items() if n > 1)
    assert sorted(r["id"] for r in got if r["id"] is not None) == sorted(i for x in ids.values() for i in sorted(x)[1:])


def test_words_bound_the_edit_distance():
    rng, bounded = random.Random(9), 0
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
    for _ in range(1500):
        a = [word() for _ in range(rng.randint(1, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
        x, y = " ".join(a), " ".join(b)
        most = 20 * max(len(x), len(y)) // 100
        if linededup._at_most(x, y, most):
            bounded += 1
            assert linededup.edit_distance(x, y, 10**6) <= most
    assert bounded > 300


def test_items_far_from_all_others_of_a_small_key_go_no_further():
    places = [0.5, 1.4, 7.0, 9.0, 10.0, 20.0]
    rows = [(5, i, x) for i, x in enumerate(places)] + [(6, 1, 1.4), (6, 2, 7.0)] + [(7, i, 100.0 * i) for i in range(linking.SMALL + 1)]
    by_id = {(i, x): np.array([x]).tobytes() for _, i, x in rows}
    spots = linking._spots(lambda x: x[:, 0], np.float64)
    key, a = (np.array([r[k] for r in rows]) for k in (0, 1))
    b = -1 - 2 * spots([by_id[i, x] for _, i, x in rows])
    blobs = pa.Table.from_batches(list(linking.packed(np.zeros(len(rows), np.int64), [key, a, b], ["key", "a", "b"])))
    got = [(r["key"], r["a"]) for t in linking._sorted_stars(iter(blobs.to_batches())) for r in t.to_pylist()]
    assert got == [(5, 0), (5, 1), (5, 3), (5, 4)] + [(7, i) for i in range(linking.SMALL + 1)]
