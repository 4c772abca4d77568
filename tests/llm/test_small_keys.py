"""Keys of few items are compared whole: no key of theirs is opened, and places, streams and parts of signatures lose no link."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytolake.llm import linededup, linking
from cytolake.llm.shared import Tables


def _linked(spark, rows, **more):
    """Components of items whose signature is (key, value): similar up to a difference of 2, likely up to 4."""
    sig = lambda k, v: np.array([k, v], np.int64).tobytes()
    items = spark.createDataFrame([(i, bytearray(sig(k, v))) for i, k, v in rows], "id long, sig binary")
    value = spark.createDataFrame([(i, v) for i, _, v in rows], "id long, v long")

    def verify(pairs, name):
        a, b = (value.select(F.col("id").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where("abs(va - vb) <= 2").select("a", "b")

    read = lambda sigs: np.frombuffer(b"".join(sigs), np.int64).reshape(len(sigs), 2)
    near = (lambda x, y: np.maximum(0, 5 - np.abs(x[:, -1] - y[:, -1]))), np.int64
    found = linking.link(Tables(spark), items, lambda sigs: read(sigs)[:, :1], near, verify, **more)
    return {r["id"]: r["component"] for r in found.collect()}


def test_small_keys_open_none(spark, monkeypatch):
    opened, real = [], linking._open

    def spy(*args):
        opened.append(real(*args))
        return opened[-1]

    monkeypatch.setattr(linking, "_open", spy)
    rows = [(0, 7, 0)] + [(i, 7, 100 * ((i + 1) // 2)) for i in range(1, 41)]  # pairs of equal values, all far from item 0
    assert _linked(spark, rows) == {i: i - 1 for i in range(2, 41, 2)} and opened == [None]


@pytest.mark.parametrize("small", [3, 64])
def test_places_and_parts_of_signatures(spark, monkeypatch, small):
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(linking, "TILE", 8)
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 30), rng.randint(0, 60)) for i in range(200)]
    want = {i: i for i, _, _ in rows}
    for _ in rows:
        for i, k, v in rows:
            for j, m, w in rows:
                if k == m and abs(v - w) <= 2:
                    want[i] = want[j] = min(want[i], want[j])
    found = _linked(spark, rows, unread=8, place=lambda x: x[:, -1] / 2)
    assert {i: found.get(i, i) for i in want} == want


@pytest.mark.parametrize("at_once", [1, 7, 64, 1000])
def test_keys_over_batches(monkeypatch, at_once):
    monkeypatch.setattr(linking, "SMALL", 4)
    sizes = {k: 1 + k * 7 % 11 for k in range(40)}
    rows = [(k, 100 * k + i) for k, n in sizes.items() for i in range(n)]
    cols = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.nulls(len(rows), pa.int64()), pa.array([False] * len(rows))]
    table = pa.Table.from_arrays(cols, ["key", "a", "b", "hot"])
    got = [r for b in linking._grouped(iter(table.to_batches(at_once))) for r in b.to_pylist()]
    assert sorted((r["key"], r["a"]) for r in got if r["b"] is None) == [(k, a) for k, a in rows if 2 <= sizes[k] <= 4]
    assert sorted((r["a"], r["b"]) for r in got if r["b"] is not None) == [(100 * k, a) for k, a in rows if sizes[k] > 4 and a != 100 * k]


def test_places_of_similar_lengths():
    sig = lambda n: linededup.signature([b"a" * n])
    place = linededup.length_place(80)
    for n in (24, 60, 801):
        apart = place(sig(n))[0] - place(sig(n - 20 * n // 100))[0]
        assert apart <= 1 + linking._ROUNDED < place(sig(n))[0] - place(sig(n - 20 * n // 100 - 2))[0]
