"""Pairs that share a key with a far smallest item, and nothing else, are found; so are components of any shape."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.llm import linking, neardup
from cytolake.llm.shared import Tables


def _linked(spark, rows):
    """Components of items whose signature is (key, value): similar up to a difference of 2, likely up to 4."""
    sig = lambda k, v: np.array([k, v], np.int64).tobytes()
    items = spark.createDataFrame([(i, bytearray(sig(k, v))) for i, k, v in rows], "id long, sig binary")
    read = lambda sigs: np.frombuffer(b"".join(sigs), np.int64).reshape(len(sigs), 2)
    value = spark.createDataFrame([(i, v) for i, _, v in rows], "id long, v long")

    def verify(pairs, name):
        a, b = (value.select(F.col("id").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where("abs(va - vb) <= 2").select("a", "b")

    near = (lambda x, y: np.maximum(0, 5 - np.abs(x[:, 1] - y[:, 1]))), np.int64
    found = linking.link(Tables(spark), items, lambda sigs: read(sigs)[:, :1], near, verify)
    return {r["id"]: r["component"] for r in found.collect()}


def test_similar_items_of_a_far_centre(spark):
    rows = [(0, 7, 0)] + [(i, 7, 100 * ((i + 1) // 2)) for i in range(1, 41)]  # pairs of equal values, all far from item 0
    assert _linked(spark, rows) == {i: i - 1 for i in range(2, 41, 2)}


@pytest.mark.parametrize("gather", [8, 8192])
def test_hot_key_of_far_families_in_tiles(spark, monkeypatch, gather):
    monkeypatch.setattr(linking, "TILE", 16)
    monkeypatch.setattr(linking, "WINDOWS", (1, 2))
    monkeypatch.setattr(linking, "GATHER", gather)
    rows = [(i, 7, 100 * (i % 150)) for i in range(300)]
    found = _linked(spark, rows)
    assert all(found.get(i, i) == i % 150 for i in range(300))


def test_chains_and_several_keys(spark, monkeypatch):
    monkeypatch.setattr(linking, "TILE", 8)
    monkeypatch.setattr(linking, "WINDOWS", (1,))
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 250)) for i in range(200)]
    want = {i: i for i, _, _ in rows}
    for _ in rows:
        for i, k, v in rows:
            for j, m, w in rows:
                if k == m and abs(v - w) <= 2:
                    want[i] = want[j] = min(want[i], want[j])
    found = _linked(spark, rows)
    assert {i: found.get(i, i) for i in want} == want


def test_pieces_of_a_text_and_its_copies(spark):
    """Documents of half of a text's segments have the smallest ids and share keys with all; its near copies find each other."""
    rng = random.Random(4)
    segments = [" ".join(f"w{s}x{k}" for k in range(12)) for s in range(120)]
    rows = [" ".join(segments[s] for s in sorted(rng.sample(range(120), 66))) for _ in range(300)]
    for k in range(20):
        words = " ".join(segments).split()
        for at in rng.sample(range(len(words)), 12):
            words[at] = f"new{k}x{at}"
        rows.append(" ".join(words))
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: min(i, 300) for i in range(320)}


def test_rounds_read_their_tiles_once(spark, monkeypatch):
    """Components come with the tiles, and the tiles of a later round are written before its three steps read them."""
    plans, real = {}, Tables.cut

    def spy(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(self, df, name)

    monkeypatch.setattr(Tables, "cut", spy)
    monkeypatch.setattr(linking, "TILE", 16)
    monkeypatch.setattr(linking, "WINDOWS", (1, 2))
    values = [0] + [1000 + 3 * (i % 40) + i // 100 for i in range(300)]
    assert _linked(spark, [(i, 7, v) for i, v in enumerate(values)])
    rounds = [plans[f"link-met{k}"] for k in range(3) if f"link-met{k}" in plans]
    assert len(rounds) > 1 and not any("LeftOuter" in p for p in rounds)
    assert not any(line for p in rounds for line in p.splitlines() if "LeftSemi" in line and "key" in line)
