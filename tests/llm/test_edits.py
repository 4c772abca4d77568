"""Pairs of lines that are verified together: the same answers as one by one, and less work."""

import random

import numpy as np
import pyarrow as pa

from cytolake.llm import edits, linededup


def _line(rng: random.Random, letters: str, size: int) -> str:
    return "".join(rng.choice(letters) for _ in range(size))


def _edited(rng: random.Random, letters: str, line: str) -> str:
    out = list(line)
    for _ in range(rng.randrange(1 + len(line) // 3)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = rng.choice(("", letters[0], rng.choice(letters)))
    return "".join(out)


def test_pairs_together_are_as_alone(monkeypatch):
    rng = random.Random(7)
    pairs = []
    for _ in range(1500):
        letters = rng.choice(("ab", "abc de", "äßx y", "日本 語a", "a😀b"))
        line = _line(rng, letters, rng.choice((1, 2, 3, 9, 40, 90, 170)))
        pairs.append((line, _edited(rng, letters, line) if rng.random() < 0.9 else _line(rng, letters, rng.randrange(60))))
    m, n = (np.array([len(x[k]) for x in pairs]) for k in (0, 1))
    most = np.array([rng.choice((0, 1, max(len(x), len(y)) // 5, max(len(x), len(y)) // 3)) for x, y in pairs])
    real = [linededup.edit_distance(x, y, k) <= k for (x, y), k in zip(pairs, most.tolist(), strict=True)]
    a, b = ([x[k].encode() for x in pairs] for k in (0, 1))
    alone = lambda k: real[k]
    for worth in (0, 96):
        monkeypatch.setattr(edits, "_WORTH", worth)
        assert edits.within(a, b, m, n, most, alone).tolist() == real
    assert 100 < sum(real) < 1400


def test_many_pairs_are_walked_together(monkeypatch):
    rng, calls, real = random.Random(3), [], linededup.edit_distance
    words = [_line(rng, "abcdefghij", 5) for _ in range(40)]
    pairs = [tuple(" ".join(rng.sample(words, 20)).encode() for _ in "ab") for _ in range(400)]
    monkeypatch.setattr(linededup, "edit_distance", lambda *x: calls.append(x) or real(*x))
    assert linededup.similar_lines(80).together(pairs) == [False] * 400 and not calls


def test_a_task_signs_a_line_once():
    texts = pa.array(["the same line of words in each text"] * 3 + ["another line of some more words here"])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([1, 2, 3, 4]), texts], ["doc_id", "row", "text"])
    out = pa.Table.from_batches(linededup._occurrences(5)(iter([batch, batch])))
    assert len(out) == 8 and len(out) - out.column("id").null_count == 2 == len(out) - out.column("sig").null_count
