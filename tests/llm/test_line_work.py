"""Lines that are compared again and again have their character pairs counted once; faster ways give what plain ones give."""

import random

import numpy as np

from cytolake.llm import linededup


def _plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_pairs_of_a_line_are_counted_once(monkeypatch):
    rng, counted, real = random.Random(12), [], np.bincount
    lines = ["".join(rng.choice(letters) for _ in range(600)).encode() for letters in ("abcd ", "efgh ", "ijkl ")]
    monkeypatch.setattr(np, "bincount", lambda *x, **y: counted.append(x) or real(*x, **y))
    check = linededup.similar_lines(80)
    for _ in range(5):
        for x in lines:
            assert check(x, [y for y in lines if y != x]) == [False, False]
    assert len(counted) == len(lines)


def test_edit_distance_is_that_of_the_whole_table():
    rng = random.Random(13)
    for turn in range(600):
        letters = "ab " if turn % 2 else "abcdefghij漢é\U0001f600 "
        a = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 15, 16, 17, 33, 64, 80]))]
        b = list(a)
        for _ in range(rng.randint(0, 20)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = [rng.choice(letters) for _ in range(rng.randint(0, 2))]
        a, b, most = "".join(a), "".join(b), rng.randint(0, 30)
        assert linededup.edit_distance(a, b, most) == min(_plain_distance(a, b), most + 1)


def test_normalised_lines_are_their_words():
    rng = random.Random(14)
    plain = lambda text: [b" ".join(x.split()) for x in text.lower().encode().translate(linededup._PLAIN).split(b"\n")]
    for _ in range(3000):
        text = "".join(rng.choice(" \t\r\x0b\x0c\n\x1c\x85 aB9,.-Σé漢") for _ in range(rng.randint(0, 25)))
        assert linededup.normalised(text) == plain(text)
