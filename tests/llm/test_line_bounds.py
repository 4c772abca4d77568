"""Long lines that share keys but not their pairs of characters need no edit distance; the bound loses no similar line."""

import random

from cytolake.llm import linededup


def _text(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def test_pairs_of_characters_spare_the_edit_distance(monkeypatch):
    rng, calls = random.Random(3), []
    real = linededup.edit_distance
    monkeypatch.setattr(linededup, "edit_distance", lambda *x: calls.append(x) or real(*x))
    head = _text(rng, "abcd ", 1000)
    lines = [head + _text(rng, "efgh ", 1000), head + _text(rng, "ijkl ", 1000)]
    assert linededup.similar_lines(80)(lines[0].encode(), [lines[1].encode()]) == [False] and not calls


def test_bound_keeps_similar_long_lines():
    rng, check = random.Random(5), linededup.similar_lines(80)
    seen = set()
    for turn in range(120):
        letters = "abcdefgh é漢\U0001f600" if turn % 2 else "abcdefghijkl "
        a = list(_text(rng, letters, 400))
        b = list(a)
        for _ in range(rng.randint(60, 100)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é", "漢"])
        a, b = "".join(a), "".join(b)
        same = linededup.edit_distance(a, b, 10**6) * 5 <= max(len(a), len(b))
        seen.add(same)
        assert check(a.encode(), [b.encode()]) == [same]
    assert seen == {True, False}
