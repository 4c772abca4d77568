"""Short lines with an edited word are found; short lines and lines without spaces are grouped too."""

import random

import numpy as np

from cytolake.llm import linededup


def _line(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_edited_lines_share_a_key():
    rng = random.Random(11)
    for n in (5, 7, 10, 16, 20, 30):
        lines = [_line(rng, n).split() for _ in range(300)]
        edited = [[_line(rng, 1) if i == n // 2 else w for i, w in enumerate(x)] for x in lines]
        a, b = ([s.tobytes() for s in linededup.signature([" ".join(x).encode() for x in y])] for y in (lines, edited))
        met = [bool(set(x) & set(y)) for x, y in zip(linededup.line_keys(a).tolist(), linededup.line_keys(b).tolist(), strict=True)]
        assert sum(met) >= 0.97 * len(met)


def test_bounds_lose_no_similar_line():
    rng = random.Random(13)
    may, check = linededup.may_be_similar(80), linededup.similar_lines(80)
    for turn in range(400):
        a = list(_line(rng, rng.randint(3, 4) if turn % 2 else rng.randint(5, 60)))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // (4 if turn % 2 else 40))):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é", "漢"])
        a, b = " ".join("".join(a).split()), " ".join("".join(b).split())
        x, y = (linededup.signature([z.encode()]) for z in (a, b))
        same = linededup.edit_distance(a, b, 10**6) * 5 <= max(len(a), len(b))
        assert check(a.encode(), [b.encode()]) == [same] and (may(x, y)[0] > 0 or not same)


def test_against_all_pairs_of_lines(spark):
    """Every document of a table, against groups from all pairs of its line classes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    lines = sorted({x for _, t in rows for x in linededup.normalised(t) if linededup.compared(x, 5)})
    texts = [x.decode() for x in lines]
    size = np.array([len(x) for x in texts])
    counts = np.stack([np.bincount([sum(map(ord, p)) % 64 for p in zip(x, x[1:])], minlength=64) for x in texts])
    up = {x: x for x in lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    true = 0
    for i in range(len(lines)):
        most = 20 * np.maximum(size[i], size) // 100
        for j in np.flatnonzero((np.arange(len(lines)) > i) & (abs(size - size[i]) <= most) & (abs(counts - counts[i]).sum(1) <= 4 * most)):
            if linededup.edit_distance(texts[i], texts[j], int(most[j])) <= most[j]:
                up[root(lines[i])] = root(lines[j])
                true += 1
    assert true > 20
    seen, want = set(), {}
    for i, t in rows:
        kept = []
        for raw, flat in zip((t or "").split("\n"), linededup.normalised(t), strict=True):
            group = root(flat) if flat in up else flat
            if not flat or group not in seen:
                kept.append(raw)
            if flat:
                seen.add(group)
        want[i] = None if t is None else "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_edited_short_lines_are_dropped(spark):
    rng = random.Random(12)
    lines = [_line(rng, 10) for _ in range(100)]
    typed = [x.replace(x.split()[4], x.split()[4][:-1] + "0", 1) for x in lines]
    rows = [(i, x) for i, x in enumerate(lines + typed)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_dropped"] == 0 for r in out if r["doc_id"] < 100) and sum(r["n_dropped"] for r in out) >= 98


def test_short_lines_and_lines_without_spaces(spark):
    long = "今日は天気がとても良いので公園まで散歩に行きました"
    rows = [(0, f"All rights reserved.\n{long}"), (1, f"all rights reserved\nx\n{long}"), (2, f"{long.replace('公園', '学校')}\n---\n\n---")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], 1: "x", 2: "---\n\n---"}
