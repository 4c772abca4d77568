"""Signatures of lines leave the disk before pairs are compared."""

from cytolake.llm import linededup, shared


def test_signatures_go_before_pairs_are_compared(spark, monkeypatch):
    rows = [(i, f"one two three four five six seven eight nine {i % 3}\nalone {i} " + "abcdefghij"[i % 10] * 12) for i in range(40)]
    rows.append((40, "one two three four five six seven eight mine 1"))
    done = []
    for name in ("cut", "drop"):
        f = getattr(shared.Tables, name)
        monkeypatch.setattr(shared.Tables, name, lambda self, *a, f=f, name=name: (done.append((name, a[-1] if name == "cut" else a)), f(self, *a))[1])
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["n_dropped"] for r in out.collect()}
    assert got[0] == 0 and got[40] == 1 and all(got[i] >= 1 for i in range(1, 40))
    gone = done.index(("drop", ("occurrences",)))
    assert done.index(("cut", "lines-ends")) < gone < done.index(("cut", "lines-small"))
