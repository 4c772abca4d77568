"""The registered query balances every label of the table."""

from cytolake.plans import neighbours


def test_adasyn_balances_every_label(spark, monkeypatch):
    rows = [(i, [float((i * 37 + d * 11) % 23) / 23 + d * (i % 5) / 20 for d in range(3)], i % 5) for i in range(40) if i % 5 != 4 or i % 2]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    monkeypatch.setattr(neighbours, "vectors", lambda *_: df)
    got = {r["label"]: r["n"] for r in neighbours.adasyn_balance(spark, "").collect()}
    assert got.keys() == set(range(5)) and got[4] > 4
    # the smallest label's rows, dealt by brute force
    v = {i: (x, c) for i, x, c in rows}
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(v[a][0], v[b][0], strict=True))
    share = [sum(v[o][1] != 4 for o in sorted((o for o in v if o != i), key=lambda o: (d2(i, o), o))[:5]) / 5 for i in v if v[i][1] == 4]
    assert got[4] == 4 + sum(int(s / sum(share) * 4 + 0.5) for s in share)
