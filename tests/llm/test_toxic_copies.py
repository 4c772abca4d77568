"""Near copies of a toxic text make none of its other words a witness."""

import random

import numpy as np

from cytolake.llm import toxicity


def test_shares_of_near_copies():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 32, (6, toxicity.SKETCH), np.uint32)
    x[[2, 4]] = x[0]
    x[4, :8] = 7
    assert np.allclose(toxicity._shares(x), [1 / 3, 1, 1 / 3, 1, 1 / 3, 1])
    assert len(toxicity._shares(x[:0])) == 0


def test_copies_of_a_toxic_text_teach_only_its_insult(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(60)]
        if i % 10 == 0:
            words[7] = "grumpfel"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 10 == 0)))
    base = rows[0][1].split()
    for i in range(600, 640):  # near copies: a word of each is another
        words = list(base)
        words[rng.randrange(8, 60)] = word()
        rows.append((i, " ".join(words)))
        labels.append((i, 1))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.words["pos"] == ["grumpfel"]
    wrong = toxicity.score(docs, model).join(labels, "doc_id").where("predicted <> toxic")
    assert wrong.count() == 0
