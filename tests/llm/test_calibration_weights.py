"""Scores mean the same whether or not the sample of a label was capped."""

import numpy as np

from cytolake.llm import quality, toxicity


def test_toxicity_calibration_of_a_capped_sample():
    rng = np.random.default_rng(1)
    bad, good = rng.normal(1, 1, (3000, 1)), rng.normal(-1, 1, (24000, 1))
    sign = lambda x: np.c_[x, np.zeros((len(x), 2))]
    whole = toxicity._calibrate(sign(np.r_[bad, good]), np.r_[np.ones(3000), np.zeros(24000)], np.ones(27000))
    weight = np.r_[np.ones(3000), np.full(3000, 8.0)]
    capped = toxicity._calibrate(sign(np.r_[bad, good[:3000]]), np.r_[np.ones(3000), np.zeros(3000)], weight / weight.mean())
    assert np.abs(whole - capped)[[0, 3]].max() < 0.25


def test_toxicity_sample_counts_all_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "doc_id long, toxic int")
    few = toxicity.fit(docs, labels, per_class=5, rounds=1).prior
    assert abs(few - toxicity.fit(docs, labels, rounds=1).prior) < 1e-9


def test_quality_level_of_a_capped_sample():
    rng = np.random.default_rng(2)

    def level(n1, n0, odds):
        y = np.r_[np.ones(n1), np.zeros(n0)]
        x = [rng.normal(y[:, None] * 2 - 1, 1.5, (len(y), 2)) for _ in (0, 1)]
        model = quality.cotrain(x, y, np.arange(len(y)) % 3 == 0, [np.zeros((0, 2))] * 2, odds=odds)
        return model.score(np.zeros((1, 2)), np.zeros((1, 2)))[0, 0]

    assert abs(level(16000, 2000, (1.0, 1.0)) - level(2000, 2000, (1.0, 8.0))) < 0.08
