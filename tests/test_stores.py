"""Stores, parameter search and held-out metrics on small cases."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector

from cytolake.operators import tuning as U
from cytolake.operators.knn import smote
from cytolake.sources import stores as K


def test_labels_of_an_image_are_replaced_alone(spark, tmp_path):
    path = f"file://{tmp_path}/labels"
    assert K.load_labels(spark, path) is None and K.label_tables(spark, path).count() == 0
    kind = "cell long, label string, scope string, image string"
    K.save_labels(spark.createDataFrame([(1, "A", "s", "x/1"), (2, "B", "s", "1")], kind), path)
    K.save_labels(spark.createDataFrame([(3, "C", "s", "x/1")], kind), path)
    assert sorted((r["cell"], r["image"]) for r in K.load_labels(spark, path).collect()) == [(2, "1"), (3, "x/1")]
    assert K.load_labels(spark, path, image="x/1", scope="s").first()["label"] == "C" and K.load_labels(spark, path, image="none") is None
    assert K.remove(spark, path, scope="s", image="x/1") and not K.remove(spark, path, scope="s", image="x/1")
    assert [tuple(r) for r in K.label_tables(spark, path).collect()] == [("s", "1")]


def test_samples_keep_their_order(spark, tmp_path):
    path = f"file://{tmp_path}/sampled"
    K.save_sampled(spark.createDataFrame([(0, 9, "a"), (1, 4, "a"), (2, 7, "a"), (0, 1, "b")], "place long, cell long, image string"), path)
    assert K.load_sampled(spark, path, "a") == [9, 4, 7] and K.load_sampled(spark, path, "c") == []


def test_marker_tables_and_their_removal(spark, tmp_path):
    path = f"file://{tmp_path}/markers.json"
    assert K.load_markers(spark, path) is None
    rules = spark.createDataFrame([("T é", "CD3 & !CD8", None, "CD4")], "cell_type string, primary string, secondary string, tertiary string")
    K.save_markers(rules, path)
    assert K.load_markers(spark, path).collect() == rules.collect()
    K.save_markers(rules.where("false"), path)
    assert not K.exists(spark, path)


def test_classifiers_by_marker(spark, tmp_path):
    path = f"file://{tmp_path}/markers"
    rows = spark.createDataFrame([([float(i), 1.0], float(i > 4)) for i in range(10)], "vec array<double>, label double").withColumn("features", array_to_vector("vec"))
    model = LogisticRegression(maxIter=5).fit(rows)
    assert K.registry(spark, path) == {} and K.load_classifier(spark, f"{path}/none") is None
    folder = K.register_marker(spark, path, " CD3/ε ", {"features": ["a", "b"]}, {"linear": model})
    assert K.registry(spark, path) == {"CD3__": "CD3__/state.json"}
    state, models = K.load_classifier(spark, folder, {"linear": LogisticRegressionModel})
    assert state["features"] == ["a", "b"] and np.allclose(models["linear"].coefficients.toArray(), model.coefficients.toArray())
    assert K.unregister_marker(spark, path, "CD3/ε") and K.registry(spark, path) == {} and not K.unregister_marker(spark, path, "CD3/ε")
    for bad in (None, " ", ".x", "-x"):
        with pytest.raises(ValueError):
            K.marker_folder(bad)


def test_search_finds_better_parameters_than_its_random_start():
    def score(p):
        return -((np.log(p["eta"]) - np.log(0.05)) ** 2) - (p["depth"] - 7) ** 2 / 25 - (p["subsample"] - 0.7) ** 2

    seen = []
    got, best = U.search(lambda p: seen.append((p, score(p))) or seen[-1][1], trials=60)
    assert best == max(s for _, s in seen) and score(got) == best
    assert best > max(s for _, s in seen[: U.WARM_UP]) and np.mean([s for _, s in seen[30:]]) > np.mean([s for _, s in seen[: U.WARM_UP]])
    for p, _ in seen:
        assert p["rounds"] % 10 == 0 and all(low <= p[n] <= high for n, (low, high) in U.SPACE.items())
    assert U.search(lambda p: seen.clear() or score(p), trials=8) == U.search(score, trials=8)


def test_search_passes_over_failing_trials():
    calls = []

    def score(p):
        calls.append(p)
        if len(calls) % 2:
            raise ValueError
        return 1.0 if len(calls) == 4 else 0.5

    assert U.search(score, trials=8) == (calls[3], 1.0)

    def never(p):
        raise ValueError

    assert U.search(never, trials=3) == (U.DEFAULTS, 0.0)


def _labelled(spark, n):
    # both features tell the label, as trees may see one of them only
    return spark.createDataFrame([(i, [float(i % 2) * 4 + (i % 5) / 10, float(i % 2) * 9 + i % 7], i % 2) for i in range(n)], "id long, vec array<double>, label long")


def test_tuning_fits_the_folds(spark):
    df = _labelled(spark, 40).withColumnRenamed("label", "y")
    assert U.tune(df.limit(10), 2) == (U.DEFAULTS, 0.0)
    best, score = U.tune(df, 2, trials=1, folds=2, rounds=1)
    assert score > 0.95 and best["rounds"] == 1


def test_metrics_of_both_parts(spark):
    assert U.train_validation_metrics(_labelled(spark, 12)) is None
    df = _labelled(spark, 60).where("label = 0 or id % 3 = 0")  # 30 and 10
    got = {(r["model"], r["fold"], r["class"]): r for r in U.train_validation_metrics(df, resample=smote, trees=3, depth=3).collect()}
    assert len(got) == 8 and {k: r["support"] for k, r in got.items() if k[0] == "m1"} == {("m1", "train", 0): 24, ("m1", "train", 1): 24, ("m1", "validation", 0): 6, ("m1", "validation", 1): 2}
    assert all(r["f1"] == 1 for r in got.values())
