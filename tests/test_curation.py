"""Hand-computed cases of gating rules, labels, shapes, neighbourhood tables and the small choices of model fitting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import resampling_cases
from cytolake.functions import gating as G
from cytolake.operators import cohort_models as M
from cytolake.operators import curation as U
from cytolake.operators import knn


@pytest.mark.parametrize(
    "rule, channels, want",
    [
        (("CD4&CD3",), ["CD4", "CD3", "CD8"], {"CD4": 1, "CD3": 1, "CD8": -1}),
        (("CD68|CD163",), ["CD68", "CD163", "CD3"], {"CD68": 2, "CD163": 2, "CD3": -1}),
        (("CD38&!IgA",), ["CD38", "IgA"], {"CD38": 1, "IgA": -3}),
        (("CD8", "CD45|VIM"), ["CD8", "CD45", "VIM", "CD3"], {"CD8": 1, "CD45": 0, "VIM": 0, "CD3": -1}),
        (("CD4", "", "CD103|CD45RA"), ["CD4", "CD103", "CD45RA", "CD8"], {"CD4": 1, "CD103": 0, "CD45RA": 0, "CD8": -1}),
        (("CD4", "CD4|VIM"), ["CD4", "VIM"], {"CD4": 1, "VIM": 0}),
        (("CD38&!IgA", "IgA"), ["CD38", "IgA"], {"CD38": 1, "IgA": -3}),
        (("", " A | "), ["A", "B"], {"A": 0, "B": -1}),
    ],
)
def test_rule_codes(rule, channels, want):
    assert G.encoding(channels, *rule) == want


def test_soft_not_needs_a_common_marker_and_all_musts():
    own, other = G.encoding(["A", "B", "C"], "A"), G.encoding(["A", "B", "C"], "A & B")
    assert G.soft_not(own, other) == {"A": 1, "B": -3, "C": -1} and G.soft_not(other, own) == other
    assert G.soft_not(own, G.encoding(["A", "B", "C"], "B & C")) == own


def test_rounds_colours_and_rows(spark):
    assert M.best_rounds([5, 4, 3, 3.5, 2.9]) == 5 and M.best_rounds([1, 2, 3], patience=1) == 1 and M.best_rounds([3, 2, 4, 4, 1], patience=2) == 2
    palette = [(0, 0, 0), (10, 0, 0), (255, 0, 0)]
    assert M.contrast_colours(np.array([[0, 5, 0], [0, 0, 1], [0, 0, 0]]), palette) == [2, 0, 1]
    a, b = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "b int, a int")
    assert U.appended(a, a).count() == 2 and U.appended(a, b).columns == ["b", "a"] and U.appended(None, b).count() == 1


def test_labels_out_of_range_fail(spark):
    df = spark.createDataFrame([(0,), (2,)], "y int")
    assert U.checked_labels(df, "y", 3).count() == 2
    with pytest.raises(Exception, match="label 2 is outside 0 to 1"):
        U.checked_labels(df, "y", 2).collect()
    with pytest.raises(ValueError):
        U.checked_labels(df, "y", 0)


def test_point_labels_and_stripped_artefacts(spark):
    cells = spark.createDataFrame([("i", 1, 0.0, 0.0, "T"), ("i", 2, 9.0, 0.0, None)], "image string, id long, x double, y double, class string")
    points = spark.createDataFrame([("i", 1, 0.5, 0.0, "B", 1), ("i", 2, 8.5, 0.0, "T", 2), ("i", 3, 90.0, 0.0, "T", 3)], "image string, id long, x double, y double, class string, seq long")
    had = spark.createDataFrame([("i", 2, "T-mergedInto(B)")], "image string, cell long, raw string")
    assert [tuple(r) for r in U.point_labels(points, cells.drop("class"), had, 2.0).collect()] == [("i", 1, "B")]
    notes = spark.createDataFrame([(1, True, "T"), (2, False, "T"), (3, True, None)], "id long, is_point boolean, class string")
    left, bare = U.stripped(notes, cells)
    assert sorted(r["id"] for r in left.collect()) == [2, 3] and bare.where("class is not null").count() == 0


def test_signed_distance_of_a_square(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    df = spark.createDataFrame([(2.0, 1.0), (7.0, 8.0), (5.0, 2.0)], "x double, y double")
    assert [r[0] for r in df.select(U.signed_distance(F.col("x"), F.col("y"), square)).collect()] == [-1.0, 5.0, 1.0]
    assert df.select(U.area(square)).first()[0] == 16.0


def test_pruning_of_the_marker_groups(spark):
    rows = [(float(i + 1), 2.0 * (i + 1), [9.0, 1.0, 7.0, 2.0, 8.0, 3.0][i], 5.0) for i in range(6)]
    df = spark.createDataFrame(rows, "`CD3: Mean` double, `CD3: Median` double, `CD8: Mean` double, `CD8: Max` double")
    got = lambda **k: {r["feature"]: r["verdict"] for r in M.prune_by_group(df, df.columns, least=1, **k).collect()}
    assert got(whitelist=0) == {"CD3: Mean": "within", "CD3: Median": "kept", "CD8: Mean": "kept", "CD8: Max": "constant"}
    assert set(got(whitelist=5).values()) == {"kept"}


def test_smote_tomek_keeps_no_link_of_the_largest_labels(spark):
    rows = resampling_cases.rows("moderate") if hasattr(resampling_cases, "rows") else [(i, [float(i % 7), float(i % 11)], int(i % 10 == 0) + int(i % 30 == 0)) for i in range(180)]
    df = spark.createDataFrame([tuple(r) for r in rows], "id long, vec array<double>, label long")
    made, clean = knn.smote(df), M.smote_tomek(df)
    assert clean.count() <= made.count() and clean.select("label").distinct().count() == df.select("label").distinct().count()


def test_leiden_by_sample_and_transfer(spark):
    rows = [(i, float(i % 2) * 50 + (i * 37 % 10) / 10, float(i % 2) * 50 + (i * 53 % 10) / 10) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r["id"]: r["cluster"] for r in M.cohort_leiden(df, ["a", "b"], sample_size=60, k=8, transfer=3, gamma=0.001).collect()}
    assert len(got) == 120 and all(got[i] != got[j] for i in range(0, 120, 2) for j in range(1, 120, 2))


def test_boosted_trees_learn_classes(spark):
    rows = [([float(i % 3) * 4 + (i % 5) / 10, float(i % 7)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "vec array<double>, y int")
    model = M.boosted(df, rounds=3, depth=2)
    from pyspark.ml.functions import array_to_vector

    out = model.transform(df.select(array_to_vector("vec").alias("features"), "y"))
    assert out.where("prediction = y").count() >= 85
