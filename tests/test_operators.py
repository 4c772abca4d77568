"""Hand-computed cases and brute force for single operators."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytolake.functions import columns as C
from cytolake.functions import gating as G
from cytolake.operators import cohort, graph, knn, labels, learn, pixels, sampling, spatial, stats
from cytolake.sources import tables

import resampling_cases


def test_gate_grammar_and_missing_markers(spark):
    df = spark.createDataFrame([(True, False), (False, False), (True, True)], "A boolean, B boolean")
    ask = lambda text: [r[0] for r in df.select(G.mask(G.parse(text), df.columns)).collect()]
    assert ask("A & !B") == [True, False, False]
    assert ask("!(A | B)") == [False, True, False]
    assert ask("A & Missing") == [True, False, True]
    assert ask("Missing | !Gone | B") == [False, False, True]
    assert G.mask(G.parse("!Missing"), df.columns) is None
    for bad in ("A &", "(A", "A B", "A | | B"):
        with pytest.raises(ValueError):
            G.parse(bad)
    with pytest.raises(ValueError):
        G.parse("A & X", known={"A"})
    assert G.operands(G.parse("A & (B | !C) & !D")) == {"must": ["A"], "either": ["B"], "never": ["C", "D"]}


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.sampled_from("ABCD"), lambda x: st.one_of(st.tuples(st.just("!"), x), st.tuples(x, st.sampled_from("&|"), x)), max_leaves=8), st.lists(st.booleans(), min_size=4, max_size=4))
def test_gate_text_round_trip(tree, values):
    def text(t):
        return t if isinstance(t, str) else f"!({text(t[1])})" if len(t) == 2 else f"({text(t[0])}) {t[1]} ({text(t[2])})"

    def direct(t):
        if isinstance(t, str):
            return values["ABCD".index(t)]
        return not direct(t[1]) if len(t) == 2 else direct(t[0]) and direct(t[2]) if t[1] == "&" else direct(t[0]) or direct(t[2])

    def ask(g):
        if g.kind == "name":
            return values["ABCD".index(g.name)]
        parts = [ask(p) for p in g.parts]
        return not parts[0] if g.kind == "not" else all(parts) if g.kind == "and" else any(parts)

    gate = G.parse(text(tree))
    assert ask(gate) == direct(tree) == ask(G.parse(str(gate)))


def test_labels(spark):
    df = spark.createDataFrame([("a-mergedInto(b-mergedInto(c))",), ("X-mergedInto(Y)",), ("plain",), ("X-mergedInto(Y",)], "raw string")
    got = df.select(C.effective_class(F.col("raw")), C.original_class(F.col("raw"))).collect()
    assert [tuple(r) for r in got] == [("b-mergedInto(c)", "a"), ("Y", "X"), ("plain", "plain"), ("X-mergedInto(Y", "X")]


def test_rules():
    assert labels.parse_rule("CD3+:CD8-") == [("CD3", True), ("CD8", False)]
    for bad in ("", "CD3", "CD3+:cd3-", "+"):
        with pytest.raises(ValueError):
            labels.parse_rule(bad)


def test_robust_z_degenerate(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (5.0,), (float("nan"),)], "v double")
    assert {r["z"] for r in stats.with_robust_z(df, {"v": "z"}).collect()} == {0.0, None}
    z = sorted(r["z"] for r in stats.with_robust_z(df, {"v": "z"}, fallback=True).where("z is not null").collect())
    assert math.isclose(z[-1], 3 / math.sqrt(3), rel_tol=1e-9)


def test_heatmap_skips_nan_and_names_blank_classes(spark):
    df = spark.createDataFrame([("T", 1.0), ("T", float("nan")), (None, 3.0), (" ", 5.0)], "c string, m double")
    got = {r["class"]: r["mean"] for r in stats.class_marker_means(df, "c", ["m"]).collect()}
    assert got == {"T": 1.0, "Unclassified": 4.0}


def test_channel_stats_literal(spark):
    px = spark.createDataFrame([("i", "c", k % 10, k // 10, float(k)) for k in range(101)], "image string, channel string, x int, y int, v double")
    r = pixels.channel_stats(px, 255.0).first()
    assert (r["n"], r["min"], r["max"], r["mean"], r["median"], r["p1"], r["p99"], r["dynamic"], r["saturation"]) == (101, 0, 100, 50, 50, 1, 99, 98, 0)
    px = spark.createDataFrame([("i", "c", k, 0, v) for k, v in enumerate([10.0, float("nan"), 20.0, float("nan"), 30.0])], px.schema)
    r = pixels.channel_stats(px, 255.0).first()
    assert (r["n"], r["mean"], r["median"]) == (3, 20, 20)


def _cohort(spark, images):
    counts = [(i, c, n) for i, _, _, cs in images for c, n in cs.items()]
    return spark.createDataFrame(counts, "image string, class string, n long"), spark.createDataFrame([(i, p, d) for i, p, d, _ in images], "image string, predicted long, disagreements long")


def test_cohort_rare_enrichment_and_equal_images(spark):
    report = cohort.anomaly_report(*_cohort(spark, [("img-rare", 1000, 120, {"NK": 60, "T": 940}), ("img-b", 5000, 40, {"T": 5000}), ("img-c", 5000, 35, {"T": 5000})]))
    assert "RARE_ENRICHMENT" in {r["image"]: r["reasons"] for r in report.collect()}["img-rare"]
    same = cohort.anomaly_report(*_cohort(spark, [(f"i{k}", 1000, 40, {"A": 500, "B": 500}) for k in range(4)]))
    assert all(r["score"] == 0 and r["reasons"] == "" for r in same.collect())


@pytest.mark.parametrize("name,left", [("moderate", {0: 182, 1: 60, 2: 20}), ("severe", {0: 492, 1: 5, 2: 40}), ("wide", {0: 132, 1: 90, 2: 50})])
def test_tomek_counts(spark, name, left):
    df = spark.createDataFrame(resampling_cases.rows(name), "id long, vec array<double>, label int")
    assert {r["label"]: r["count"] for r in knn.tomek_clean(df).groupBy("label").count().collect()} == left


def test_smote_sizes_and_convexity(spark):
    df = spark.createDataFrame(resampling_cases.rows("moderate"), "id long, vec array<double>, label int")
    out = knn.smote(df).persist()
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 200, 1: 200, 2: 200}
    low, high = (df.groupBy("label").agg(*[f(F.get("vec", F.lit(i))).alias(f"v{i}") for i in range(8)]) for f in (F.min, F.max))
    box = {r["label"]: r for r in low.collect()}, {r["label"]: r for r in high.collect()}
    for r in out.where("id < 0").collect():
        assert all(box[0][r["label"]][f"v{i}"] - 1e-9 <= v <= box[1][r["label"]][f"v{i}"] + 1e-9 for i, v in enumerate(r["vec"]))
    sizes = {r["label"]: r["count"] for r in knn.adasyn(df).groupBy("label").count().collect()}
    assert sizes[0] == 200 and all(190 <= sizes[k] <= 210 for k in (1, 2))


def test_spatial_knn_with_ties_nan_and_small_images(spark):
    rng = random.Random(5)
    pts = [("a", i, float(rng.randint(0, 12)), float(rng.randint(0, 12))) for i in range(60)] + [("b", 1, 0.0, 0.0), ("b", 2, 3.0, 4.0), ("b", 3, float("nan"), 1.0), ("c", 1, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "image string, id long, x double, y double")
    got = {(r["image"], r["id"], r["rank"]): (r["other"], r["d2"]) for r in spatial.knn_join(df, df, 3).collect()}
    want = {}
    for g, i, x, y in pts:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for h, j, u, v in pts if h == g and j != i and not math.isnan(u + x))
        want |= {(g, i, k + 1): (j, d) for k, (d, j) in enumerate(near[:3])}
    assert got == want


def test_diversity_and_inside(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0],), ([1.0, 0.0, 0.0],)], "f array<double>")
    assert [round(r[0], 6) for r in df.select(C.diversity(F.col("f"), 3)).collect()] == [round(math.log(2) / math.log(3), 6), 0.0]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    pts = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0)], "x double, y double")
    assert [r[0] for r in pts.select(C.inside(F.col("x"), F.col("y"), square)).collect()] == [True, False]


def test_sampling(spark):
    df = spark.createDataFrame([(i, "a" if i % 5 else "b") for i in range(100)], "id long, g string")
    split = {(r["g"], r["train"]): r["count"] for r in sampling.stratified_split(df, "g", "id").groupBy("g", "train").count().collect()}
    assert split == {("a", True): 64, ("a", False): 16, ("b", True): 16, ("b", False): 4}
    assert sampling.kfold(df, "g", "id", 5).groupBy("g", "fold").count().agg(F.max("count") - F.min("count")).first()[0] <= 16


def test_leiden_separates_cliques():
    import numpy as np

    edges = [(i, j) for base in (0, 6) for i in range(base, base + 6) for j in range(i + 1, base + 6)] + [(0, 6)]
    a, b = np.array(edges).T
    found, quality = graph.leiden(a, b, np.ones(len(a)), 12, 0.3)
    assert len(set(found[:6])) == len(set(found[6:])) == 1 and found[0] != found[6] and quality > 0


def test_models_on_blobs(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(4 * (i % 3), 0.5), rng.gauss(-4 * (i % 3), 0.5)], i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    out, forest = learn.dual_model_predict(df, df, trees=10, depth=5)
    right = out.join(df, "id").agg(F.avg((F.col("m1") == F.col("label")).cast("int")), F.avg((F.col("m2") == F.col("label")).cast("int"))).first()
    assert min(right) > 0.97 and math.isclose(sum(v for _, v in learn.importance(forest)), 1.0)
    clusters, _ = learn.kmeans_clusters(df, 3, restarts=2)
    assert clusters.join(df, "id").groupBy("label").agg(F.countDistinct("cluster").alias("n")).agg(F.max("n")).first()[0] == 1
    with pytest.raises(ValueError):
        learn.dual_model_predict(df.where("label = 0"), df)


def test_prune(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * 7 % 11), 0.0) for i in range(40)], "a double, b double, c double, z double")
    assert dict(learn.prune_features(df, ["a", "b", "c", "z"])) == {"a": "correlated", "b": "kept", "c": "kept", "z": "sparse"}


def test_ground_truth_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("# made by a tool\nImage,Label,CentroidX,CentroidY,f1,f2\ni1,T,1.00,2.00,0.5,x\n\ni1,,1.00,2.00,9,9\ni2,B,3.00,4.00,7\n")
    got = sorted(tuple(r) for r in tables.read_ground_truth(spark, str(tmp_path / "g.csv")).collect())
    assert got == [("B", 7.0, 0.0), ("T", 0.5, 0.0)]
    (tmp_path / "m.csv").write_text("CellType,M1,M2\nT,CD3,CD4\nT,CD3,CD8\nB,CD20,\n")
    marks = {r["cell_type"]: r["markers"] for r in tables.read_marker_table(spark, str(tmp_path / "m.csv")).collect()}
    assert marks == {"T": ["CD3", "CD8"], "B": ["CD20"]}
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1]]]}, "properties": {"name": "r"}}, {"geometry": null}]}')
    shapes = tables.read_geojson(spark, str(tmp_path / "a.geojson")).collect()
    assert [(r["name"], len(r["poly"])) for r in shapes] == [("r", 3)]
