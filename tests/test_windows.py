"""Counts within windows against pairs, and plans of nearest neighbours in many rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import cohort_models, spatial


def cells(spark):
    r = random.Random(2)
    rows = [(i % 3, i, r.randint(0, 40) / 4, r.randint(-20, 20) / 4, r.choice("abc")) for i in range(300)]
    rows += [(0, 400, float("nan"), 1.0, "a"), (0, 401, None, 1.0, "b"), (1, 402, 1.0, 1.0, None), (None, 403, 1.0, 1.0, "a"), (2, 404, 1e6, 1e6, "c"), (2, 405, 1.0, float("inf"), "c")]
    return spark.createDataFrame(rows, "image int, id long, x double, y double, type string")


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_window_composition_and_adjacency_equal_pairs(spark):
    c = cells(spark).where("image is not null")
    pairs = spatial.radius_join(c, c, 1.5)
    assert rounded(spatial.window_composition(c, 1.5)) == rounded(spatial.composition(pairs, c.select("image", "id", "type")))
    expected = spatial.adjacency(pairs, c.select("image", "id", F.col("type").alias("grp")))
    assert rounded(spatial.window_adjacency(c, 1.5)) == rounded(expected)


def test_a_cell_without_image_has_itself_only(spark):
    got = [r["fraction"] for r in spatial.window_composition(cells(spark), 1.5).where("image is null").collect()]
    assert got == [1.0]


def test_windows_make_no_rows_of_pairs(spark):
    plan = spatial.window_composition(cells(spark), 1.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_plans_of_nearest_neighbours_do_not_double_by_round(spark):
    rows = [(0, i, float(2 ** (i % 12)), float(i), "a") for i in range(60)]
    c = spark.createDataFrame(rows, "image int, id long, x double, y double, type string")
    near = spatial.knn_join(c, c, 9)
    assert near.count() == 540
    assert "InMemoryRelation" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert len(near._jdf.queryExecution().analyzed().toString()) < 20_000


def test_a_window_is_one_row_of_all_its_counts(spark):
    """Also of cells at the edges of tiles."""
    r = random.Random(6)
    rows = [(0, i, r.uniform(-9, 9), r.uniform(-9, 9), r.choice("ab")) for i in range(400)]
    c = spark.createDataFrame(rows, "image int, id long, x double, y double, type string")
    got = {r["id"]: {v["type"]: v["n"] for v in r["counts"]} for r in spatial._tile_counts(c, 1.5, ["image"]).collect()}
    want = {}
    for _, i, x, y, _ in rows:
        for _, _, u, v, kind in rows:
            if (x - u) ** 2 + (y - v) ** 2 <= 2.25:
                of = want.setdefault(i, {})
                of[kind] = of.get(kind, 0) + 1
    assert got == want and len(got) == 400


def test_windows_of_repeated_ids_and_ties_at_the_radius(spark):
    rows = [(0, i % 250, float(i % 19), float(i // 19), "abc"[i % 3]) for i in range(361)]
    c = spark.createDataFrame(rows, "image int, id long, x double, y double, type string")
    want, self = {}, [(i, kind) for _, i, _, _, kind in rows]
    for _, i, x, y, _ in rows:
        self += [(i, kind) for _, j, u, v, kind in rows if i != j and (x - u) ** 2 + (y - v) ** 2 <= 25.0]
    for i, kind in self:
        want.setdefault(i, {})[kind] = want.get(i, {}).get(kind, 0) + 1
    want = sorted((0, i, kind, round(n / sum(of.values()), 9)) for i, of in want.items() for kind, n in of.items())
    assert rounded(spatial.window_composition(c, 5.0)) == want


def test_many_pairs_are_dealt_by_cell_and_never_left_to_the_reader(spark):
    c = cells(spark)
    many = spatial.radius_join(c, c, 1.5, many=True)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "gx" in plan
    assert rounded(many) == rounded(spatial.radius_join(c, c, 1.5))


def test_spatial_radius_deals_its_pairs(spark):
    from cytolake.plans.spatial import spatial_radius

    plan = spatial_radius(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("grain", [0.0, 0.25])
def test_windows_by_squares_equal_blocks(grain):
    """Rims, points at the radius itself, null types; only a share of the pairs is compared."""
    rng = np.random.default_rng(3)
    x, y = (rng.uniform(lo, lo + 6, 3000) for lo in (-2, 50))
    if grain:
        x, y = (np.round(z / grain) * grain for z in (x, y))
    kind, q = rng.integers(-1, 4, 3000), np.arange(0, 3000, 3)
    t = [np.flatnonzero(kind == c) for c in range(4)]
    assert (spatial._near_by_square(x, y, q, t, 2.25) == spatial._near_by_kind(x, y, q, t, 2.25)).all()
    assert spatial._by_squares(x, y, 1.5, spatial.BY_SQUARE, 4) and not spatial._by_squares(x + 1e9, y, 1.5, spatial.BY_SQUARE, 4)


def test_crowded_windows_go_by_squares(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BY_SQUARE", 1)
    c = cells(spark).where("image is not null")
    pairs = spatial.radius_join(c, c, 1.5)
    assert rounded(spatial.window_composition(c, 1.5)) == rounded(spatial.composition(pairs, c.select("image", "id", "type")))


def test_means_of_shares_equal_means_of_rows(spark):
    c = cells(spark)
    shares = spatial.window_shares(c, 1.5).withColumn("cn", F.col("id") % 4)
    rows = spatial.window_composition(c, 1.5).withColumn("cn", F.col("id") % 4)
    types = c.select("type").distinct()
    key = lambda df: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())
    assert shares.groupBy("image", "id").count().where("count > 1").isEmpty()
    assert key(cohort_models.share_means(shares, types)) == key(cohort_models.cluster_means(rows, types))
