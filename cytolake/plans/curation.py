"""Queries on names, labels, selections, shapes and neighbourhood tables (part, customer, supplier, events, region)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gating as G
from ..operators import cohort_models as M
from ..operators import curation as U
from ..operators import spatial as S
from .neighbours import vectors
from .predicted import _PRED, predictions
from .registry import query, table
from .spatial import _CELLS, _POLY, _POLY2, _WINDOW, RADIUS, _crossings, cells

_RULES = "SELECT r_regionkey AS k, r_name AS rule FROM region"


@query(f"""
WITH r AS ({_RULES}) SELECT rule, 'M' || c AS channel, CASE WHEN c = 5 THEN -1 WHEN (c - k + 5) % 5 = 0 THEN 1 WHEN (c - k + 5) % 5 IN (1, 2) THEN 2 WHEN (c - k + 5) % 5 = 3 THEN -3 ELSE 0 END AS code
FROM r, range(6) t(c)""")
def gating_encoding(spark, sf_dir):
    m = lambda i: F.concat(F.lit("M"), ((F.col("r_regionkey") + i) % 5).cast("string"))
    primary = F.concat(m(0), F.lit(" & ("), m(1), F.lit(" | "), m(2), F.lit(") & !"), m(3))
    rules = table(spark, sf_dir, "region").select(F.col("r_name").alias("cell_type"), primary.alias("primary"), m(4).alias("secondary"), F.concat(m(0), F.lit("|"), m(3)).alias("tertiary"))
    return G.encoded(rules, [f"M{i}" for i in range(6)])


_NAMED = "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'UMAP_' || p_size WHEN 1 THEN p_brand || ': Cell: Mean' WHEN 2 THEN 'Nucleus: Area' WHEN 3 THEN 'Neighbors: ' || p_type WHEN 4 THEN p_brand ELSE 'Pecam: emb' || p_size END AS name FROM part"


def _named(spark, sf_dir):
    k, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    name = F.when(k % 6 == 0, F.concat(F.lit("UMAP_"), text("p_size"))).when(k % 6 == 1, F.concat(F.col("p_brand"), F.lit(": Cell: Mean"))).when(k % 6 == 2, F.lit("Nucleus: Area"))
    name = name.when(k % 6 == 3, F.concat(F.lit("Neighbors: "), F.col("p_type"))).when(k % 6 == 4, F.col("p_brand")).otherwise(F.concat(F.lit("Pecam: emb"), text("p_size")))
    return table(spark, sf_dir, "part").select(k.alias("k"), name.alias("name"))


@query(f"""
WITH n AS ({_NAMED}) SELECT k, CASE WHEN k % 6 = 0 THEN 'Embeddings' WHEN k % 6 = 4 THEN 'Other / Uncategorized' WHEN k % 6 = 2 THEN 'Morphology / Shape' ELSE split_part(name, ': ', 1) END AS grp,
  CASE WHEN k % 6 IN (1, 5) THEN substr(name, instr(name, ': ') + 2) ELSE name END AS leaf FROM n""")
def feature_groups(spark, sf_dir):
    return _named(spark, sf_dir).select("k", U.feature_group(F.col("name")).alias("grp"), U.leaf_label(F.col("name")).alias("leaf"))


@query("SELECT name, min(k) AS row, min(place) AS place FROM (SELECT p_type AS name, p_partkey AS k, 0 AS place FROM part UNION ALL SELECT p_brand, p_partkey, 1 FROM part) GROUP BY 1")
def discovered_features(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.create_map("p_type", F.col("p_size").cast("double"), "p_brand", F.col("p_retailprice")).alias("m"))
    return U.discovered(p, "m", "p_partkey")


@query("SELECT p_partkey, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, 1 AS kept FROM part")
def measurement_lookup(spark, sf_dir):
    m = F.create_map(F.lit("Cell: Price"), F.col("p_retailprice"), F.lit("Cell: Size"), F.col("p_size").cast("double"), F.lit("Price again"), F.lit(0.0))
    p = table(spark, sf_dir, "part").withColumn("m", m)
    return p.select("p_partkey", U.measurement_like(F.col("m"), "pRICE").alias("price"), U.measurement_like(F.col("m"), "size").alias("size"), F.size(U.without_measurements(F.col("m"), ["PRICE"])).alias("kept"))


_RAW = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type || '-mergedInto(view)' ELSE event_type END AS raw, event_id % 1000 AS cell FROM events"


def _raw(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.col("event_type"), F.lit("-mergedInto(view)"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), (F.col("event_id") % 1000).alias("cell"))


@query(f"WITH r AS ({_RAW}) SELECT event_id, raw FROM r WHERE raw NOT IN ('click', 'error') AND raw NOT LIKE '%-mergedInto(view)' AND raw <> 'view'")
def purged_labels(spark, sf_dir):
    return U.labels_of(_raw(spark, sf_dir), ["click", "error", "view"], keep=False).select("event_id", "raw")


@query(f"WITH r AS ({_RAW}) SELECT cell, arg_max(raw, event_id) AS raw, max(event_id) AS event_id FROM r GROUP BY 1")
def latest_labels(spark, sf_dir):
    return U.latest(_raw(spark, sf_dir).select("cell", "raw", "event_id"), ["cell"], "event_id")


@query("SELECT event_type, CASE user_id % 4 WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE event_type END AS class, count(*) AS n FROM events GROUP BY 1, 2")
def mapped_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("cluster"), F.col("event_type").alias("class"), "event_type")
    mapping = spark.createDataFrame([(1, "A"), (2, "B")], "cluster long, class string")
    return U.mapped_clusters(e, mapping).groupBy("event_type", "class").agg(F.count("*").alias("n"))


@query("SELECT user_id % 25 AS image FROM events GROUP BY 1 HAVING NOT bool_and(value IS NOT NULL AND NOT isnan(value) AND value >= 3)")
def incomplete_images(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("image"), F.when(F.col("value") >= 3, F.col("value")).alias("v"))
    return U.incomplete_images(e, ["v"])


@query(_PRED + ", s AS (SELECT image, count(*) AS predicted, avg(CASE WHEN m1 <> m2 THEN 10.0 ELSE 0.0 END) AS score FROM pred GROUP BY 1) SELECT image, predicted, round(score, 6) AS score FROM s WHERE score >= 1.5 OR image % 10 = 0")
def summary_view(spark, sf_dir):
    s = predictions(spark, sf_dir).groupBy("image").agg(F.count("*").alias("predicted"), F.avg(F.when(F.col("m1") != F.col("m2"), 10.0).otherwise(0.0)).alias("score"))
    return U.summary_view(s.withColumn("flagged", F.col("image") % 10 == 0), "strict").select("image", "predicted", F.round("score", 6).alias("score"))


@query(_CELLS + " SELECT image, id FROM cells WHERE x BETWEEN 1000 AND 5000 AND y BETWEEN 200 AND 7000.5")
def box_selection(spark, sf_dir):
    return cells(spark, sf_dir).where(U.in_box(F.col("x"), F.col("y"), (5000.0, 200.0, 1000.0, 7000.5))).select("image", "id")


_BOXED = _CELLS + ", b AS (SELECT image, id, x, y, 10.0 + id % 7 AS w, 10.0 + id % 11 AS h, greatest(96.0, 8 * greatest(10.0 + id % 7, 10.0 + id % 11)) AS tile FROM cells WHERE x > 0), t AS (SELECT *, floor(greatest(0.0, x - tile / 2)) AS lft, floor(greatest(0.0, y - tile / 2)) AS tp FROM b), win AS (SELECT *, CAST(lft AS BIGINT) AS wx, CAST(tp AS BIGINT) AS wy, CAST(greatest(1, ceil(least(10000.0 - lft, tile))) AS BIGINT) AS ww, CAST(greatest(1, ceil(least(10007.0 - tp, tile))) AS BIGINT) AS wh FROM t)"


def _boxed(spark, sf_dir):
    b = cells(spark, sf_dir).where("x > 0").withColumns({"w": 10.0 + F.col("id") % 7, "h": 10.0 + F.col("id") % 11})
    return b.withColumn("window", U.crop(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 10000, 10007))


@query(_BOXED + " SELECT image, id, wx, wy, ww, wh FROM win")
def crop_windows(spark, sf_dir):
    return _boxed(spark, sf_dir).select("image", "id", F.col("window.x").alias("wx"), F.col("window.y").alias("wy"), F.col("window.w").alias("ww"), F.col("window.h").alias("wh"))


@query(_BOXED + " SELECT s.image, s.id AS sampled, c.id, round(c.x - s.wx, 4) AS dx, round(c.y - s.wy, 4) AS dy FROM win s JOIN b c ON s.image = c.image AND (abs(c.x - (s.wx + s.ww / 2.0)) * 2 < c.w + s.ww AND abs(c.y - (s.wy + s.wh / 2.0)) * 2 < c.h + s.wh OR c.id = s.id) WHERE s.id % 5 = 0")
def crop_context(spark, sf_dir):
    b = _boxed(spark, sf_dir)
    out = U.crop_context(b.where("id % 5 = 0").select("image", "id", "window"), b.drop("window"), 500.0)
    return out.select("image", "sampled", "id", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


@query("WITH m AS (SELECT DISTINCT lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS m FROM nation WHERE n_nationkey % 3 = 0) SELECT n_name AS channel, bool_or(contains(lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')), m) OR contains(m, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')))) AS shown FROM nation, m GROUP BY 1")
def matching_channels(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return U.matching_channels(n.select(F.col("n_name").alias("channel")), n.where("n_nationkey % 3 = 0").select(F.lower("n_name").alias("marker")))


def _shapes(spark, sf_dir):
    point = lambda p: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p])
    images = cells(spark, sf_dir).select("image").distinct()
    return images.select("image", F.lit("Tumor core").alias("name"), point(_POLY).alias("poly")).unionByName(images.select("image", F.lit("Rim").alias("name"), point(_POLY2).alias("poly")))


@query(_CELLS + f" SELECT image, id FROM cells WHERE {_crossings(_POLY)}")
def keyword_cells(spark, sf_dir):
    return U.keyword_cells(cells(spark, sf_dir), _shapes(spark, sf_dir), [" CORE ", "absent"], 2000.0)


def _shoelace(poly) -> float:
    return abs(sum(xj * yi - xi * yj for (xi, yi), (xj, yj) in zip(poly, [poly[-1], *poly[:-1]], strict=True))) / 2


_INNER, _OUTER = (("Tumor core", _POLY), ("Rim", _POLY2)) if _shoelace(_POLY) < _shoelace(_POLY2) else (("Rim", _POLY2), ("Tumor core", _POLY))


@query(_CELLS + f" SELECT image, id, CASE WHEN {_crossings(_INNER[1])} THEN '{_INNER[0]}' ELSE '{_OUTER[0]}' END AS parent FROM cells WHERE {_crossings(_INNER[1])} OR {_crossings(_OUTER[1])}")
def smallest_container(spark, sf_dir):
    return U.smallest_container(cells(spark, sf_dir), _shapes(spark, sf_dir), 2000.0)


def _segments(poly) -> str:
    parts = []
    for (xi, yi), (xj, yj) in zip([poly[-1], *poly[:-1]], poly, strict=True):
        dx, dy = xj - xi, yj - yi
        t = f"least(1.0, greatest(0.0, ((x - {xi}) * ({dx}) + (y - {yi}) * ({dy})) / {dx * dx + dy * dy}))"
        parts.append(f"sqrt((x - {xi} - {t} * ({dx})) * (x - {xi} - {t} * ({dx})) + (y - {yi} - {t} * ({dy})) * (y - {yi} - {t} * ({dy})))")
    return f"least({', '.join(parts)})"


@query(_CELLS + f" SELECT image, id, round(CASE WHEN {_crossings(_POLY)} THEN -1 ELSE 1 END * {_segments(_POLY)}, 4) AS distance FROM cells")
def signed_distance(spark, sf_dir):
    poly = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _POLY])
    return cells(spark, sf_dir).select("image", "id", F.round(U.signed_distance(F.col("x"), F.col("y"), poly), 4).alias("distance"))


_CN = _WINDOW + ", cn AS (SELECT image, id, id % 4 AS cn FROM cells), r AS (SELECT image, id, cn, comp.type, fraction FROM comp JOIN cn USING (image, id) WHERE cn >= 1), z AS (SELECT cn, count(*) AS n FROM cn WHERE cn >= 1 GROUP BY 1), m AS (SELECT z.cn, t.type, coalesce(sum(fraction), 0) / any_value(z.n) AS mean, any_value(z.n) AS n FROM z CROSS JOIN (SELECT DISTINCT type FROM cells) t LEFT JOIN r ON r.cn = z.cn AND r.type = t.type GROUP BY 1, 2)"


def _means(spark, sf_dir):
    rows = S.window_shares(cells(spark, sf_dir), RADIUS).withColumn("cn", F.col("id") % 4)
    return M.share_means(rows, cells(spark, sf_dir).select("type").distinct())


@query(_CN + " SELECT cn, type, round(mean, 6) AS mean, n FROM m")
def cn_means(spark, sf_dir):
    return _means(spark, sf_dir).select("cn", "type", F.round("mean", 6).alias("mean"), "n")


@query(_CN + ", q AS (SELECT CASE cn WHEN 1 THEN 'Immune' WHEN 3 THEN 'Immune' ELSE 'CN 2' END AS name, * FROM m) SELECT name, type, round(sum(mean * n) / sum(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS n FROM q GROUP BY 1, 2")
def cn_merged(spark, sf_dir):
    names = spark.createDataFrame([(1, "Immune"), (2, " "), (3, "Immune")], "cn long, name string")
    return M.merged_means(_means(spark, sf_dir), names).select("name", "type", F.round("mean", 6).alias("mean"), "n")


@query(_CELLS + " SELECT image, id, CASE id % 4 WHEN 0 THEN -1 WHEN 2 THEN 2 ELSE 1 END AS cn_code, CASE id % 4 WHEN 0 THEN 'Unassigned' WHEN 2 THEN 'CN 2' ELSE 'Immune' END AS cn_name FROM cells")
def cn_codes(spark, sf_dir):
    names = spark.createDataFrame([(1, "Immune"), (2, None), (3, "Immune")], "cn long, name string")
    return M.class_codes(cells(spark, sf_dir).withColumn("cn", F.col("id") % 4), names).select("image", "id", "cn_code", "cn_name")


@query(_CELLS + ", n AS (SELECT id % 4 AS cn, count(*) AS n FROM cells WHERE id % 4 >= 1 GROUP BY 1) SELECT cn, n, round(n / sum(n) OVER (), 6) AS share FROM n")
def cn_frequencies(spark, sf_dir):
    return M.frequencies(cells(spark, sf_dir).withColumn("cn", F.col("id") % 4)).select("cn", "n", F.round("share", 6).alias("share"))


@query("SELECT round(avg(-ln(greatest(CASE event_type WHEN 'click' THEN 0.7 WHEN 'view' THEN 0.3 ELSE 0 END, 1e-15))), 6) AS log_loss FROM events")
def log_loss(spark, sf_dir):
    y = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    e = table(spark, sf_dir, "events").select(y.alias("y"), F.array(F.lit(0.7), F.lit(0.3), F.lit(0.0)).alias("p"))
    return U.log_loss(e, "y", "p").select(F.round("log_loss", 6).alias("log_loss"))


@query("""
WITH v AS (SELECT l_quantity AS a, l_quantity * 2 + 1 AS b, l_extendedprice AS c, 0.0 AS d, l_discount AS e FROM lineitem),
s AS (SELECT abs(corr(a, b)) AS r, count(*) FILTER (WHERE d <> 0) AS n, stddev_pop(a) < stddev_pop(b) AS less, stddev_pop(c) > 0 AS varies FROM v)
SELECT 'l: quantity' AS feature, 'l' AS grp, CASE WHEN less AND r > 0.95 THEN 'within' ELSE 'kept' END AS verdict FROM s
UNION ALL SELECT 'l: double', 'l', 'kept' FROM s UNION ALL SELECT 'p: price', 'p', 'kept' FROM s WHERE varies
UNION ALL SELECT 'p: zero', 'p', CASE WHEN n < 5 THEN 'constant' ELSE 'kept' END FROM s UNION ALL SELECT 'd: discount', 'd', 'kept' FROM s""")
def grouped_pruning(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("l: quantity"), (F.col("l_quantity") * 2 + 1).alias("l: double"), F.col("l_extendedprice").alias("p: price"), F.lit(0.0).alias("p: zero"), F.col("l_discount").alias("d: discount"))
    return M.prune_by_group(df, df.columns, whitelist=1)


@query()
def cohort_kmeans(spark, sf_dir):
    return M.cohort_kmeans(cells(spark, sf_dir), ["x", "y"], 6, per_image=500)


@query()
def cohort_leiden(spark, sf_dir):
    v = vectors(spark, sf_dir)
    wide = v.select("id", *[F.get("vec", F.lit(i)).alias(f"d{i}") for i in range(8)])
    return M.cohort_leiden(wide, [f"d{i}" for i in range(8)], sample_size=20_000, gamma=0.02)


@query()
def smote_tomek(spark, sf_dir):
    return M.smote_tomek(vectors(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))

