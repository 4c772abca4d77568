"""Queries on space (customer: image c_nationkey, x c_acctbal, y (c_custkey * 7919) % 10007, class c_mktsegment) and on
sampling (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import sampling as U
from ..operators import spatial as S
from .registry import query, table

_CELLS = "WITH cells AS (SELECT c_nationkey AS image, c_custkey AS id, c_acctbal AS x, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS y, c_mktsegment AS type FROM customer)"
_PAIRS = _CELLS + ", pairs AS (SELECT a.image, a.id, b.id AS other, a.type, b.type AS other_type, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM cells a JOIN cells b ON a.image = b.image AND a.id <> b.id)"
RADIUS = 1500.0
_POLY = [(1000.0, 1000.0), (8000.0, 2000.0), (6000.0, 9000.0), (2500.0, 4000.0)]
_POLY2 = [(3000.0, 500.0), (9500.0, 6000.0), (4000.0, 8000.0)]


def cells(spark, sf_dir):
    y = ((F.col("c_custkey") * 7919) % 10007).cast("double")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), y.alias("y"), F.col("c_mktsegment").alias("type"))


@query(_PAIRS + " SELECT image, id, other, round(d2, 2) AS d2, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image, id ORDER BY d2, other) AS r FROM pairs) WHERE r <= 5")
def spatial_knn(spark, sf_dir):
    c = cells(spark, sf_dir)
    return S.knn_join(c, c, 5).select("image", "id", "other", F.round("d2", 2).alias("d2"), "rank")


@query(_PAIRS + f" SELECT image, id, other, round(d2, 2) AS d2 FROM pairs WHERE d2 <= {RADIUS * RADIUS}")
def spatial_radius(spark, sf_dir):
    c = cells(spark, sf_dir)
    near = S.radius_join(c, c, RADIUS, many=True)
    # rounds as SQL does; F.round goes through a decimal for each of the many pairs
    return near.select("image", "id", "other", (F.floor(F.col("d2") * 100 + 0.5) / 100.0).alias("d2"))


@query(_PAIRS + " SELECT image, id, type, round(sqrt(min(d2)), 4) AS distance FROM pairs WHERE type = other_type GROUP BY 1, 2, 3")
def same_class_nn(spark, sf_dir):
    c = cells(spark, sf_dir)
    return S.knn_join(c, c, 1, ["image", "type"]).select("image", "id", "type", F.round(F.sqrt("d2"), 4).alias("distance"))


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(_PAIRS + " SELECT image, id, " + ", ".join(f"round(sqrt(min(CASE WHEN other_type = '{s}' THEN d2 END)), 4) AS {s}" for s in _SEG) + " FROM pairs GROUP BY 1, 2")
def cross_class_nn(spark, sf_dir):
    c = cells(spark, sf_dir)
    queries = c.drop("type").withColumn("type", F.explode(F.array(*[F.lit(s) for s in _SEG])))
    near = S.knn_join(queries, c, 1, ["image", "type"])
    return near.groupBy("image", "id").pivot("type", _SEG).agg(F.round(F.sqrt(F.min("d2")), 4))


_WINDOW = _PAIRS + f""", w AS (SELECT image, id, other_type AS type FROM pairs WHERE d2 <= {RADIUS * RADIUS} UNION ALL SELECT image, id, type FROM cells),
comp AS (SELECT image, id, type, count(*) / sum(count(*)) OVER (PARTITION BY image, id) AS fraction FROM w GROUP BY 1, 2, 3)"""


def _composition(spark, sf_dir):
    return S.window_composition(cells(spark, sf_dir), RADIUS)


@query(_WINDOW + " SELECT image, id, type, round(fraction, 6) AS fraction FROM comp")
def window_composition(spark, sf_dir):
    return _composition(spark, sf_dir).select("image", "id", "type", F.round("fraction", 6).alias("fraction"))


@query(_WINDOW + " SELECT image, id, round(least(-sum(fraction * ln(fraction)) / ln(5), 1), 6) AS diversity FROM comp GROUP BY 1, 2")
def window_diversity(spark, sf_dir):
    return S.diversity_of(_composition(spark, sf_dir), 5).select("image", "id", F.abs(F.round("diversity", 6)).alias("diversity"))


@query(_PAIRS + f" SELECT type AS a, other_type AS b, count(*) AS n FROM pairs WHERE d2 <= {RADIUS * RADIUS} AND type <> other_type GROUP BY 1, 2")
def cn_adjacency(spark, sf_dir):
    return S.window_adjacency(cells(spark, sf_dir), RADIUS)


def _crossings(poly) -> str:
    parts = []
    for (xi, yi), (xj, yj) in zip(poly, [poly[-1], *poly[:-1]], strict=True):
        parts.append(f"CAST((({yi} > y) <> ({yj} > y)) AND x < ({xj - xi}) * (y - {yi}) / ({yj - yi}) + {xi} AS INTEGER)")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query(_CELLS + f" SELECT image, id, {_crossings(_POLY)} AS inside FROM cells")
def point_in_polygon(spark, sf_dir):
    return cells(spark, sf_dir).select("image", "id", C.inside(F.col("x"), F.col("y"), _POLY).alias("inside"))


@query(_CELLS + f", h AS (SELECT image, id, 1 AS seq, 'core' AS name FROM cells WHERE {_crossings(_POLY)} UNION ALL SELECT image, id, 2, 'rim' FROM cells WHERE {_crossings(_POLY2)}) SELECT image, id, string_agg(name, '; ' ORDER BY seq) AS shapes FROM h GROUP BY 1, 2")
def containing_annotations(spark, sf_dir):
    c = cells(spark, sf_dir)
    point = lambda p: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p])
    images = c.select("image").distinct()
    shapes = images.select("image", F.lit("core").alias("name"), F.lit(1).alias("seq"), point(_POLY).alias("poly")).unionByName(images.select("image", F.lit("rim").alias("name"), F.lit(2).alias("seq"), point(_POLY2).alias("poly")))
    return S.containing(c, shapes, 2000.0)


@query(_CELLS + """
, lab AS (SELECT s_nationkey AS image, s_suppkey AS id, s_acctbal AS x, CAST((s_suppkey * 104729) % 10007 AS DOUBLE) AS y, 'L' || s_suppkey % 4 AS label FROM supplier),
j AS (SELECT l.image, l.id, l.label, c.id AS cell, row_number() OVER (PARTITION BY l.image, l.id ORDER BY (l.x - c.x) * (l.x - c.x) + (l.y - c.y) * (l.y - c.y), c.id) AS r FROM lab l JOIN cells c ON l.image = c.image AND (l.x - c.x) * (l.x - c.x) + (l.y - c.y) * (l.y - c.y) <= 2000.0 * 2000.0)
SELECT image, cell, arg_max(label, id) AS label FROM j WHERE r = 1 GROUP BY 1, 2""")
def nearest_label_import(spark, sf_dir):
    y = ((F.col("s_suppkey") * 104729) % 10007).cast("double")
    labels = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("image"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), y.alias("y"), F.concat(F.lit("L"), (F.col("s_suppkey") % 4).cast("string")).alias("label"), F.col("s_suppkey").alias("seq"))
    return S.nearest_label(labels, cells(spark, sf_dir).drop("type"), 2000.0)


_MD5 = "md5(event_id::VARCHAR || ':42')"


@query(f"SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_MD5}, event_id) AS r FROM events) WHERE r <= 50")
def even_sample(spark, sf_dir):
    return U.even_sample(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 50)


@query(f"SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_MD5}, event_id) <= greatest(1, floor(count(*) OVER (PARTITION BY event_type) * 0.8)) AS train FROM events")
def stratified_split(spark, sf_dir):
    return U.stratified_split(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


@query(f"SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY {_MD5}, event_id) - 1) % 5 AS INTEGER) AS fold FROM events")
def kfold_assign(spark, sf_dir):
    return U.kfold(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 5)


_TIER = """
{name}_rank AS (SELECT {group}, row_number() OVER (ORDER BY {order}, {group}) AS rank FROM (SELECT {group}, avg(differs) AS share, count(*) AS n FROM {pool} GROUP BY 1)),
{name}_few AS (SELECT id, {group}, row_number() OVER (PARTITION BY {group} ORDER BY o, id) AS r FROM {pool} WHERE differs = 1 AND id NOT IN ({used})),
{name} AS (SELECT id FROM {name}_few JOIN {name}_rank USING ({group}) WHERE r <= {each} ORDER BY rank, r LIMIT {budget})"""


@query("""
WITH rows AS (SELECT event_id AS id, user_id % 25 AS fov, event_type AS m1, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS differs, event_id % 11 = 0 AS reviewed, md5(event_id::VARCHAR || ':42') AS o FROM events),
fresh AS (SELECT * FROM rows WHERE NOT reviewed), """ + ",".join([
    _TIER.format(name="t_fov", group="fov", order="share DESC", pool="rows", used="SELECT -1", each=14, budget=84),
    _TIER.format(name="t_type", group="m1", order="share DESC", pool="fresh", used="SELECT id FROM t_fov", each=16, budget=112),
    _TIER.format(name="t_rare", group="m1", order="n ASC", pool="fresh", used="SELECT id FROM t_fov UNION ALL SELECT id FROM t_type", each=10, budget=60),
]) + """, taken AS (SELECT id, 'fov' AS tier FROM t_fov UNION ALL SELECT id, 'type' FROM t_type UNION ALL SELECT id, 'rare' FROM t_rare),
fill AS (SELECT id, 'fill' AS tier FROM fresh WHERE id NOT IN (SELECT id FROM taken) ORDER BY o, id LIMIT 300)
SELECT id, tier FROM (SELECT * FROM taken UNION ALL SELECT * FROM fill) ORDER BY CASE WHEN tier = 'fill' THEN 1 ELSE 0 END, md5(id::VARCHAR || ':42'), id LIMIT 300""".replace("300", "256"))
def uncertainty_sample(spark, sf_dir):
    m2 = F.when(F.col("event_id") % 7 == 0, "other").otherwise(F.col("event_type"))
    pred = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 25).alias("fov"), F.col("event_type").alias("m1"), m2.alias("m2"), (F.col("event_id") % 11 == 0).alias("reviewed"))
    return U.uncertainty_sample(pred)
