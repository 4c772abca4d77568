"""Queries on feature space (embeddings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knn as K
from .registry import query, table

_E = "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
_D = _E + ", d AS (SELECT a.id, b.id AS other, a.label, b.label AS other_label, list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM e a JOIN e b ON a.id <> b.id{on})"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


@query(_D.format(on="") + " SELECT id, other, round(d2, 6) AS d2, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS r FROM d) WHERE r <= 10")
def feature_knn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return K.feature_knn(v, v, 10).select("id", "other", F.round("d2", 6).alias("d2"), "rank")


@query(_D.format(on=" AND a.id % 5 = 0 AND b.id % 5 <> 0") + """
, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS r FROM d), v AS (SELECT id, other_label AS label, count(*) AS n FROM n WHERE r <= 15 GROUP BY 1, 2)
SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM v) WHERE r = 1""")
def label_transfer(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return K.transfer_labels(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), 15)


_C = _E + ", long AS (SELECT label, generate_subscripts(vec, 1) AS i, unnest(vec) AS v FROM e), m AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM long GROUP BY 1, 2)"


@query(_C + ", c AS (SELECT label, list(m ORDER BY i) AS vec FROM m GROUP BY 1), d AS (SELECT e.id, c.label, list_sum(list_transform(list_zip(e.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM e, c) SELECT id, arg_min(label, d2) AS label FROM d GROUP BY 1")
def nearest_centroid(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return K.nearest_centroid(v, K.centroids(v))


@query(_C + " SELECT label, n, CAST(i - 1 AS INTEGER) AS dim, round(m, 6) AS mean FROM m")
def cluster_centroids(spark, sf_dir):
    out = K.centroids(vectors(spark, sf_dir))
    return out.select("label", "n", F.posexplode("vec").alias("dim", "m")).select("label", "n", "dim", F.round("m", 6).alias("mean"))


@query(_D.format(on="") + """
, n AS (SELECT id, other FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS r FROM d) WHERE r <= 10), s AS (SELECT id, list_append(list(other), id) AS s FROM n GROUP BY 1),
p AS (SELECT DISTINCT least(id, other) AS src, greatest(id, other) AS dst FROM n)
SELECT src, dst, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS w FROM p JOIN s a ON a.id = src JOIN s b ON b.id = dst""")
def jaccard_edges(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return K.snn_edges(K.feature_knn(v, v, 10)).select("src", "dst", F.round("w", 6).alias("w"))


@query()
def ann_recall(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return K.recall(K.feature_knn(v, v, 10), K.approximate_knn(v, 10, width=2.0))


@query(_D.format(on=" AND a.label <> b.label") + """
, n AS (SELECT id, other FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS r FROM d) WHERE r = 1), l AS (SELECT a.id FROM n a JOIN n b ON a.other = b.id AND b.other = a.id),
c AS (SELECT label, count(*) AS n FROM e GROUP BY 1), mj AS (SELECT label FROM c WHERE n = (SELECT max(n) FROM c))
SELECT id, label FROM e WHERE NOT (id IN (SELECT id FROM l) AND label IN (SELECT label FROM mj))""")
def tomek_clean(spark, sf_dir):
    return K.tomek_clean(vectors(spark, sf_dir)).select("id", "label")


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, (SELECT max(n) FROM c) AS n FROM c")
def smote_balance(spark, sf_dir):
    return K.smote(vectors(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query()
def adasyn_balance(spark, sf_dir):
    return K.adasyn(vectors(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))
