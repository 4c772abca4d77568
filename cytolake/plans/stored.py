"""Queries that save tables and read them back (events: labels and predictions by image user_id % 25; part: marker tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import stores as K
from .predicted import _LIST, _PRED, CLASSES, predictions
from .registry import query, table


def _image(c):
    return F.concat(F.lit("img/"), c.cast("string"))


@query("""
SELECT event_id AS cell, CASE WHEN user_id % 25 = 3 THEN 'again ' ELSE '' END || event_type AS label, CASE WHEN event_id % 2 = 0 THEN 'main' ELSE 'M: x' END AS scope, 'img/' || user_id % 25 AS image
FROM events WHERE NOT (user_id % 25 = 7 AND event_id % 2 = 0) AND NOT (user_id % 25 = 3 AND event_id % 3 = 0)""")
def label_store(spark, sf_dir):
    """Labels are saved, one image is saved again with fewer, and one image of a scope is removed."""
    image, path = F.col("user_id") % 25, K.scratch(spark)
    scope = F.when(F.col("event_id") % 2 == 0, "main").otherwise("M: x")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("cell"), F.col("event_type").alias("label"), scope.alias("scope"), _image(image).alias("image"), image.alias("i"))
    K.save_labels(rows, path)
    K.save_labels(rows.where("i = 3 and cell % 3 <> 0").withColumn("label", F.concat(F.lit("again "), "label")), path)
    K.remove(spark, path, scope="main", image="img/7")
    return K.load_labels(spark, path)


@query(_PRED + f", p AS (SELECT *, [((event_id * 3 + i) % 11) / 11.0 FOR i IN [0,1,2,3,4]] AS p1 FROM pred WHERE event_id % 4 <> 0 AND event_id % 9 <> 0) SELECT event_id AS id, 'img/' || image AS image, m1, m2, p1[list_position({_LIST}, m2)] AS p FROM p")
def prediction_store(spark, sf_dir):
    """Of the rows that are saved those without a label and those of too few probabilities are left out."""
    path, id_ = K.scratch(spark), F.col("event_id")
    probs = F.array(*[((id_ * 3 + i) % 11) / F.lit(11.0) for i in range(5)])
    short = F.when(id_ % 4 == 0, F.slice(probs, 1, 4)).otherwise(probs)
    rows = predictions(spark, sf_dir).select(id_.alias("id"), F.when(id_ % 9 != 0, F.col("m1")).alias("m1"), "m2", short.alias("p1"), probs.alias("p2"), F.array(*[F.lit(c) for c in CLASSES]).alias("classes"), _image(F.col("image")).alias("image"))
    K.save_predictions(rows, path)
    got = K.load_predictions(spark, path)
    return got.select("id", "image", "m1", "m2", F.get("p1", F.array_position("classes", F.col("m2")).cast("int") - 1).alias("p"))


@query("SELECT p_type AS cell_type, count(DISTINCT p_brand) AS markers, min(p_brand) AS first FROM part GROUP BY 1")
def marker_store(spark, sf_dir):
    path = K.scratch(spark)
    K.save_markers(table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("cell_type")).agg(F.array_sort(F.collect_set("p_brand")).alias("markers")), path)
    return K.load_markers(spark, path).select("cell_type", F.size("markers").cast("long").alias("markers"), F.get("markers", F.lit(0)).alias("first"))
