"""Queries that fit models (rows-only: fits iterate and draw samples)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn as M
from ..operators import spatial as S
from ..operators import tuning as U
from ..operators.knn import smote
from .neighbours import vectors
from .registry import query, table
from .spatial import RADIUS, _SEG, cells


@query()
def pca_reduce(spark, sf_dir):
    return M.pca_reduce(vectors(spark, sf_dir)).select("id", F.size("vec").alias("components"), F.round(F.get("vec", F.lit(0)), 4).alias("first"))


@query()
def kmeans_clusters(spark, sf_dir):
    return M.kmeans_clusters(vectors(spark, sf_dir), 10, restarts=3)[0]


@query()
def neighborhoods(spark, sf_dir):
    return M.neighbourhoods(S.window_composition(cells(spark, sf_dir), RADIUS), _SEG, 5)


@query()
def dual_model_predict(spark, sf_dir):
    v = vectors(spark, sf_dir)
    out, _ = M.dual_model_predict(v.where("id % 2 = 0").select("vec", "label"), v, trees=20, depth=8)
    return out.select("id", "m1", "m2", "avg_label", "all_label")


@query()
def feature_importance(spark, sf_dir):
    v = vectors(spark, sf_dir)
    _, forest = M.dual_model_predict(v.select("vec", "label"), v, trees=20, depth=8)
    return spark.createDataFrame(M.importance(forest), "feature string, importance double")


@query()
def prune_features(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("double_quantity", F.col("l_quantity") * 2 + 1).withColumn("zero", F.lit(0.0))
    rows = M.prune_features(df, ["l_quantity", "double_quantity", "l_extendedprice", "l_discount", "zero"])
    return spark.createDataFrame(rows, "feature string, verdict string")


@query()
def train_validation_metrics(spark, sf_dir):
    return U.train_validation_metrics(vectors(spark, sf_dir), resample=smote, trees=20, depth=8)


@query()
def scatter_pca(spark, sf_dir):
    out = M.pca_reduce(vectors(spark, sf_dir), most=2)
    return out.select("id", F.round(F.get("vec", F.lit(0)), 4).alias("x"), F.round(F.get("vec", F.lit(1)), 4).alias("y"))
