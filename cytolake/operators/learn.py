"""Models over cells: two-model prediction, feature pruning and importance, reduction, clustering, neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_label, argmax, feature
from .sampling import shuffled
from .stats import feature_stats, unpivot
from .written import written


def assembled(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(F.col(vec).cast("array<double>"), feature)))


def dual_model_predict(train: DataFrame, cells: DataFrame, trees: int = 100, depth: int = 12, seed: int = 42) -> tuple[DataFrame, object]:
    """(id, m1, m2, p1, p2, avg_label, all_label) of all cells from a forest and a linear model of sorted classes, and the forest.

    train: vec, label. At least two classes and twice as many rows as classes are needed.
    """
    classes = [r[0] for r in train.where("label is not null").select("label").distinct().orderBy("label").collect()]
    if len(classes) < 2 or train.count() < 2 * len(classes):
        raise ValueError("training needs two classes and two rows for each")
    names = F.array(*[F.lit(c) for c in classes])
    rows = assembled(train.where("label is not null")).withColumn("y", (F.array_position(names, F.col("label")) - 1).cast("double"))
    forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, impurity="entropy", featureSubsetStrategy="sqrt", seed=seed, probabilityCol="f_p", rawPredictionCol="f_r", predictionCol="f_y").fit(rows)
    linear = LogisticRegression(labelCol="y", featuresCol="features", regParam=1e-3, probabilityCol="l_p", rawPredictionCol="l_r", predictionCol="l_y").fit(rows)
    out = linear.transform(forest.transform(assembled(cells))).withColumns({"p1": vector_to_array("f_p"), "p2": vector_to_array("l_p")})
    pick = lambda p: F.element_at(names, argmax(p) + 1)
    out = out.withColumns({"m1": pick(F.col("p1")), "m2": pick(F.col("p2"))})
    avg = pick(F.zip_with("p1", "p2", lambda a, b: (a + b) / 2))
    return out.select("id", "m1", "m2", "p1", "p2", avg.alias("avg_label"), all_label(F.col("m1").cast("string"), F.col("m2").cast("string")).alias("all_label")), forest


def importance(forest, names: Sequence[str] | None = None) -> list[tuple[str, float]]:
    """(feature, share) with shares that sum to 1."""
    raw = np.asarray(forest.featureImportances.toArray())
    share = raw / raw.sum() if raw.sum() > 0 else raw
    return [(names[i] if names else f"f{i}", float(v)) for i, v in enumerate(share)]


def prune_features(df: DataFrame, columns: Sequence[str], limit: float = 0.95, least: int = 5) -> list[tuple[str, str]]:
    """(feature, why): "kept", "sparse" (few non-zeros or no spread) or "correlated" with a kept one of more spread."""
    stats = {r["feature"]: r for r in feature_stats(unpivot(df, columns)).collect()}
    dense = [c for c in columns if stats[c]["n_nonzero"] >= least and (stats[c]["sd"] or 0) > 0]
    out = {c: "sparse" for c in columns if c not in dense}
    if dense:
        rows = df.select(array_to_vector(F.array(*[feature(F.col(c)) for c in dense])).alias("v"))
        r = np.abs(np.asarray(Correlation.corr(rows, "v").head()[0].toArray()))
        kept: list[int] = []
        for i in sorted(range(len(dense)), key=lambda i: (-stats[dense[i]]["sd"], dense[i])):
            close = any(r[i, j] > limit for j in kept)
            out[dense[i]] = "correlated" if close else "kept"
            if not close:
                kept.append(i)
    return [(c, out[c]) for c in columns]


def pca_reduce(df: DataFrame, most: int = 50, sample: int = 100_000, seed: int = 42) -> DataFrame:
    """(id, vec) reduced to at most ``most`` components where there are more features; the projector is fitted on a bounded
    sample and applied to all rows."""
    first = df.select(F.size("vec").alias("p")).first()
    n = df.limit(most + 2).count()
    if first is None or first["p"] <= most or n < 2:
        return df.select("id", F.col("vec").cast("array<double>").alias("vec"))
    rows = assembled(df)
    k = min(most, first["p"] - 1, df.count() - 1)
    model = PCA(k=k, inputCol="features", outputCol="out").fit(rows.orderBy(shuffled("id", seed)).limit(sample))
    return model.transform(rows).select("id", vector_to_array("out").alias("vec"))


def kmeans_clusters(df: DataFrame, k: int, restarts: int = 10, seed: int = 42) -> tuple[DataFrame, object]:
    """(id, cluster) from the run of least inertia, and its model."""
    rows = assembled(df).persist()
    models = [KMeans(k=k, seed=seed + r, featuresCol="features", predictionCol="cluster").fit(rows) for r in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("id", "cluster"), best


def neighbourhoods(comp: DataFrame, types: Sequence[str], k: int, restarts: int = 3, by: Sequence[str] = ("image",)) -> DataFrame:
    """(by, id, cn) from 1: k-means over window compositions (by, id, type, fraction)."""
    wide = comp.groupBy(*by, "id").pivot("type", list(types)).agg(F.first("fraction"))
    rows = written(wide.select(*by, "id", F.array(*[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in types]).alias("vec")))
    model = kmeans_clusters(rows.select("id", "vec"), k, restarts)[1]
    return model.transform(assembled(rows)).select(*by, "id", (F.col("cluster") + 1).alias("cn"))
