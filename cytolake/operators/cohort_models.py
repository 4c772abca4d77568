"""Neighbourhood tables of a cohort and models that are fitted on a sample and applied to every image."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import feature, marker_group
from .graph import leiden_clusters
from .knn import feature_knn, snn_edges, tomek_clean, smote, transfer_labels
from .sampling import even_sample, shuffled
from .stats import column_stats, standardised
from .written import written


def cluster_means(rows: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(cn, type, mean, n): mean fraction of each type among the cells of a neighbourhood, absent types 0. rows: image, id, cn, type,
    fraction; cells whose cn is below 1 are left out."""
    used = written(rows.where("cn >= 1"))
    size = used.select("image", "id", "cn").distinct().groupBy("cn").agg(F.count("*").alias("n"))
    names = types if types is not None else used.select("type").distinct()
    grid = size.crossJoin(F.broadcast(names))  # neighbourhoods times types: both are a handful
    total = used.groupBy("cn", "type").agg(F.sum("fraction").alias("s"))
    return grid.join(total, ["cn", "type"], "left").select("cn", "type", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"), "n")


def share_means(cells: DataFrame, types: DataFrame) -> DataFrame:
    """``cluster_means`` of cells (cn, shares of type, fraction), one row a cell, in one pass: a cell counts with its first share."""
    each = cells.where("cn >= 1").select("cn", F.posexplode("shares").alias("place", "share"))
    total = written(each.groupBy("cn", "share.type").agg(F.sum("share.fraction").alias("s"), F.count_if(F.col("place") == 0).alias("n")))
    grid = total.groupBy("cn").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(types))
    return grid.join(total.select("cn", "type", "s"), ["cn", "type"], "left").select("cn", "type", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"), "n")


def merged_means(means: DataFrame, names: DataFrame) -> DataFrame:
    """(name, type, mean, n): neighbourhoods of one name together, weighted by their cells. A blank name is ``CN`` and the number."""
    named = means.join(names, "cn", "left").withColumn("name", display_name("name", "cn"))
    out = named.groupBy("name", "type").agg(F.sum(F.col("mean") * F.col("n")).alias("m"), F.sum("n").alias("n"))
    return out.select("name", "type", F.coalesce(F.try_divide("m", "n"), F.lit(0.0)).alias("mean"), "n")


def display_name(name: str, cn: str):
    return F.when(F.trim(F.coalesce(name, F.lit(""))) != "", F.col(name)).otherwise(F.concat(F.lit("CN "), F.col(cn).cast("string")))


def present_types(means: DataFrame) -> DataFrame:
    """The rows of types that occur in some neighbourhood."""
    return means.join(F.broadcast(means.groupBy("type").agg(F.max("mean").alias("top")).where("top > 0").select("type")), "type", "left_semi")


def class_codes(cells: DataFrame, names: DataFrame) -> DataFrame:
    """cells (…, cn) with ``cn_name`` and ``cn_code``: distinct names count from 1 in order of their first cn; cells without one are
    ``Unassigned`` and -1. names: cn, name, one row per neighbourhood."""
    shown = names.withColumn("cn_name", display_name("name", "cn")).select("cn", "cn_name")
    first = shown.groupBy("cn_name").agg(F.min("cn").alias("first"))
    earlier = first.select(F.col("first").alias("other"))
    codes = first.join(F.broadcast(earlier), F.col("other") <= F.col("first")).groupBy("cn_name").agg(F.count("*").cast("int").alias("cn_code"))
    both = shown.join(codes, "cn_name")
    out = cells.join(F.broadcast(both), "cn", "left")
    given = F.col("cn") >= 1
    name = F.when(given, F.coalesce("cn_name", F.concat(F.lit("CN "), F.col("cn").cast("string")))).otherwise("Unassigned")
    return out.withColumns({"cn_code": F.coalesce(F.when(given, F.col("cn_code")), F.lit(-1)), "cn_name": name})


def frequencies(cells: DataFrame) -> DataFrame:
    """(cn, n, share) of neighbourhoods among all assigned cells."""
    n = cells.where("cn >= 1").groupBy("cn").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("cn", "n", (F.col("n") / F.col("all")).alias("share"))


def contrast_colours(weights: np.ndarray, palette: Sequence[tuple[int, int, int]]) -> list[int]:
    """Palette number of each group: from the group with most adjacency on, the unused colour whose least distance from its coloured
    neighbours is largest. weights: adjacency counts in both directions, of a handful of groups."""
    both = weights + weights.T
    colours = np.asarray(palette, float)
    chosen = np.full(len(both), -1)
    for g in np.argsort(-both.sum(1), kind="stable"):
        near = [chosen[o] for o in range(len(both)) if o != g and chosen[o] >= 0 and both[g, o] > 0]
        free = [p for p in range(len(colours)) if p not in chosen] or list(range(len(colours)))
        apart = [min((float(((colours[p] - colours[q]) ** 2).sum()) for q in near), default=np.inf) for p in free]
        chosen[g] = free[int(np.argmax(apart))]
    return chosen.tolist()


def prune_by_group(df: DataFrame, columns: Sequence[str], least: int = 5, within: float = 0.95, across: float = 1.0, whitelist: int = 5) -> DataFrame:
    """(feature, grp, verdict): ``kept``, or ``constant`` (few non-zeros or no spread), ``within`` or ``across`` (correlated with a kept one
    of more spread in its marker group, or in another). The ``whitelist`` features of most spread in each group are always kept.

    Statistics and correlations are two aggregations over the cells; the greedy choice runs over the features alone.
    """
    value = {c: feature(F.col(f"`{c}`")) for c in columns}
    stats = [x for c, v in value.items() for x in (F.sum((v != 0).cast("long")).alias(f"n_{c}"), F.stddev_pop(v).alias(f"s_{c}"))]
    groups = [marker_group(F.lit(c)).alias(f"g_{c}") for c in columns]
    row = df.agg(*stats).select("*", *groups).first()
    spread, group = {c: row[f"s_{c}"] or 0.0 for c in columns}, {c: row[f"g_{c}"] for c in columns}
    order = sorted(columns, key=lambda c: -spread[c])
    verdict = {c: "kept" if (row[f"n_{c}"] or 0) >= least and spread[c] > 0 else "constant" for c in columns}
    alive = [c for c in order if verdict[c] == "kept"]
    pairs = [(a, b) for i, b in enumerate(alive) for a in alive[:i] if group[a] == group[b] or across < 1]
    r = df.agg(*[F.corr(value[a], value[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else ()
    close = {p: abs(x or 0.0) for p, x in zip(pairs, r, strict=True)}
    for kind, limit, same in (("within", within, True), ("across", across, False)):
        for i, c in enumerate(alive):
            others = [o for o in alive[:i] if verdict[o] == "kept" and (group[o] == group[c]) == same]
            if verdict[c] == "kept" and any(close.get((o, c), 0.0) > limit for o in others):
                verdict[c] = kind
    for g in set(group.values()):
        for c in [c for c in order if group[c] == g][:whitelist]:
            verdict[c] = "kept"
    return df.sparkSession.createDataFrame([(c, group[c], verdict[c]) for c in columns], "feature string, grp string, verdict string")


def smote_tomek(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """df and synthetic rows up to the largest label, without the members of Tomek links of labels at the then largest count."""
    return tomek_clean(written(smote(df, k, seed)))


def _rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("vec", F.array(*[F.col(c) for c in columns]))


def cohort_kmeans(cells: DataFrame, columns: Sequence[str], k: int, per_image: int = 50_000, restarts: int = 3, seed: int = 42) -> DataFrame:
    """(image, id, cluster) from 1 of every cell: standardised by the whole cohort, fitted on an even sample of images."""
    rows = _rows(standardised(cells.select("image", "id", *columns), columns), columns).select("image", "id", "vec")
    sample = even_sample(rows, "image", "id", per_image, seed).select(array_to_vector("vec").alias("features")).persist()
    try:
        models = [KMeans(k=k, seed=seed + r, predictionCol="cluster").fit(sample) for r in range(restarts)]
    finally:
        sample.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(rows.withColumn("features", array_to_vector("vec")))
    return out.select("image", "id", (F.col("cluster") + 1).alias("cluster"))


def cohort_leiden(cells: DataFrame, columns: Sequence[str], sample_size: int = 50_000, k: int = 15, transfer: int = 15, gamma: float = 0.05, seed: int = 42) -> DataFrame:
    """(id, cluster) of every cell: a graph of a bounded sample is clustered, and the other cells take the majority among their nearest sampled ones."""
    rows = _rows(standardised(cells.select("id", *columns), columns), columns).select("id", "vec")
    sample = rows.orderBy(shuffled("id", seed), "id").limit(sample_size)
    found = leiden_clusters(snn_edges(feature_knn(sample, sample, k)), gamma=gamma, restarts=1, seed=seed)
    known = sample.join(found, "id").select("id", "vec", F.col("cluster").alias("label"))
    rest = rows.join(known.select("id"), "id", "left_anti")
    return known.select("id", F.col("label").alias("cluster")).unionByName(transfer_labels(rest, known, transfer).withColumnRenamed("label", "cluster"))


def boosted(train: DataFrame, rounds: int = 20, depth: int = 4, seed: int = 42, eta: float = 0.1, subsample: float = 0.8, colsample: float = 1.0):
    """Boosted trees for each class against the rest. train: vec, y from 0. subsample: share of rows a tree; colsample: of features a split."""
    rows = train.select(array_to_vector("vec").alias("features"), F.col("y").cast("double").alias("label"))
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=eta, subsamplingRate=subsample, featureSubsetStrategy=str(colsample) if colsample < 1 else "all", seed=seed)).fit(rows)


def best_rounds(losses: Sequence[float], patience: int = 20) -> int:
    """Rounds up to the least validation loss, when none of the next ``patience`` is lower; 1 at least."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def cohort_scale(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of means and deviations of the cohort, to replay on single images."""
    return column_stats(cells, columns)
