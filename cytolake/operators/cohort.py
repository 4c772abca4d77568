"""Cohort anomaly: how far each image's class mix and model disagreement stray from the cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import with_robust_z


def class_fractions(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(image, class, n, p, q): smoothed fractions of an image and of the cohort, for every image and class."""
    total = counts.groupBy("class").agg(F.sum("n").alias("cn"))
    k = total.agg(F.count("*").alias("k"), F.sum("cn").alias("all"))
    sizes = counts.groupBy("image").agg(F.sum("n").alias("size"))
    # the grid of images and classes is images times the few classes, which are one broadcast table
    grid = sizes.crossJoin(F.broadcast(total.crossJoin(F.broadcast(k)))).join(counts, ["image", "class"], "left")
    n = F.coalesce("n", F.lit(0))
    p = (n + alpha) / (F.col("size") + alpha * F.col("k"))
    q = (F.col("cn") + alpha) / (F.col("all") + alpha * F.col("k"))
    return grid.select("image", "class", n.cast("long").alias("n"), p.alias("p"), q.alias("q"))


def js_distance(fractions: DataFrame) -> DataFrame:
    """(image, js): Jensen-Shannon distance of an image from the cohort, natural log."""
    m = (F.col("p") + F.col("q")) / 2
    d = 0.5 * F.sum(F.col("p") * F.log(F.col("p") / m)) + 0.5 * F.sum(F.col("q") * F.log(F.col("q") / m))
    return fractions.groupBy("image").agg(F.sqrt(F.greatest(d, F.lit(0.0))).alias("js"))


def enrichment(fractions: DataFrame, rare: float = 0.01, least: int = 20, fold: float = 3.0) -> DataFrame:
    out = fractions.withColumn("fold", F.col("p") / F.col("q")).withColumn("rare", F.col("q") <= rare)
    return out.withColumn("highlighted", F.col("rare") & (F.col("n") >= least) & (F.col("fold") >= fold))


def anomaly_report(counts: DataFrame, images: DataFrame, z_flag: float = 3.0, weights: tuple[float, float] = (0.65, 0.35), **rare) -> DataFrame:
    """Per image: distance, disagreement rate, robust scores, combined score and reasons. images: image, predicted, disagreements."""
    f = class_fractions(counts)
    shown = enrichment(f, **rare).groupBy("image").agg(F.max("highlighted").alias("enriched"))
    rate = F.when(F.col("predicted") > 0, F.least(F.greatest(F.col("disagreements") / F.col("predicted"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    both = images.withColumn("rate", rate).join(js_distance(f), "image").join(shown, "image")
    scored = with_robust_z(both, {"js": "z_class", "rate": "z_rate"})
    score = weights[0] * F.greatest(F.col("z_class"), F.lit(0.0)) + weights[1] * F.greatest(F.col("z_rate"), F.lit(0.0))
    reasons = F.concat_ws(";", F.when(F.col("z_class") >= z_flag, "CLASS_SHIFT"), F.when(F.col("z_rate") >= z_flag, "DISAGREEMENT"), F.when(F.col("enriched"), "RARE_ENRICHMENT"))
    return scored.select("image", "js", "rate", "z_class", "z_rate", score.alias("score"), reasons.alias("reasons"))
