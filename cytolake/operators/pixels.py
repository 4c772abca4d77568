"""Image quality from pixel tables (image, channel, x, y, v): channel statistics, thresholds, focus, cohort verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, inside
from .stats import with_robust_z

KEYS = ["image", "channel"]


def otsu(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """(image, channel, threshold): the first split that maximises the variance between background and foreground."""
    v = finite(F.col("v").cast("double"))
    rows = pixels.select(*KEYS, v.alias("v")).where("v is not null")
    lim = rows.groupBy(*KEYS).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = F.col("hi") - F.col("lo")
    at = F.greatest(F.least(F.floor((F.col("v") - F.col("lo")) * bins / span), F.lit(bins - 1)), F.lit(0))
    hist = rows.join(lim, KEYS).where(span > 0).groupBy(*KEYS, "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*KEYS)  # at most one row per bin
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("wb", F.sum("n").over(upto)).withColumn("sb", F.sum(F.col("n") * F.col("bin")).over(upto))
    hist = hist.withColumn("wt", F.sum("n").over(w)).withColumn("st", F.sum(F.col("n") * F.col("bin")).over(w))
    wf = F.col("wt") - F.col("wb")
    mb, mf = F.col("sb") / F.col("wb"), F.try_divide(F.col("st") - F.col("sb"), wf)
    between = F.when(wf > 0, F.col("wb").cast("double") * wf * (mb - mf) * (mb - mf)).otherwise(0.0)
    best = hist.groupBy(*KEYS).agg(F.max_by(F.struct("bin", "lo", "hi"), F.struct(between.alias("b"), (-F.col("bin")).alias("i"))).alias("m"))
    found = best.select(*KEYS, (F.col("m.lo") + (F.col("m.bin") + 1) / bins * (F.col("m.hi") - F.col("m.lo"))).alias("t"))
    return lim.join(found, KEYS, "left").select(*KEYS, F.coalesce("t", "lo").alias("threshold"))


def laplacian(pixels: DataFrame) -> DataFrame:
    """(image, channel, laplacian): variance of the four-neighbour Laplacian over interior finite pixels."""
    v = finite(F.col("v").cast("double")).alias("v")
    rows = pixels.select(*KEYS, "x", "y", v)
    row, col = Window.partitionBy(*KEYS, "y").orderBy("x"), Window.partitionBy(*KEYS, "x").orderBy("y")
    near = rows.withColumns({"l": F.lag("v").over(row), "r": F.lead("v").over(row)}).withColumns({"u": F.lag("v").over(col), "d": F.lead("v").over(col)})
    lap = F.col("l") + F.col("r") + F.col("u") + F.col("d") - 4 * F.col("v")
    g = near.select(*KEYS, lap.alias("k")).groupBy(*KEYS).agg(F.avg(F.col("k") * F.col("k")).alias("e2"), F.avg("k").alias("e1"))
    return g.select(*KEYS, F.greatest(F.col("e2") - F.col("e1") * F.col("e1"), F.lit(0.0)).alias("laplacian"))


def channel_stats(pixels: DataFrame, dtype_max: float) -> DataFrame:
    """Moments, percentiles, saturation and background of every channel, in one aggregation after the thresholds."""
    t = otsu(pixels)
    v = finite(F.col("v").cast("double"))
    pct = lambda p: F.percentile(v, F.lit(p))
    g = pixels.join(t, KEYS).groupBy(*KEYS).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), pct(0.5).alias("median"), F.max(v).alias("max"),
        pct(0.01).alias("p1"), pct(0.99).alias("p99"), F.avg((v >= 0.999 * dtype_max).cast("double")).alias("saturation"), F.avg((v < F.col("threshold")).cast("double")).alias("background"), F.first("threshold").alias("threshold"),
    )
    return g.withColumn("foreground", 1 - F.col("background")).withColumn("dynamic", F.col("p99") - F.col("p1"))


def empty_fraction(pixels: DataFrame) -> DataFrame:
    """(image, empty): share of pixels that lie below the threshold in every channel."""
    lit = F.coalesce(F.col("v").cast("double") >= F.col("threshold"), F.lit(False)) & ~F.isnan(F.col("v").cast("double"))
    by = pixels.join(otsu(pixels), KEYS).groupBy("image", "x", "y").agg(F.max(lit).alias("lit"))
    return by.groupBy("image").agg(F.avg((~F.col("lit")).cast("double")).alias("empty"))


def pixel_cohort(stats: DataFrame, empty: DataFrame) -> DataFrame:
    """Verdicts per image from robust scores of five scalars: foreground, emptiness, saturation, dynamics, intensity."""
    scalars = stats.groupBy("image").agg(F.avg("foreground").alias("fg"), F.median("dynamic").alias("dyn"), F.max("saturation").alias("sat")).join(empty, "image")
    used = stats.groupBy("channel").agg((F.median("foreground") >= 0.05).alias("used"))
    inten = with_robust_z(stats.join(F.broadcast(used), "channel").where("used"), {"median": "zi"}, ["channel"], fallback=True).groupBy("image").agg(F.max(F.abs("zi")).alias("z_int"))
    out = with_robust_z(scalars, {c: f"z_{c}" for c in ("fg", "empty", "sat", "dyn")}, fallback=True)
    out = out.join(inten, "image", "left").withColumn("z_int", F.coalesce("z_int", F.lit(0.0)))
    background = (F.col("z_empty") >= 2.5) | (F.col("z_fg") <= -2.5)
    saturated = (F.col("sat") >= 0.05) | (F.col("sat") >= 0.01) & (F.col("z_sat") >= 3.0)
    weak, odd = F.col("z_dyn") <= -2.5, F.col("z_int") >= 2.5
    relu = lambda c: F.greatest(c, F.lit(0.0))
    score = relu(F.col("z_empty")) + relu(-F.col("z_fg")) + F.when(saturated, relu(F.col("z_sat"))).otherwise(0.0) + relu(-F.col("z_dyn")) + relu(F.col("z_int") - 2)
    flags = F.concat_ws(";", F.when(background, "BACKGROUND_HEAVY"), F.when(saturated, "SATURATED"), F.when(weak, "WEAK_SIGNAL"), F.when(odd, "INTENSITY_OUTLIER"))
    verdict = F.when(background, "Background-heavy").when(saturated, "Saturated").when(weak, "Weak signal").when(odd, "Intensity outlier").otherwise("OK")
    return out.select("image", "fg", "empty", "sat", "dyn", "z_int", score.alias("score"), flags.alias("flags"), verdict.alias("verdict"))


def reading(width: Column, height: Column, bits: Column, floating: Column, longest: int = 2048) -> tuple[Column, Column]:
    """(downsample, largest value) to read an image whole: its longer edge has at most ``longest`` pixels; floats have no largest value."""
    down = F.greatest(F.lit(1.0), F.greatest(width, height) / longest)
    return down, F.when(floating, float("nan")).otherwise(F.pow(F.lit(2.0), bits) - 1)


def masked(pixels: DataFrame, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """pixels (x, y, v, ...) with v 0 where a pixel's centre lies outside the polygon."""
    within = inside(F.col("x") + 0.5, F.col("y") + 0.5, polygon)
    return pixels.withColumn("v", F.when(within, F.col("v")).otherwise(F.lit(0).cast(pixels.schema["v"].dataType)))
