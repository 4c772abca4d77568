"""Statistics over cells: class summaries, standardisation, robust scores, cofactors.

Missing values follow the operator: means and scores skip NaN, standardised missing values are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nz


def unpivot(df: DataFrame, columns: Sequence[str], name: str = "feature", value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """One row per row and column, in one pass over the columns read."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keep), list(columns), name, value)


def class_marker_means(df: DataFrame, class_col: str, markers: Sequence[str]) -> DataFrame:
    """(class, marker, mean): pooled means, blank classes as ``Unclassified``. One aggregation with partial sums."""
    label = F.when(F.trim(F.coalesce(F.col(class_col), F.lit(""))) == "", "Unclassified").otherwise(F.col(class_col))
    wide = df.groupBy(label.alias("class")).agg(*[F.avg(nz(F.col(m).cast("double"))).alias(m) for m in markers])
    return wide.unpivot(["class"], list(markers), "marker", "mean")


def scored_across_classes(means: DataFrame) -> DataFrame:
    """z of each mean among the classes' means of its marker; 0 where fewer than two are valid or they do not vary."""
    w = Window.partitionBy("marker")
    sd, n = F.stddev_pop("mean").over(w), F.count("mean").over(w)
    z = F.when((n < 2) | (sd < 1e-9), 0.0).otherwise((F.col("mean") - F.avg("mean").over(w)) / sd)
    return means.withColumn("z", F.when(F.col("mean").isNotNull(), z))


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: population mean and deviation of every column, NaN skipped."""
    aggs = [f(nz(F.col(c).cast("double"))).alias(f"{p}_{c}") for c in columns for p, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return df.agg(*aggs)


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by z-scores; NaN and columns that do not vary become 0. The statistics are one broadcast row."""
    out = df.crossJoin(F.broadcast(column_stats(df, columns)))
    z = {c: F.when((F.col(f"sd_{c}") < 1e-9) | F.isnan(c) | F.col(c).isNull(), 0.0).otherwise((F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}")) for c in columns}
    return out.withColumns(z).drop(*[f"{p}_{c}" for c in columns for p in ("mean", "sd")])


def cofactors(values: DataFrame) -> DataFrame:
    """(feature, p50, p99, cofactor, dead, saturated) of rows (feature, value)."""
    v = nz(F.col("value"))
    g = values.groupBy("feature").agg(F.percentile(v, F.lit(0.5)).alias("p50"), F.percentile(v, F.lit(0.99)).alias("p99"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    clamp = F.greatest(F.least(F.col("p50"), F.lit(1e4)), F.lit(0.01))
    return g.select("feature", "p50", "p99", F.coalesce(clamp, F.lit(1.0)).alias("cofactor"), F.coalesce(F.col("p99") - F.col("p50") < 1e-9, F.lit(True)).alias("dead"), F.coalesce(F.col("p50") >= 1e4, F.lit(False)).alias("saturated"))


def global_cofactor(per_feature: DataFrame) -> DataFrame:
    """Median cofactor of the features that are neither dead nor saturated; 1 if there is none."""
    used = F.when(~F.col("dead") & ~F.col("saturated"), F.col("cofactor"))
    m = F.greatest(F.least(F.median(used), F.lit(1e4)), F.lit(0.01))
    return per_feature.agg(F.coalesce(m, F.lit(1.0)).alias("cofactor"))


def with_robust_z(df: DataFrame, columns: dict[str, str], by: Sequence[str] = (), fallback: bool = False) -> DataFrame:
    """Adds robust z-scores, 0.6745 (x - median) / MAD within groups, of the given columns under the given names. A
    vanishing MAD gives 0, or with ``fallback`` the plain z-score.

    The medians of all columns come from two aggregations joined back (a row per group), so no group is gathered in one
    task; only exact percentiles hold the distinct values of a group.
    """
    keys, value = list(by), {c: nz(F.col(c).cast("double")) for c in columns}
    agg = lambda d, c: d.groupBy(*keys).agg(*c) if keys else d.agg(*c)

    def back(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, keys) if keys else left.crossJoin(F.broadcast(right))

    first = [f(v).alias(f"__{n}_{c}") for c, v in value.items() for n, f in (("med", F.median), ("mean", F.avg), ("sd", F.stddev_pop))]
    centred = back(df, agg(df, first))
    both = back(centred, agg(centred, [F.median(F.abs(v - F.col(f"__med_{c}"))).alias(f"__mad_{c}") for c, v in value.items()]))
    z = {}
    for c, out in columns.items():
        v, med, mean, sd, mad = (value[c], *(F.col(f"__{n}_{c}") for n in ("med", "mean", "sd", "mad")))
        plain = F.when(sd < 1e-12, 0.0).otherwise((v - mean) / sd) if fallback else F.lit(0.0)
        z[out] = F.when(v.isNotNull(), F.when(mad < 1e-12, plain).otherwise(0.6745 * (v - med) / mad))
    return both.withColumns(z).drop(*[f"__{n}_{c}" for c in columns for n in ("med", "mean", "sd", "mad")])


def feature_stats(values: DataFrame) -> DataFrame:
    """(feature, n_nonzero, mean, sd) with NaN as 0, in one pass."""
    v = F.coalesce(nz(F.col("value")), F.lit(0.0))
    return values.groupBy("feature").agg(F.sum((v != 0).cast("long")).alias("n_nonzero"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(rows).alias("p")).select("p.*")


def histogram(df: DataFrame, value: Column, bins: int = 64) -> DataFrame:
    """(bin, n) of positive values over [0, max]."""
    rows = df.select(value.alias("t"))
    top = rows.agg(F.max("t").alias("top"))
    at = F.when(F.col("top") > 0, F.least(F.floor(F.col("t") / F.col("top") * bins), F.lit(bins - 1))).otherwise(0)
    return rows.crossJoin(F.broadcast(top)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
