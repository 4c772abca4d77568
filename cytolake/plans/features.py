"""Queries on class summaries, transforms and feature statistics (lineitem: class l_returnflag, four markers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import stats as S
from .registry import query, table

MARKERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = " UNION ALL ".join(f"SELECT '{m}' AS feature, CAST({m} AS DOUBLE) AS value FROM lineitem" for m in MARKERS)


@query(f"""
WITH means AS (SELECT l_returnflag AS class, {", ".join(f"avg({m}) AS {m}" for m in MARKERS)} FROM lineitem GROUP BY 1),
long AS ({" UNION ALL ".join(f"SELECT class, '{m}' AS marker, {m} AS mean FROM means" for m in MARKERS)})
SELECT class, marker, round(mean, 6) AS mean,
  round(CASE WHEN stddev_pop(mean) OVER (PARTITION BY marker) < 1e-9 THEN 0 ELSE (mean - avg(mean) OVER (PARTITION BY marker)) / stddev_pop(mean) OVER (PARTITION BY marker) END, 4) AS z
FROM long""")
def class_marker_heatmap(spark, sf_dir):
    out = S.scored_across_classes(S.class_marker_means(table(spark, sf_dir, "lineitem"), "l_returnflag", MARKERS))
    return out.select("class", "marker", F.round("mean", 6).alias("mean"), F.round("z", 4).alias("z"))


@query("""
SELECT l_orderkey, l_linenumber, round(asinh(l_quantity / 5.0), 6) AS l_quantity, round(sqrt(greatest(l_extendedprice, 0)), 6) AS l_extendedprice,
  round(l_discount, 6) AS l_discount, round(asinh(l_tax), 6) AS l_tax FROM lineitem""")
def feature_transforms(spark, sf_dir):
    cols = C.transformed(MARKERS, {"l_quantity": "arcsinh", "l_extendedprice": "sqrt", "l_tax": "arcsinh"}, {"l_quantity": 5.0})
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    return out.select("l_orderkey", "l_linenumber", *[F.round(m, 6).alias(m) for m in MARKERS])


@query(f"""
SELECT l_orderkey, l_linenumber, {", ".join(f"round((l.{m} - s.m{i}) / s.d{i}, 5) AS {m}" for i, m in enumerate(MARKERS))}
FROM lineitem l, (SELECT {", ".join(f"avg({m}) AS m{i}, stddev_pop({m}) AS d{i}" for i, m in enumerate(MARKERS))} FROM lineitem) s""")
def column_zscore(spark, sf_dir):
    out = S.standardised(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *MARKERS), MARKERS)
    return out.select("l_orderkey", "l_linenumber", *[F.round(m, 5).alias(m) for m in MARKERS])


_COFACTORS = f"""
WITH v AS ({_LONG}),
f AS (SELECT feature, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM v GROUP BY 1),
c AS (SELECT feature, p50, p99, greatest(least(p50, 1e4), 0.01) AS cofactor, p99 - p50 < 1e-9 AS dead, p50 >= 1e4 AS saturated FROM f)"""


@query(_COFACTORS + " SELECT feature, round(p50, 6) AS p50, round(p99, 6) AS p99, round(cofactor, 6) AS cofactor, dead, saturated FROM c")
def cofactor_suggestion(spark, sf_dir):
    out = S.cofactors(S.unpivot(table(spark, sf_dir, "lineitem"), MARKERS))
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("p50", "p99", "cofactor")], "dead", "saturated")


@query(_COFACTORS + " SELECT round(coalesce(median(cofactor) FILTER (WHERE NOT dead AND NOT saturated), 1.0), 6) AS cofactor FROM c")
def global_cofactor(spark, sf_dir):
    out = S.global_cofactor(S.cofactors(S.unpivot(table(spark, sf_dir, "lineitem"), MARKERS)))
    return out.select(F.round("cofactor", 6).alias("cofactor"))


@query("""
WITH t AS (SELECT log10(1 + greatest(value, 0)) AS t FROM events), m AS (SELECT max(t) AS top FROM t)
SELECT CAST(least(floor(t / top * 64), 63) AS INTEGER) AS bin, count(*) AS n FROM t, m GROUP BY 1""")
def symlog_histogram(spark, sf_dir):
    return S.histogram(table(spark, sf_dir, "events"), C.symlog(F.col("value")))


def _robust(fallback: str) -> str:
    return f"""
WITH u AS (SELECT user_id, avg(value) AS v FROM events GROUP BY 1), m AS (SELECT median(v) AS med, avg(v) AS mean, stddev_pop(v) AS sd FROM u),
d AS (SELECT median(abs(v - med)) AS mad FROM u, m)
SELECT user_id, round(CASE WHEN mad < 1e-12 THEN {fallback} ELSE 0.6745 * (v - med) / mad END, 5) AS z FROM u, m, d"""


def _per_user(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("v"))


@query(_robust("0"))
def robust_z_strict(spark, sf_dir):
    return S.with_robust_z(_per_user(spark, sf_dir), {"v": "z"}).select("user_id", F.round("z", 5).alias("z"))


@query(_robust("CASE WHEN sd < 1e-12 THEN 0 ELSE (v - mean) / sd END"))
def robust_z_fallback(spark, sf_dir):
    return S.with_robust_z(_per_user(spark, sf_dir), {"v": "z"}, fallback=True).select("user_id", F.round("z", 5).alias("z"))


@query(f"""
WITH v AS ({_LONG})
SELECT feature, count(*) FILTER (WHERE value <> 0) AS n_nonzero, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd FROM v GROUP BY 1""")
def feature_stats(spark, sf_dir):
    out = S.feature_stats(S.unpivot(table(spark, sf_dir, "lineitem"), MARKERS))
    return out.select("feature", "n_nonzero", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(MARKERS) for b in MARKERS[i + 1 :]))
def feature_correlation(spark, sf_dir):
    return S.correlations(table(spark, sf_dir, "lineitem"), MARKERS).select("a", "b", F.round("r", 6).alias("r"))


_NAMES = ["CD3: Cell: Mean", "CD8_mean", "Area", "DAPI: Nucleus: Max", "Ki67 intensity", "x"]


@query("""
SELECT name, lower(CASE WHEN instr(name, ': ') > 1 THEN split_part(name, ': ', 1) WHEN regexp_extract(name, '^([^_ ]+)[_ ]', 1) <> '' THEN regexp_extract(name, '^([^_ ]+)[_ ]', 1) ELSE name END) AS marker_group,
  regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS safe_name, name LIKE '%: Cell: Mean' AND instr(replace(name, ': Cell: Mean', ''), ':') = 0 AS is_marker
FROM (VALUES """ + ", ".join(f"('{n}')" for n in _NAMES) + ") t(name)")
def marker_groups(spark, sf_dir):
    df = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    name = F.col("name")
    marker = F.endswith(name, F.lit(": Cell: Mean")) & ~F.contains(F.replace(name, F.lit(": Cell: Mean"), F.lit("")), F.lit(":"))
    return df.select("name", C.marker_group(name).alias("marker_group"), C.safe_name(name).alias("safe_name"), marker.alias("is_marker"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity AS quantity, 0.0::DOUBLE AS absent, l_tax AS tax FROM lineitem""")
def align_features(spark, sf_dir):
    from ..operators.labels import aligned

    out = aligned(table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_quantity": " Quantity ", "l_tax": "TAX"}), ["quantity", "absent", "tax"], keep=["l_orderkey", "l_linenumber"])
    return out


@query("""
SELECT p_partkey, p_size, p_retailprice FROM part WHERE NOT (coalesce(p_size < 5, false) OR coalesce(p_size > 30, false) OR coalesce(p_retailprice > 1500, false))""")
def size_filter(spark, sf_dir):
    from ..operators.labels import range_filter

    return range_filter(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), {"p_size": (5, 30), "p_retailprice": (None, 1500)})


@query("SELECT p_partkey, p_type FROM part WHERE p_type IS NOT NULL AND contains(lower(p_type), 'eco')")
def class_filter(spark, sf_dir):
    from ..operators.labels import class_contains

    return class_contains(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", " ECO ")
