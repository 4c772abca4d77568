"""Queries on pixel tables (events: image user_id % 25, channel event_type, value; a 40-wide grid by order of event_id)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pixels as P
from .registry import query, table

_PIX = """
WITH px AS (SELECT user_id % 25 AS image, event_type AS channel, value AS v, row_number() OVER (PARTITION BY user_id % 25, event_type ORDER BY event_id) - 1 AS i FROM events),
pixels AS (SELECT image, channel, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, v FROM px)"""
_OTSU = _PIX + """
, lim AS (SELECT image, channel, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY 1, 2),
h AS (SELECT p.image, p.channel, lo, hi, greatest(least(floor((v - lo) * 256 / (hi - lo)), 255), 0) AS bin, count(*) AS n FROM pixels p JOIN lim USING (image, channel) WHERE hi > lo GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT *, sum(n) OVER w AS wb, sum(n * bin) OVER w AS sb, sum(n) OVER g AS wt, sum(n * bin) OVER g AS st FROM h WINDOW w AS (PARTITION BY image, channel ORDER BY bin ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY image, channel)),
b AS (SELECT *, CASE WHEN wt > wb THEN CAST(wb AS DOUBLE) * (wt - wb) * power(sb / wb - (st - sb) / (wt - wb), 2) ELSE 0 END AS between_var FROM c),
best AS (SELECT *, row_number() OVER (PARTITION BY image, channel ORDER BY between_var DESC, bin) AS r FROM b),
otsu AS (SELECT lim.image, lim.channel, coalesce(best.lo + (bin + 1) / 256 * (best.hi - best.lo), lim.lo) AS threshold FROM lim LEFT JOIN best ON best.image = lim.image AND best.channel = lim.channel AND r = 1)"""
_STATS = _OTSU + """
, st AS (SELECT image, channel, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS min, quantile_cont(v, 0.5) AS median, max(v) AS max, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99, avg(CAST(v >= 0.999 * 255 AS INTEGER)) AS saturation, avg(CAST(v < threshold AS INTEGER)) AS background, min(threshold) AS threshold FROM pixels JOIN otsu USING (image, channel) GROUP BY 1, 2)"""
_EMPTY = """
, lit AS (SELECT image, x, y, max(CAST(v >= threshold AS INTEGER)) AS lit FROM pixels JOIN otsu USING (image, channel) GROUP BY 1, 2, 3), empty AS (SELECT image, avg(1 - lit) AS empty FROM lit GROUP BY 1)"""


def pixels(spark, sf_dir):
    image = (F.col("user_id") % 25).alias("image")
    w = Window.partitionBy("image", "channel").orderBy("event_id")
    df = table(spark, sf_dir, "events").select(image, F.col("event_type").alias("channel"), F.col("value").alias("v"), "event_id").withColumn("i", F.row_number().over(w) - 1)
    return df.select("image", "channel", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "v")


@query(_OTSU + " SELECT image, channel, round(threshold + 1e-9, 6) AS threshold FROM otsu")
def otsu_threshold(spark, sf_dir):
    return P.otsu(pixels(spark, sf_dir)).select("image", "channel", F.round(F.col("threshold") + 1e-9, 6).alias("threshold"))


@query(_STATS + " SELECT image, channel, n, " + ", ".join(f"round({c} + 1e-9, 5) AS {c}" for c in "mean sd min median max p1 p99 saturation background threshold".split()) + ", round(1 - background + 1e-9, 5) AS foreground, round(p99 - p1 + 1e-9, 5) AS dynamic FROM st")
def channel_stats(spark, sf_dir):
    out = P.channel_stats(pixels(spark, sf_dir), 255.0)
    return out.select("image", "channel", "n", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in "mean sd min median max p1 p99 saturation background threshold foreground dynamic".split()])


@query(_OTSU + _EMPTY + " SELECT image, round(empty, 6) AS empty FROM empty")
def empty_fraction(spark, sf_dir):
    return P.empty_fraction(pixels(spark, sf_dir)).select("image", F.round("empty", 6).alias("empty"))


@query(_PIX + """
, nb AS (SELECT image, channel, lag(v) OVER r + lead(v) OVER r + lag(v) OVER c + lead(v) OVER c - 4 * v AS k FROM pixels WINDOW r AS (PARTITION BY image, channel, y ORDER BY x), c AS (PARTITION BY image, channel, x ORDER BY y))
SELECT image, channel, round(greatest(avg(k * k) - avg(k) * avg(k), 0), 3) AS laplacian FROM nb GROUP BY 1, 2""")
def laplacian_variance(spark, sf_dir):
    return P.laplacian(pixels(spark, sf_dir)).select("image", "channel", F.round("laplacian", 3).alias("laplacian"))


def _z(c: str, t: str) -> str:
    return f"CASE WHEN mad_{c} < 1e-12 THEN CASE WHEN sd_{c} < 1e-12 THEN 0 ELSE ({c} - mean_{c}) / sd_{c} END ELSE 0.6745 * ({c} - med_{c}) / mad_{c} END"


_SC = ("fg", "empty", "sat", "dyn")


@query(_STATS + _EMPTY + f"""
, sc AS (SELECT image, avg(1 - background) AS fg, median(p99 - p1) AS dyn, max(saturation) AS sat FROM st GROUP BY 1), s AS (SELECT * FROM sc JOIN empty USING (image)),
md AS (SELECT {", ".join(f"median({c}) AS med_{c}, avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}" for c in _SC)} FROM s),
mm AS (SELECT {", ".join(f"median(abs({c} - med_{c})) AS mad_{c}" for c in _SC)} FROM s, md),
us AS (SELECT channel FROM st GROUP BY 1 HAVING median(1 - background) >= 0.05), ic AS (SELECT channel, median(median) AS med, avg(median) AS mean, stddev_pop(median) AS sd FROM st GROUP BY 1),
im AS (SELECT channel, median(abs(st.median - ic.med)) AS mad FROM st JOIN ic USING (channel) GROUP BY 1),
zi AS (SELECT image, max(abs(CASE WHEN mad < 1e-12 THEN CASE WHEN ic.sd < 1e-12 THEN 0 ELSE (st.median - ic.mean) / ic.sd END ELSE 0.6745 * (st.median - ic.med) / mad END)) AS z_int FROM st JOIN ic USING (channel) JOIN im USING (channel) JOIN us USING (channel) GROUP BY 1),
z AS (SELECT image, fg, empty, sat, dyn, {", ".join(f"{_z(c, '')} AS z_{c}" for c in _SC)} FROM s, md, mm), a AS (SELECT z.*, coalesce(z_int, 0) AS z_int FROM z LEFT JOIN zi USING (image)),
fl AS (SELECT *, z_empty >= 2.5 OR z_fg <= -2.5 AS bg, sat >= 0.05 OR (sat >= 0.01 AND z_sat >= 3) AS st_, z_dyn <= -2.5 AS wk, z_int >= 2.5 AS od FROM a)
SELECT image, round(fg, 5) AS fg, round(empty, 5) AS empty, round(sat, 5) AS sat, round(dyn, 4) AS dyn, round(z_int, 4) AS z_int,
  round(greatest(z_empty, 0) + greatest(-z_fg, 0) + CASE WHEN st_ THEN greatest(z_sat, 0) ELSE 0 END + greatest(-z_dyn, 0) + greatest(z_int - 2, 0), 4) AS score,
  concat_ws(';', CASE WHEN bg THEN 'BACKGROUND_HEAVY' END, CASE WHEN st_ THEN 'SATURATED' END, CASE WHEN wk THEN 'WEAK_SIGNAL' END, CASE WHEN od THEN 'INTENSITY_OUTLIER' END) AS flags,
  CASE WHEN bg THEN 'Background-heavy' WHEN st_ THEN 'Saturated' WHEN wk THEN 'Weak signal' WHEN od THEN 'Intensity outlier' ELSE 'OK' END AS verdict FROM fl""")
def pixel_cohort(spark, sf_dir):
    px = pixels(spark, sf_dir)
    out = P.pixel_cohort(P.channel_stats(px, 255.0), P.empty_fraction(px))
    return out.select("image", *[F.round(c, 5).alias(c) for c in ("fg", "empty", "sat")], *[F.round(c, 4).alias(c) for c in ("dyn", "z_int", "score")], "flags", "verdict")


@query(_STATS + " SELECT image, " + ", ".join(f"round(max(CASE WHEN channel = '{c}' THEN median END), 5) AS {c}_median, round(max(CASE WHEN channel = '{c}' THEN saturation END), 5) AS {c}_saturation" for c in ["click", "error", "purchase", "signup", "view"]) + " FROM st GROUP BY 1")
def pixel_csv_wide(spark, sf_dir):
    stats = P.channel_stats(pixels(spark, sf_dir), 255.0)
    return stats.groupBy("image").pivot("channel", ["click", "error", "purchase", "signup", "view"]).agg(F.round(F.max("median"), 5).alias("median"), F.round(F.max("saturation"), 5).alias("saturation"))


@query(_PIX + " SELECT image, channel, x, y, CASE WHEN 41 * (x + 0.5) + 8 * (y + 0.5) < 328 THEN v ELSE 0 END AS v FROM pixels")
def masked_pixels(spark, sf_dir):
    return P.masked(pixels(spark, sf_dir), [(0.0, 0.0), (8.0, 0.0), (0.0, 41.0)])


@query("SELECT p_partkey, round(greatest(1, greatest(p_partkey * 7, p_size * 200) / 2048), 9) AS downsample, CASE WHEN p_size % 3 = 0 THEN NULL ELSE power(2, 8 + p_size % 3) - 1 END AS largest FROM part")
def image_reading(spark, sf_dir):
    down, most = P.reading(F.col("p_partkey") * 7, F.col("p_size") * 200, 8 + F.col("p_size") % 3, F.col("p_size") % 3 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(down, 9).alias("downsample"), F.nanvl(most, F.lit(None).cast("double")).alias("largest"))
