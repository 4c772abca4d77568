"""Queries on predictions, labels and cohorts (events: image user_id % 25, class event_type, a second model that differs
where event_id % 7 = 0)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cohort as H
from ..operators import labels as L
from .registry import query, table

#: The classes of the predictions, in order.
CLASSES = ["click", "error", "purchase", "signup", "view"]
_LIST = "['" + "','".join(CLASSES) + "']"
_PRED = f"""
WITH pred AS (SELECT event_id, user_id % 25 AS image, event_type AS m1,
  CASE WHEN event_id % 7 = 0 THEN {_LIST}[1 + list_position({_LIST}, event_type) % 5] ELSE event_type END AS m2 FROM events)"""


def predictions(spark, sf_dir):
    classes = F.array(*[F.lit(c) for c in CLASSES])
    turned = F.element_at(classes, (F.array_position(classes, F.col("event_type")) % 5 + 1).cast("int"))
    m2 = F.when(F.col("event_id") % 7 == 0, turned).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("image"), F.col("event_type").alias("m1"), m2.alias("m2"))


_P1 = "[((event_id * 3 + i) % 11) / 11.0 FOR i IN [0,1,2,3,4]]"
_P2 = "[((event_id * 5 + i * 2) % 13) / 13.0 FOR i IN [0,1,2,3,4]]"


@query(_PRED + f"""
, p AS (SELECT event_id, m1, m2, {_P1} AS p1, {_P2} AS p2 FROM pred), a AS (SELECT *, [(p1[i] + p2[i]) / 2 FOR i IN [1,2,3,4,5]] AS avg FROM p)
SELECT event_id, {_LIST}[list_position(avg, list_max(avg))] AS avg_label, CASE WHEN m1 = m2 THEN m1 ELSE m1 || '/' || m2 END AS all_label,
  m1 <> m2 AS disagree, round(p1[list_position({_LIST}, m1)], 6) AS conf1, round(p2[list_position({_LIST}, m2)], 6) AS conf2 FROM a""")
def prediction_labels(spark, sf_dir):
    df, classes = predictions(spark, sf_dir), F.array(*[F.lit(c) for c in CLASSES])
    p1 = F.array(*[((F.col("event_id") * 3 + i) % 11) / F.lit(11.0) for i in range(5)])
    p2 = F.array(*[((F.col("event_id") * 5 + i * 2) % 13) / F.lit(13.0) for i in range(5)])
    df = df.withColumns({"p1": p1, "p2": p2})
    return df.select(
        "event_id", C.average_label(F.col("p1"), F.col("p2"), classes).alias("avg_label"), C.all_label(F.col("m1"), F.col("m2")).alias("all_label"), (F.col("m1") != F.col("m2")).alias("disagree"),
        F.round(C.confidence(F.col("m1"), F.col("p1"), classes), 6).alias("conf1"), F.round(C.confidence(F.col("m2"), F.col("p2"), classes), 6).alias("conf2"),
    )


@query(_PRED + " SELECT 'm1' AS population, m1 AS class, count(*) AS n FROM pred GROUP BY 2 UNION ALL SELECT 'm2', m2, count(*) FROM pred GROUP BY 2")
def population_counts(spark, sf_dir):
    return L.population_counts(predictions(spark, sf_dir), ["m1", "m2"])


@query(_PRED + " SELECT m1 AS a, m2 AS b, count(*) AS n FROM pred GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return L.confusion(predictions(spark, sf_dir), "m1", "m2")


@query(_PRED + f"""
, c AS (SELECT unnest({_LIST}) AS class), g AS (SELECT class, count(*) FILTER (WHERE m1 = class AND m2 = class) AS tp, count(*) FILTER (WHERE m1 = class) AS row, count(*) FILTER (WHERE m2 = class) AS col FROM pred, c GROUP BY 1)
SELECT class, tp, row, col, round(tp / (row + col - tp), 6) AS agreement, round(2 * tp / (row + col), 6) AS dice FROM g WHERE row + col > 0""")
def agreement_rates(spark, sf_dir):
    out = L.agreement(predictions(spark, sf_dir), "m1", "m2")
    return out.select("class", "tp", "row", "col", F.round("agreement", 6).alias("agreement"), F.round("dice", 6).alias("dice"))


_METRICS = """
WITH c AS (SELECT unnest([0, 1, 2]) AS class), g AS (SELECT class, count(*) FILTER (WHERE quality = class AND toxic = class) AS tp, count(*) FILTER (WHERE quality = class) AS support, count(*) FILTER (WHERE toxic = class) AS given FROM labels, c GROUP BY 1),
r AS (SELECT class, support, tp, CASE WHEN given > 0 THEN tp / given ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM g),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"""


@query(_METRICS + " SELECT CAST(class AS BIGINT) AS class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def class_metrics(spark, sf_dir):
    out = L.class_metrics(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1, 2])
    return out.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(_METRICS + " SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(f1) FILTER (WHERE support > 0), 6) AS cv_macro_f1 FROM m")
def cv_macro_f1(spark, sf_dir):
    out = L.overall_metrics(L.class_metrics(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1, 2]))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_COUNTS = _PRED + """
, cnt AS (SELECT image, m1 AS class, count(*) AS n FROM pred GROUP BY 1, 2), tot AS (SELECT class, sum(n) AS cn FROM cnt GROUP BY 1),
k AS (SELECT count(*) AS k, sum(cn) AS total FROM tot), sz AS (SELECT image, sum(n) AS size FROM cnt GROUP BY 1),
f AS (SELECT sz.image, tot.class, CAST(coalesce(n, 0) AS BIGINT) AS n, (coalesce(n, 0) + 1.0) / (size + k) AS p, (cn + 1.0) / (total + k) AS q FROM sz CROSS JOIN tot CROSS JOIN k LEFT JOIN cnt ON cnt.image = sz.image AND cnt.class = tot.class),
js AS (SELECT image, sqrt(greatest(0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))), 0)) AS js FROM f GROUP BY 1)"""


def _counts(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("image", F.col("m1").alias("class")).agg(F.count("*").alias("n"))


@query(_COUNTS + " SELECT image, class, n, round(p, 6) AS p, round(q, 6) AS q FROM f")
def cohort_baseline(spark, sf_dir):
    return H.class_fractions(_counts(spark, sf_dir)).select("image", "class", "n", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query(_COUNTS + " SELECT image, round(js, 6) AS js FROM js")
def js_distance(spark, sf_dir):
    return H.js_distance(H.class_fractions(_counts(spark, sf_dir))).select("image", F.round("js", 6).alias("js"))


@query(_COUNTS + " SELECT image, class, round(p / q, 6) AS fold, q <= 0.2 AS rare, q <= 0.2 AND n >= 5 AND p / q >= 1.1 AS highlighted FROM f")
def rare_enrichment(spark, sf_dir):
    return H.enrichment(H.class_fractions(_counts(spark, sf_dir)), rare=0.2, least=5, fold=1.1).select("image", "class", F.round("fold", 6).alias("fold"), "rare", "highlighted")


@query(_COUNTS + """
, im AS (SELECT image, count(*) AS predicted, count(*) FILTER (WHERE m1 <> m2) AS d FROM pred GROUP BY 1), b AS (SELECT im.image, js, d / predicted AS rate FROM im JOIN js USING (image)),
m AS (SELECT median(js) AS mj, median(rate) AS mr FROM b), mad AS (SELECT median(abs(js - mj)) AS dj, median(abs(rate - mr)) AS dr FROM b, m),
z AS (SELECT image, js, rate, CASE WHEN dj < 1e-12 THEN 0 ELSE 0.6745 * (js - mj) / dj END AS zc, CASE WHEN dr < 1e-12 THEN 0 ELSE 0.6745 * (rate - mr) / dr END AS zr FROM b, m, mad),
e AS (SELECT image, max(CAST(q <= 0.01 AND n >= 20 AND p / q >= 3 AS INTEGER)) AS enriched FROM f GROUP BY 1)
SELECT image, round(rate, 6) AS rate, round(zc, 4) AS z_class, round(zr, 4) AS z_rate, round(0.65 * greatest(zc, 0) + 0.35 * greatest(zr, 0), 4) AS score,
  concat_ws(';', CASE WHEN zc >= 3 THEN 'CLASS_SHIFT' END, CASE WHEN zr >= 3 THEN 'DISAGREEMENT' END, CASE WHEN enriched = 1 THEN 'RARE_ENRICHMENT' END) AS reasons FROM z JOIN e USING (image)""")
def cohort_anomaly(spark, sf_dir):
    images = predictions(spark, sf_dir).groupBy("image").agg(F.count("*").alias("predicted"), F.sum((F.col("m1") != F.col("m2")).cast("long")).alias("disagreements"))
    out = H.anomaly_report(_counts(spark, sf_dir), images)
    return out.select("image", F.round("rate", 6).alias("rate"), *[F.round(c, 4).alias(c) for c in ("z_class", "z_rate", "score")], "reasons")


@query(_PRED + """
, c AS (SELECT image, m1, count(*) AS n, count(*) FILTER (WHERE m1 <> m2) AS d FROM pred GROUP BY 1, 2), g AS (SELECT image, sum(n) AS predicted, sum(d) AS disagreements, string_agg(m1 || ': ' || n, ', ' ORDER BY m1, n) AS classes FROM c GROUP BY 1), i AS (SELECT range AS image FROM range(26))
SELECT image, CAST(coalesce(predicted, 0) AS BIGINT) AS predicted, CAST(coalesce(disagreements, 0) AS BIGINT) AS disagreements, round(coalesce(disagreements / predicted, 0), 6) AS rate, coalesce(classes, '') AS classes FROM i LEFT JOIN g USING (image)""")
def prediction_summary(spark, sf_dir):
    out = L.prediction_summary(spark.range(26).withColumnRenamed("id", "image"), predictions(spark, sf_dir))
    return out.select("image", "predicted", "disagreements", F.round("rate", 6).alias("rate"), "classes")


_RAW = """
WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T-mergedInto(B)' WHEN 1 THEN 'T' WHEN 2 THEN 'B' ELSE 'a-mergedInto(b-mergedInto(c))' END AS raw FROM labels),
e AS (SELECT doc_id, raw, CASE WHEN instr(raw, '-mergedInto(') > 0 AND raw LIKE '%)' THEN substr(raw, instr(raw, '-mergedInto(') + 12, length(raw) - instr(raw, '-mergedInto(') - 12) ELSE raw END AS effective, split_part(raw, '-mergedInto(', 1) AS original FROM r)"""


def _raw(spark, sf_dir):
    k = F.col("doc_id") % 4
    return table(spark, sf_dir, "labels").select("doc_id", F.when(k == 0, "T-mergedInto(B)").when(k == 1, "T").when(k == 2, "B").otherwise("a-mergedInto(b-mergedInto(c))").alias("raw"))


@query(_RAW + " SELECT doc_id, effective, original FROM e")
def effective_class(spark, sf_dir):
    return _raw(spark, sf_dir).select("doc_id", C.effective_class(F.col("raw")).alias("effective"), C.original_class(F.col("raw")).alias("original"))


@query(_RAW + """
, m AS (SELECT doc_id, raw, CASE WHEN effective IN ('T', 'B') AND effective <> 'L' THEN original || '-mergedInto(L)' ELSE raw END AS merged FROM e)
SELECT doc_id, merged, CASE WHEN merged LIKE '%-mergedInto(L)' THEN split_part(merged, '-mergedInto(', 1) ELSE merged END AS undone, CASE WHEN effective = 'B' THEN 'Bcell' ELSE raw END AS renamed FROM m JOIN e USING (doc_id, raw)""")
def merge_undo(spark, sf_dir):
    df = _raw(spark, sf_dir).withColumn("merged", C.merged_label(F.col("raw"), ["T", "B"], "L"))
    return df.select("doc_id", "merged", C.unmerged_label(F.col("merged"), "L").alias("undone"), C.renamed_label(F.col("raw"), "B", "Bcell").alias("renamed"))


_MASKS = "l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 0.9 ELSE 0.1 END AS CD3, CASE WHEN l_discount > 0.05 THEN 0.8 ELSE 0.2 END AS CD8, CASE WHEN l_tax > 0.04 THEN 0.7 END AS CD4"


def _markers(spark, sf_dir):
    q = F.when(F.col("l_quantity") > 25, 0.9).otherwise(0.1)
    d = F.when(F.col("l_discount") > 0.05, 0.8).otherwise(0.2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("CD3"), d.alias("CD8"), F.when(F.col("l_tax") > 0.04, 0.7).alias("CD4"))


@query(f"""
WITH m AS (SELECT {_MASKS} FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws(':', CASE WHEN CD3 >= 0.5 THEN 'CD3+' ELSE 'CD3-' END, CASE WHEN CD4 >= 0.5 THEN 'CD4+' WHEN CD4 < 0.5 THEN 'CD4-' END, CASE WHEN CD8 >= 0.5 THEN 'CD8+' ELSE 'CD8-' END) AS class FROM m""")
def composite_class(spark, sf_dir):
    return L.composite(_markers(spark, sf_dir), ["CD8", "CD3", "CD4"]).select("l_orderkey", "l_linenumber", "class")


@query(f"WITH m AS (SELECT {_MASKS} FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN CD3 >= 0.5 AND NOT CD8 >= 0.5 THEN 'CD3+:CD8-' END AS class FROM m")
def composite_rule(spark, sf_dir):
    return _markers(spark, sf_dir).select("l_orderkey", "l_linenumber", F.when(L.rule_mask("CD3+:CD8-"), "CD3+:CD8-").alias("class"))


@query("SELECT event_id, image, source FROM (SELECT event_id, user_id % 25 AS image, 'stored' AS source FROM events WHERE user_id % 25 <> 3 UNION ALL SELECT event_id + 1000000, 3, 'live' FROM events WHERE user_id % 25 = 3)")
def label_overlay(spark, sf_dir):
    stored = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("image"), F.lit("stored").alias("source"))
    live = stored.where("image = 3").select((F.col("event_id") + 1000000).alias("event_id"), "image", F.lit("live").alias("source"))
    return L.overlay(stored, live, ["image"])


@query("SELECT e.event_id, CAST(CASE WHEN e.event_id % 3 = 0 THEN e.user_id % 5 + 1 ELSE -1 END AS INTEGER) AS cluster FROM events e")
def writeback_join(spark, sf_dir):
    cells = table(spark, sf_dir, "events").select("event_id", "user_id")
    labels = cells.where("event_id % 3 = 0").select("event_id", (F.col("user_id") % 5).alias("label"))
    return L.write_back(cells.select("event_id"), labels, "event_id", "label", "cluster")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def pool_dedupe(spark, sf_dir):
    out = L.first_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", [F.col("event_id")])
    return out.select("user_id", "event_id", "event_type")
