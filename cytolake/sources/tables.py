"""Files in and out: ground truth, cell tables, marker tables, summaries, GeoJSON, predictions."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import feature


def _header(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).limit(1).collect()
    if not rows:
        raise ValueError("no header")
    return next(csv.reader([rows[0][0]]))


#: The columns before the features of a ground-truth file, by its first column.
LAYOUTS = {"image": 4, "label": 1}


def ground_truth_features(spark: SparkSession, path: str) -> list[str]:
    head = _header(spark, path)
    kind = head[0].strip().lower()
    if kind in LAYOUTS:
        return head[LAYOUTS[kind] :]
    if "label" in [h.strip().lower() for h in head]:
        return [h for h in head if h.strip().lower() not in ("image", "label", "centroidx", "centroidy")]
    raise ValueError("no Label column")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """label and features of a ground-truth CSV: comments and rows without label go, what is not a number is 0."""
    features = ground_truth_features(spark, path)
    df = spark.read.csv(path, header=False, comment="#", schema=T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(_header(spark, path)))]))
    head = _header(spark, path)
    at = {h: i for i, h in reversed(list(enumerate(head)))}
    label = next(i for i, h in enumerate(head) if h.strip().lower() == "label")
    rows = df.where(F.coalesce(F.trim(F.col(f"c{label}")), F.lit("")) != "").where(F.col(f"c{label}") != head[label])
    number = lambda c: feature(F.col(c).try_cast("double"))
    return rows.select(F.col(f"c{label}").alias("label"), *[number(f"c{at[f]}").alias(f) for f in features])


def ground_truth_rows(cells: DataFrame, labels: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """Image, Label, CentroidX, CentroidY and features of the labelled cells."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    return cells.join(labels.select("image", "id", "label"), ["image", "id"]).select(F.col("image").alias("Image"), F.col("label").alias("Label"), two("x").alias("CentroidX"), two("y").alias("CentroidY"), *[feature(F.col(f)).alias(f) for f in features])


def with_imported(rows: DataFrame, imported: DataFrame, features: Sequence[str]) -> DataFrame:
    """Export rows and imported training rows, whose missing features are 0."""
    cols = [F.lit("imported").alias("Image"), F.col("label").alias("Label"), F.lit("0.00").alias("CentroidX"), F.lit("0.00").alias("CentroidY")]
    cols += [(F.col(f) if f in imported.columns else F.lit(0.0)).alias(f) for f in features]
    return rows.unionByName(imported.select(*cols))


def cell_table(cells: DataFrame, measures: Sequence[str], pixel: float | None = None, meta: Sequence[str] = ()) -> DataFrame:
    """Cell export: id, class, centroid and measures with two decimals; what is missing is ``NA``."""
    scale = pixel or 1.0
    text = lambda c: F.coalesce(F.when(~F.isnan(c), F.format_string("%.2f", c)), F.lit("NA"))
    out = [F.col("image").alias("Image"), F.col("id").cast("string").alias("ObjectID"), F.coalesce("type", F.lit("")).alias("Class"), text(F.col("x") * scale).alias("CentroidX"), text(F.col("y") * scale).alias("CentroidY")]
    for m in [*measures, *meta]:
        kind = dict(cells.dtypes).get(m)
        out.append((F.lit("NA") if kind is None else F.coalesce(F.col(m), F.lit("NA")) if kind == "string" else text(F.col(m).cast("double"))).alias(m))
    return cells.select(*out)


def write_by_image(table: DataFrame, path: str) -> None:
    """One folder of CSV per image, names made safe."""
    safe = F.regexp_replace(F.col("Image").cast("string"), "[^A-Za-z0-9._-]", "_")
    table.withColumn("file", safe).write.partitionBy("file").mode("overwrite").csv(path, header=True)


#: The default columns of a cell export.
DEFAULT_COLUMNS = re.compile(r"^[^:]+: Cell: Mean$")


def default_columns(columns: Sequence[str]) -> list[str]:
    found = [c for c in columns if DEFAULT_COLUMNS.match(c) or "distance" in c.lower()]
    return found or list(columns)


def read_marker_table(spark: SparkSession, path: str, most: int = 5) -> DataFrame:
    """(cell_type, markers) or (cell_type, primary, secondary, tertiary), by the header; a later row of a type wins."""
    head = [h.strip().lower() for h in _header(spark, path)]
    df = spark.read.csv(path, header=True, comment="#").toDF(*[f"c{i}" for i in range(len(head))])
    df = df.withColumn("seq", F.monotonically_increasing_id()).where(F.trim("c0") != "")
    rules = any("primarymarker" in h.replace("_", "").replace(" ", "") for h in head)
    if rules:
        value = F.struct(*[(F.trim(F.col(f"c{i}")) if i < len(head) else F.lit(None).cast("string")).alias(n) for i, n in enumerate(("primary", "secondary", "tertiary"), 1)])
    else:
        marks = F.filter(F.array(*[F.trim(F.col(f"c{i}")) for i in range(1, min(len(head), most + 1))]), lambda m: m.isNotNull() & (m != ""))
        value = F.struct(marks.alias("markers"))
    return df.groupBy(F.trim("c0").alias("cell_type")).agg(F.max_by(value, "seq").alias("v")).select("cell_type", "v.*")


def valid_predictions(df: DataFrame) -> DataFrame:
    """Rows whose fields are set and whose probabilities match the classes."""
    some = F.col("id").isNotNull() & F.col("m1").isNotNull() & F.col("m2").isNotNull()
    return df.where(some & (F.size("p1") == F.size("classes")) & (F.size("p2") == F.size("classes")))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, poly) of the polygons of a FeatureCollection or a bare array (plain or gzip); bad features are skipped."""
    shape = "geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<name: string, classification: struct<name: string>>"
    text = spark.read.text(path, wholetext=True)
    array = F.coalesce(F.get_json_object("value", "$.features"), F.col("value"))
    items = text.select(F.explode(F.from_json(array, "array<string>")).alias("f")).select(F.from_json("f", shape).alias("f"))
    rows = items.where("f.geometry.type = 'Polygon' and size(f.geometry.coordinates) > 0")
    poly = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return rows.select(F.col("f.properties.name").alias("name"), F.col("f.properties.classification.name").alias("kind"), poly.alias("poly"))


def project_summary(summary: DataFrame) -> DataFrame:
    """Summary rows with four-decimal scores, as text."""
    return summary.select(*[F.format_string("%.4f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in summary.dtypes])


def confusion_rows(cells: DataFrame) -> DataFrame:
    """(true, predicted, count, row_normalised) of rows (a, b, n), shares with six decimals."""
    total = cells.groupBy("a").agg(F.sum("n").alias("t"))
    return cells.join(total, "a").select(F.col("a").alias("true"), F.col("b").alias("predicted"), F.col("n").alias("count"), F.format_string("%.6f", F.coalesce(F.try_divide(F.col("n"), F.col("t")), F.lit(0.0))).alias("row_normalised"))


def quoted(c: Column) -> Column:
    """CSV quoting where it is needed; null is empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.regexp_like(s, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
