"""What a project keeps between sessions: labels, predictions, sampled cells, marker tables, classifiers and their states.

Tables are Parquet by image (and scope), of which a save replaces only the partitions it brings. Small documents are one
JSON each, written beside its place and renamed, through the file system of the path, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import valid_predictions

VERSION = 1
LABELS = T.StructType([T.StructField("cell", T.LongType()), T.StructField("label", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("image", T.StringType())])
SAMPLED = T.StructType([T.StructField("place", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("image", T.StringType())])
_PROBABILITIES = T.ArrayType(T.DoubleType())
_PREDICTED = (("id", T.LongType()), ("m1", T.StringType()), ("m2", T.StringType()), ("p1", _PROBABILITIES), ("p2", _PROBABILITIES), ("classes", T.ArrayType(T.StringType())), ("image", T.StringType()))
PREDICTIONS = T.StructType([T.StructField(n, t) for n, t in _PREDICTED])


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cytolake-")
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str, **partition) -> bool:
    """Deletes a document, a table, or one partition of a table; whether there was one."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    fs, place = _at(spark, "/".join([path, *[f"{k}={escape(str(v))}" for k, v in partition.items()]]))
    return fs.delete(place, True)


def save_json(spark: SparkSession, path: str, document) -> None:
    fs, place = _at(spark, path)
    _, beside = _at(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(document, sort_keys=True, ensure_ascii=False).encode()))
    out.close()
    fs.delete(place, False)
    fs.rename(beside, place)


def load_json(spark: SparkSession, path: str):
    """The document, or None where there is none."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else None


def _replace(df: DataFrame, path: str, kind: T.StructType, by: Sequence[str]) -> None:
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in kind])
    rows.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _load(spark: SparkSession, path: str, kind: T.StructType, **partition) -> DataFrame | None:
    if not exists(spark, path):
        return None
    df = spark.read.schema(kind).parquet(path)
    for k, v in partition.items():
        df = df.where(F.col(k) == F.lit(v))
    return None if df.isEmpty() else df


def save_labels(df: DataFrame, path: str) -> None:
    """df: cell, label, scope, image. Images and scopes that df does not hold stay as they are."""
    _replace(df, path, LABELS, ("scope", "image"))


def load_labels(spark: SparkSession, path: str, **partition) -> DataFrame | None:
    return _load(spark, path, LABELS, **partition)


def label_tables(spark: SparkSession, path: str) -> DataFrame:
    """(scope, image) of the stored label tables."""
    df = load_labels(spark, path)
    return df.select("scope", "image").distinct() if df is not None else spark.createDataFrame([], "scope string, image string")


def save_predictions(df: DataFrame, path: str) -> None:
    """Valid rows of df (id, m1, m2, p1, p2, classes, image), by image."""
    _replace(valid_predictions(df), path, PREDICTIONS, ("image",))


def load_predictions(spark: SparkSession, path: str, **partition) -> DataFrame | None:
    """Rows read back; those that are not valid are left out here too."""
    df = _load(spark, path, PREDICTIONS, **partition)
    return None if df is None else valid_predictions(df)


def save_sampled(df: DataFrame, path: str) -> None:
    """df: place, cell, image; place is a cell's position in its image's sample."""
    _replace(df, path, SAMPLED, ("image",))


def load_sampled(spark: SparkSession, path: str, image: str) -> list[int]:
    """The sampled cells of an image in their order; a sample is a few hundred cells."""
    df = _load(spark, path, SAMPLED, image=image)
    return [] if df is None else [r["cell"] for r in df.orderBy("place").collect()]


def save_markers(df: DataFrame, path: str) -> None:
    """A marker table (cell_type and markers, or cell_type, primary, secondary, tertiary), one row for each type; an empty one deletes the document."""
    entries = [json.loads(x) for x in df.orderBy("cell_type").toJSON().collect()]
    if entries:
        save_json(df.sparkSession, path, {"version": VERSION, "hasRules": "primary" in df.columns, "entries": entries})
    else:
        remove(df.sparkSession, path)


def load_markers(spark: SparkSession, path: str) -> DataFrame | None:
    found = load_json(spark, path)
    if found is None:
        return None
    rest = ("primary", "secondary", "tertiary") if found["hasRules"] else ("markers",)
    kind = "cell_type string, " + ", ".join(f"{c} {'array<string>' if c == 'markers' else 'string'}" for c in rest)
    return spark.createDataFrame([tuple(e.get(c) for c in ("cell_type", *rest)) for e in found["entries"]], kind)


def save_classifier(spark: SparkSession, path: str, state: dict, models: dict | None = None) -> None:
    """Fitted models in folders of their names, then the state (features, classes, parameters, metrics), whose presence tells that all is there."""
    for name, model in (models or {}).items():
        model.write().overwrite().save(f"{path}/{name}")
    save_json(spark, f"{path}/state.json", state | {"models": sorted(models or {})})


def load_classifier(spark: SparkSession, path: str, loaders: dict | None = None) -> tuple[dict, dict] | None:
    """(state, models) with the models that ``loaders`` (name: class) can load."""
    state = load_json(spark, f"{path}/state.json")
    if state is None:
        return None
    return state, {n: loaders[n].load(f"{path}/{n}") for n in state["models"] if n in (loaders or {})}


def marker_folder(name: str | None) -> str:
    """A marker's name as a folder's."""
    safe = re.sub("[^A-Za-z0-9._-]", "_", (name or "").strip())
    if not safe or safe[0] in ".-":
        raise ValueError(f"not a marker's name: {name!r}")
    return safe


def register_marker(spark: SparkSession, path: str, name: str, state: dict, models: dict | None = None) -> str:
    """Saves the classifier of one marker and enters it in the registry; returns its folder."""
    folder = marker_folder(name)
    save_classifier(spark, f"{path}/{folder}", state, models)
    save_json(spark, f"{path}/registry.json", registry(spark, path) | {folder: f"{folder}/state.json"})
    return f"{path}/{folder}"


def registry(spark: SparkSession, path: str) -> dict[str, str]:
    return load_json(spark, f"{path}/registry.json") or {}


def unregister_marker(spark: SparkSession, path: str, name: str) -> bool:
    known = registry(spark, path)
    found = known.pop(marker_folder(name), None)
    if found:
        save_json(spark, f"{path}/registry.json", known)
        remove(spark, f"{path}/{marker_folder(name)}")
    return bool(found)
