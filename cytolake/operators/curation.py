"""Names, labels and shapes as a curator handles them: feature names, label upkeep, selections, crops and annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import effective_class, inside_array, original_class

#: Prefixes of shape measurements, whole words of embedding names, and the names of the groups.
COMPARTMENTS = ("Cell", "Cytoplasm", "Membrane", "Nucleus")
EMBEDDING_WORDS = ("umap", "tsne", "pca", "phenograph", "leiden", "latent", "emb", "embed")
MORPHOLOGY, EMBEDDINGS, NEIGHBORS, OTHER = "Morphology / Shape", "Embeddings", "Neighbors", "Other / Uncategorized"
#: The least crop around a cell in pixels, and the cell sizes left free on each side.
LEAST_CROP, PADDING = 96.0, 3.5
#: Least scores of the summary view by preset.
PRESETS = {"strict": 1.5, "balanced": 0.5, "sensitive": 0.0}


def discovered(df: DataFrame, names: str, order: str) -> DataFrame:
    """(name, row, place): distinct keys of a map column with where each was first seen, by partial minima."""
    seen = df.select(F.col(order).alias("row"), F.posexplode(F.map_keys(names)).alias("place", "name"))
    return seen.groupBy("name").agg(F.min(F.struct("row", "place")).alias("at")).select("name", "at.row", "at.place")


def prefix(name: Column) -> Column:
    """What stands before the first ``": "``; null if nothing does."""
    return F.when(F.instr(name, ": ") > 1, F.substring_index(name, ": ", 1))


def feature_group(name: Column) -> Column:
    """The category of a measurement name: embeddings by whole words, shapes by compartment, neighbours, else its marker."""
    words = F.split(F.lower(name), "[^a-z0-9]+")
    embedded = F.exists(words, lambda w: F.startswith(w, F.lit("embedding")) | w.isin(*EMBEDDING_WORDS))
    p = prefix(name)
    return F.when(embedded, EMBEDDINGS).when(p.isNull(), OTHER).when(p.isin(*COMPARTMENTS), MORPHOLOGY).otherwise(p)


def leaf_label(name: Column) -> Column:
    """A name without the marker that its group is called by."""
    marker = ~feature_group(name).isin(MORPHOLOGY, EMBEDDINGS, NEIGHBORS, OTHER)
    return F.when(marker, F.substr(name, F.length(prefix(name)) + 3)).otherwise(name)


def measurement_like(m: Column, part: str) -> Column:
    """The value of the first measurement whose name holds ``part`` in any case; null without one."""
    return F.get(F.map_values(F.map_filter(m, lambda k, v: F.contains(F.lower(k), F.lit(part.lower())))), F.lit(0))


def without_measurements(m: Column, keywords: Sequence[str]) -> Column:
    """A map without the measurements whose names hold one of the keywords in any case."""
    words = F.array(*[F.lit(w.lower()) for w in keywords])
    return F.map_filter(m, lambda k, v: ~F.exists(words, lambda w: F.contains(F.lower(k), w)))


def labels_of(labels: DataFrame, classes: Sequence[str], keep: bool) -> DataFrame:
    """The labels that count as one of the classes (``keep``), or those that do not."""
    among = F.coalesce(effective_class(F.col("raw")).isin(*classes), F.lit(False))
    return labels.where(among if keep else ~among)


def latest(labels: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the last in order: a label that is accepted or overridden later wins."""
    rest = [c for c in labels.columns if c not in keys]
    return labels.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(labels.columns)


def stripped(annotations: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations without classed points, and cells without a class."""
    points = F.col("is_point") & F.col("class").isNotNull()
    return annotations.where(~F.coalesce(points, F.lit(False))), cells.withColumn("class", F.lit(None).cast("string"))


def mapped_clusters(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """class by (cluster, class) rows; unmapped clusters leave it as it is. A mapping has a row per cluster."""
    new = mapping.select("cluster", F.col("class").alias("__new"))
    return cells.join(new, "cluster", "left").withColumn("class", F.coalesce("__new", "class")).drop("__new").select(cells.columns)


def valid_class(c: Column, classes: Sequence[str], ignored: Sequence[str] = ()) -> Column:
    return F.coalesce(c.isin(*[x for x in classes if x not in ignored]), F.lit(False))


def incomplete_images(cells: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(image) of the images with a cell that lacks one of the measures; the others can be skipped."""
    whole = F.lit(True)
    for m in measures:
        whole = whole & F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double"))
    return cells.groupBy("image").agg(F.bool_and(whole).alias("whole")).where("not whole").select("image")


def summary_view(rows: DataFrame, preset: str = "balanced", flagged_only: bool = False, target: str | None = None) -> DataFrame:
    """The images that the summary shows: flagged ones, those from the preset's score on, and those without predictions."""
    shown = F.col("flagged") | (F.col("score") >= PRESETS[preset]) | (F.col("predicted") == 0)
    if flagged_only:
        shown = shown & F.col("flagged")
    if target is not None:
        shown = shown & F.array_contains("rare", target)
    return rows.where(shown)


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a finite point lies in (x0, y0, x1, y1), edges included."""
    x0, y0, x1, y1 = box
    return ~F.isnan(x) & ~F.isnan(y) & x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1))


def crop(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """(x, y, w, h) of the window around a cell's centre, clamped to the image."""
    size = F.greatest(w, h)
    tile = F.greatest(F.lit(LEAST_CROP), F.when(size <= 0, LEAST_CROP).otherwise(size) * (1 + 2 * PADDING))
    left, top = (F.floor(F.greatest(F.lit(0.0), c - tile / 2)) for c in (x, y))
    span = lambda start, end: F.greatest(F.lit(1), F.ceil(F.least(F.lit(float(end)) - start, tile))).cast("long")
    return F.struct(left.cast("long").alias("x"), top.cast("long").alias("y"), span(left, width).alias("w"), span(top, height).alias("h"))


def crop_context(sampled: DataFrame, cells: DataFrame, tile: float) -> DataFrame:
    """(image, sampled, id, dx, dy): the cells whose boxes meet the window of each sampled cell, in its coordinates, itself
    included. sampled: image, id, window (x, y, w, h); cells: image, id, x, y, w, h. Both sides meet on tiles."""
    lo = hi = lambda c: F.floor(c / tile)
    s = sampled.select("image", F.col("id").alias("sampled"), "window")
    s = s.withColumn("tx", F.explode(F.sequence(lo(F.col("window.x")), hi(F.col("window.x") + F.col("window.w"))))).withColumn("ty", F.explode(F.sequence(lo(F.col("window.y")), hi(F.col("window.y") + F.col("window.h")))))
    c = cells.withColumn("tx", F.explode(F.sequence(lo(F.col("x") - F.col("w") / 2), hi(F.col("x") + F.col("w") / 2)))).withColumn("ty", F.explode(F.sequence(lo(F.col("y") - F.col("h") / 2), hi(F.col("y") + F.col("h") / 2))))
    meets = (F.abs(F.col("x") - (F.col("window.x") + F.col("window.w") / 2)) * 2 < F.col("w") + F.col("window.w")) & (F.abs(F.col("y") - (F.col("window.y") + F.col("window.h") / 2)) * 2 < F.col("h") + F.col("window.h"))
    pairs = s.join(c, ["image", "tx", "ty"]).where(meets | (F.col("id") == F.col("sampled")))
    return pairs.select("image", "sampled", "id", (F.col("x") - F.col("window.x")).alias("dx"), (F.col("y") - F.col("window.y")).alias("dy")).distinct()


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def matching_channels(channels: DataFrame, markers: DataFrame) -> DataFrame:
    """(channel, shown): whether a channel's plain name equals, holds or lies within one of the markers'. Both are the names of one panel,
    so the smaller side, a marker list, is one array."""
    names = markers.select(plain_name(F.col("marker")).alias("m")).where("m <> ''").agg(F.collect_set("m").alias("all"))
    n = plain_name(F.col("channel"))
    return channels.crossJoin(F.broadcast(names)).select("channel", F.exists("all", lambda m: F.contains(n, m) | F.contains(m, n)).alias("shown"))


def keyword_cells(cells: DataFrame, shapes: DataFrame, keywords: Sequence[str], tile: float) -> DataFrame:
    """(image, id) of the cells in a shape whose name holds one of the keywords in any case; both sides meet on tiles."""
    named = shapes.where(F.exists(F.array(*[F.lit(k.strip().lower()) for k in keywords]), lambda k: F.contains(F.lower("name"), k)))
    return cells_in(cells, named, tile).select("image", "id").distinct()


def cells_in(cells: DataFrame, shapes: DataFrame, tile: float) -> DataFrame:
    """Rows of cells (image, id, x, y) with every shape (image, name, poly, ...) that holds them."""
    p = F.col("poly")
    lo = lambda f: F.floor(F.array_min(F.transform(p, lambda v: v[f])) / tile)
    hi = lambda f: F.floor(F.array_max(F.transform(p, lambda v: v[f])) / tile)
    s = shapes.withColumn("tx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("ty", F.explode(F.sequence(lo("y"), hi("y"))))
    c = cells.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    return c.join(s, ["image", "tx", "ty"]).where(inside_array(F.col("x"), F.col("y"), p)).drop("tx", "ty")


def area(poly: Column) -> Column:
    """Area of a polygon column, an array of (x, y)."""
    n = F.size(poly)
    turned = F.concat(F.slice(poly, n, 1), F.slice(poly, 1, n - 1))
    cross = F.zip_with(turned, poly, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def smallest_container(cells: DataFrame, shapes: DataFrame, tile: float) -> DataFrame:
    """(image, id, parent): the smallest shape that holds each cell, ties to the smaller name."""
    held = cells_in(cells, shapes.withColumn("area", area(F.col("poly"))), tile)
    return held.groupBy("image", "id").agg(F.min_by("name", F.struct("area", "name")).alias("parent"))


def signed_distance(x: Column, y: Column, poly: Column) -> Column:
    """Distance of a point from a polygon's edge, negative inside."""
    n = F.size(poly)
    turned = F.concat(F.slice(poly, n, 1), F.slice(poly, 1, n - 1))

    def far(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        length = dx * dx + dy * dy
        t = F.when(length == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / length)))
        ex, ey = x - a["x"] - t * dx, y - a["y"] - t * dy
        return F.sqrt(ex * ex + ey * ey)

    d = F.array_min(F.zip_with(turned, poly, far))
    return F.when(inside_array(x, y, poly), -d).otherwise(d)


def point_labels(points: DataFrame, cells: DataFrame, existing: DataFrame, reach: float) -> DataFrame:
    """(image, cell, class) of point annotations on a cell within reach of its centre, but where the cell's label already means that
    class. points: image, id, x, y, class, seq; existing: image, cell, raw."""
    from .spatial import nearest_label

    found = nearest_label(points.withColumnRenamed("class", "label"), cells, reach)
    both = found.join(existing, ["image", "cell"], "left")
    return both.where(~F.coalesce(original_class(F.col("raw")) == F.col("label"), F.lit(False))).select("image", "cell", F.col("label").alias("class"))


def appended(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Stored rows and further ones of the same columns in the same order; otherwise the new rows alone."""
    return stored.unionByName(rows) if stored is not None and stored.columns == rows.columns else rows


def log_loss(df: DataFrame, truth: str, probs: str) -> DataFrame:
    """One row: mean of -ln of the true class's probability, 1e-15 at least. truth: index of the class from 0."""
    p = F.get(F.col(probs), F.col(truth).cast("int"))
    return df.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("log_loss"))


def checked_labels(df: DataFrame, label: str, classes: int) -> DataFrame:
    """df, whose evaluation fails on a label outside 0 to classes - 1 and names it."""
    if classes < 1:
        raise ValueError("at least one class is needed")
    bad = F.col(label).isNull() | (F.col(label) < 0) | (F.col(label) >= classes)
    message = F.concat(F.lit("label "), F.coalesce(F.col(label).cast("string"), F.lit("null")), F.lit(f" is outside 0 to {classes - 1}"))
    return df.withColumn(label, F.when(bad, F.raise_error(message).cast(df.schema[label].dataType)).otherwise(F.col(label)))
