"""Labels, predictions and their bookkeeping: filters, overlays, write-back, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import feature


def aligned(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted features in order, matched by trimmed name in any case; missing ones are 0, of equal names the last wins."""
    by = {c.strip().lower(): c for c in df.columns if c not in keep}
    return df.select(*keep, *[(feature(F.col(f"`{by[f.strip().lower()]}`")) if f.strip().lower() in by else F.lit(0.0)).alias(f) for f in features])


def shared_features(current: Sequence[str], imported: Sequence[str]) -> list[str]:
    there = {x.strip().lower() for x in imported}
    out = [c for c in current if c.strip().lower() in there]
    if not out:
        raise ValueError("no shared features")
    return out


def range_filter(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows outside any given bound go; rows that lack a measure stay."""
    for name, (lo, hi) in bounds.items():
        c = F.col(name)
        for bad in ([c < lo] if lo is not None else []) + ([c > hi] if hi is not None else []):
            df = df.where(~F.coalesce(bad, F.lit(False)))
    return df


def class_contains(df: DataFrame, class_col: str, keyword: str | None) -> DataFrame:
    key = (keyword or "").strip().lower()
    return df.where(F.contains(F.lower(class_col), F.lit(key))) if key else df


def overlay(stored: DataFrame, live: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Live rows shadow stored rows of the same key."""
    return stored.join(live.select(*keys).distinct(), list(keys), "left_anti").unionByName(live)


def write_back(cells: DataFrame, labels: DataFrame, key: str, label: str, out: str) -> DataFrame:
    """Every cell with its label + 1, or -1 outside the labelled population."""
    return cells.join(labels.select(key, F.col(label).alias("__l")), key, "left").withColumn(out, F.coalesce(F.col("__l") + 1, F.lit(-1)).cast("int")).drop("__l")


def first_wins(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key (blank keys skipped): the first in order, by partial minima rather than a window."""
    rest = [c for c in df.columns if c != key]
    some = df.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "")
    return some.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, "__r.*")


def population_counts(pred: DataFrame, label_cols: Sequence[str]) -> DataFrame:
    """(population, class, n) for every label column."""
    return pred.select(*label_cols).unpivot([], list(label_cols), "population", "class").groupBy("population", "class").agg(F.count("*").alias("n"))


def confusion(pred: DataFrame, a: str, b: str) -> DataFrame:
    return pred.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(pred: DataFrame, a: str, b: str) -> DataFrame:
    """(class, tp, row, col, agreement, dice) of two labellings."""
    cells = confusion(pred, a, b)
    sides = cells.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("n").alias("row"), F.lit(0).cast("long").alias("col")), F.struct(F.col("b").alias("class"), F.lit(0).cast("long").alias("row"), F.col("n").alias("col")))).alias("s"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("tp"))
    g = sides.groupBy("s.class").agg((F.sum("tp") / 2).cast("long").alias("tp"), F.sum("s.row").alias("row"), F.sum("s.col").alias("col"))
    union = F.col("row") + F.col("col") - F.col("tp")
    return g.withColumn("agreement", F.when(union == 0, 1.0).otherwise(F.col("tp") / union)).withColumn("dice", F.when(F.col("row") + F.col("col") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("row") + F.col("col"))))


def class_metrics(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """(class, support, precision, recall, f1) of every class, also those that never occur."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    cells = cells.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(c,) for c in classes], ["class"])))
    is_t, is_p, n = F.col("t") == F.col("class"), F.col("p") == F.col("class"), F.col("n")
    g = cells.groupBy("class").agg(F.sum(F.when(is_t & is_p, n).otherwise(0)).alias("tp"), F.sum(F.when(is_t, n).otherwise(0)).alias("support"), F.sum(F.when(is_p, n).otherwise(0)).alias("given"))
    precision = F.when(F.col("given") > 0, F.col("tp") / F.col("given")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    g = g.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return g.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).select("class", "support", "precision", "recall", "f1", "tp")


def overall_metrics(per_class: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 over all classes, and macro F1 over the classes with support."""
    n = F.sum("support")
    return per_class.agg((F.sum("tp") / n).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("cv_macro_f1"))


def composite(df: DataFrame, markers: Sequence[str], prefix: str | None = None, out: str = "class") -> DataFrame:
    """Classes of sorted ``M+`` and ``M-`` joined by ``:`` from positive probabilities; untrained (null) markers are left out."""
    parts = [F.when(F.col(m) >= 0.5, f"{m}+").when(F.col(m) < 0.5, f"{m}-") for m in sorted(markers)]
    some = F.concat_ws(":", *([F.col(prefix)] if prefix else []), *parts)
    return df.withColumn(out, F.when(F.coalesce(*[F.col(m) for m in markers]).isNotNull(), some))


def parse_rule(text: str) -> list[tuple[str, bool]]:
    """``CD3+:CD8-`` as conditions; errors for empty, repeated or malformed ones."""
    out: list[tuple[str, bool]] = []
    for part in text.split(":"):
        part = part.strip()
        if len(part) < 2 or part[-1] not in "+-":
            raise ValueError(f"bad condition {part!r}")
        out.append((part[:-1], part[-1] == "+"))
    if len({m.lower() for m, _ in out}) < len(out):
        raise ValueError("repeated marker")
    if len(out) > 128:
        raise ValueError("too many conditions")
    return out


def rule_mask(text: str) -> Column:
    mask = F.lit(True)
    for marker, positive in parse_rule(text):
        mask = mask & ((F.col(marker) >= 0.5) == F.lit(positive))
    return mask


def prediction_summary(images: DataFrame, pred: DataFrame) -> DataFrame:
    """One row per image: cells, disagreements, their share, class counts as text; images without predictions included."""
    per = pred.groupBy("image", "m1").agg(F.count("*").alias("n"), F.sum((F.col("m1") != F.col("m2")).cast("long")).alias("d"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m1", "n"))), lambda x: F.concat_ws(": ", x["m1"], x["n"].cast("string"))), ", ")
    g = per.groupBy("image").agg(F.sum("n").alias("predicted"), F.sum("d").alias("disagreements"), text.alias("classes"))
    out = images.select("image").distinct().join(g, "image", "left")
    return out.select("image", F.coalesce("predicted", F.lit(0)).alias("predicted"), F.coalesce("disagreements", F.lit(0)).alias("disagreements"), F.coalesce(F.col("disagreements") / F.col("predicted"), F.lit(0.0)).alias("rate"), F.coalesce("classes", F.lit("")).alias("classes"))
