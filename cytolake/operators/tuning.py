"""Search of boosting parameters by a tree-structured Parzen estimator, and metrics of a held-out fold.

The search runs on the driver over a handful of numbers a trial; every trial's folds are Spark fits and aggregations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cohort_models import boosted
from .labels import class_metrics, overall_metrics
from .learn import dual_model_predict
from .sampling import kfold, stratified_split

#: The search space (least, most), eta on a log scale, and what is used where nothing can be searched.
SPACE = {"rounds": (50, 500), "depth": (2, 12), "eta": (0.01, 0.3), "subsample": (0.5, 1.0), "colsample": (0.3, 1.0)}
DEFAULTS = {"rounds": 200, "depth": 6, "eta": 0.1, "subsample": 0.8, "colsample": 1.0}
#: Trials, folds, random trials first, share of good trials, candidates a trial, rows at least.
TRIALS, FOLDS, WARM_UP, GOOD, CANDIDATES, LEAST_ROWS = 20, 5, 5, 0.25, 24, 20
_NAMES = tuple(SPACE)
_LOW, _HIGH = np.array([np.log(v) if n == "eta" else v for n, v in zip(_NAMES * 2, [*(s[0] for s in SPACE.values()), *(s[1] for s in SPACE.values())], strict=True)], float).reshape(2, -1)


def _parameters(x: np.ndarray) -> dict:
    p = dict(zip(_NAMES, np.clip(x, _LOW, _HIGH).tolist(), strict=True))
    low, high = SPACE["rounds"]
    return p | {"rounds": int(np.clip(10 * round(p["rounds"] / 10), low, high)), "depth": round(p["depth"]), "eta": float(np.exp(p["eta"]))}


def _point(p: dict) -> np.ndarray:
    return np.array([np.log(p[n]) if n == "eta" else p[n] for n in _NAMES], float)


def _bandwidth(points: np.ndarray) -> np.ndarray:
    """Silverman's rule for each dimension, a quarter of the range where points do not spread."""
    spread = points.std(0, ddof=1) if len(points) > 1 else np.zeros(len(_LOW))
    flat = spread < 1e-10
    width = 1.06 * np.where(flat, (_HIGH - _LOW) / 4, spread) * len(points) ** -0.2
    return width if len(points) > 1 else (_HIGH - _LOW) / 4


def _log_density(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    h = _bandwidth(points)
    kernel = np.exp(-0.5 * ((x[:, None, :] - points[None]) / h) ** 2) / (h * np.sqrt(2 * np.pi))
    return np.log(np.maximum(kernel.mean(1), 1e-300)).sum(1)


def suggest(seen: Sequence[tuple[dict, float]], rng: np.random.Generator) -> dict:
    """The next parameters after trials (parameters, score): of candidates near the good trials the one that is likeliest
    among them and least likely among the others."""
    if len(seen) < WARM_UP:
        return _parameters(rng.uniform(_LOW, _HIGH))
    points = np.stack([_point(p) for p, _ in seen])[np.argsort([-s for _, s in seen], kind="stable")]
    n = min(max(1, int(np.ceil(GOOD * len(points)))), len(points) - 1)
    good, others = points[:n], points[n:]
    drawn = good[rng.integers(0, n, (CANDIDATES, len(_LOW))), np.arange(len(_LOW))]
    x = np.clip(drawn + rng.normal(size=drawn.shape) * _bandwidth(good), _LOW, _HIGH)
    return _parameters(x[np.argmax(_log_density(x, good) - _log_density(x, others))])


def search(score: Callable[[dict], float], trials: int = TRIALS, seed: int = 42) -> tuple[dict, float]:
    """(parameters, score) of the best trial; a trial that fails is not learned from, and defaults stand if all fail."""
    rng, seen, failure = np.random.default_rng(seed), [], None
    for _ in range(trials):
        p = suggest(seen, rng)
        try:
            found = float(score(p))
        except ValueError as e:  # parameters that the model refuses
            failure = e
            continue
        if np.isfinite(found):
            seen.append((p, found))
    if not seen and failure:
        return dict(DEFAULTS), 0.0
    return max(seen, key=lambda s: s[1]) if seen else (dict(DEFAULTS), 0.0)


def tune(df: DataFrame, classes: int, trials: int = TRIALS, folds: int = FOLDS, rounds: int | None = None, resample: Callable[[DataFrame], DataFrame] | None = None, seed: int = 42) -> tuple[dict, float]:
    """Best boosting parameters of df (id, vec, y from 0) by macro F1 over the folds' classes. Folds are dealt once; only
    the training part of each is resampled. rounds: held where an early stop has fixed them."""
    rows = kfold(df.select("id", "vec", "y"), "y", "id", folds, seed).persist()
    try:
        if rows.count() < LEAST_ROWS:
            return dict(DEFAULTS), 0.0
        parts = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
        held = {}
        for f in parts:
            train = rows.where(F.col("fold") != f).select("id", "vec", "y")
            held[f] = ((resample(train) if resample else train).persist(), rows.where(F.col("fold") == f))

        def score(p: dict) -> float:
            found = []
            for train, test in held.values():
                model = boosted(train, rounds or p["rounds"], p["depth"], seed, p["eta"], p["subsample"], p["colsample"])
                out = model.transform(test.select(array_to_vector("vec").alias("features"), F.col("y").cast("int").alias("y")))
                per_class = class_metrics(out.withColumn("p", F.col("prediction").cast("int")), "y", "p", range(classes))
                found.append(overall_metrics(per_class).first()["cv_macro_f1"] or 0.0)
            return float(np.mean(found))

        best, value = search(score, trials, seed)
        for train, _ in held.values():
            train.unpersist()
        return (best | {"rounds": rounds} if rounds else best), value
    finally:
        rows.unpersist()


def train_validation_metrics(df: DataFrame, resample: Callable[[DataFrame], DataFrame] | None = None, share: float = 0.8, seed: int = 42, **models) -> DataFrame | None:
    """(model, fold, class, support, precision, recall, f1) of both models on the training and the validation part of df (id,
    vec, label). Only the training part is resampled. None with too few rows or where one part would be empty."""
    split = stratified_split(df.select("id", "vec", "label"), "label", "id", share, seed).persist()
    parts = {r["train"]: r["n"] for r in split.groupBy("train").agg(F.count("*").alias("n")).collect()}
    if len(parts) < 2 or sum(parts.values()) < LEAST_ROWS:
        split.unpersist()
        return None
    train, rest = split.where("train").drop("train"), split.where("not train")
    train = (resample(train) if resample else train).select("vec", "label").orderBy("label", "vec").persist()  # in one order, as the models draw rows by their places
    rows = train.withColumn("fold", F.lit("train")).unionByName(rest.select("vec", "label", F.lit("validation").alias("fold")))
    out, _ = dual_model_predict(train, rows.select(F.struct("fold", "label").alias("id"), "vec"), seed=seed, **models)
    classes = [r[0] for r in df.where("label is not null").select("label").distinct().orderBy("label").collect()]
    out = out.select("id.fold", "id.label", "m1", "m2").groupBy("fold", "label", "m1", "m2").agg(F.count("*").alias("n"))
    long = out.unpivot(["fold", "label", "n"], ["m1", "m2"], "model", "predicted").groupBy("model", "fold", "label", "predicted").agg(F.sum("n").alias("n"))
    # counts by classes: a few numbers, read while the parts are held
    spark, kind = df.sparkSession, long.schema
    long = spark.createDataFrame(long.collect(), kind)
    train.unpersist()
    split.unpersist()
    each = long.crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in classes], df.select(F.col("label").alias("class")).schema)))
    is_t, is_p = F.col("label") == F.col("class"), F.col("predicted") == F.col("class")
    over = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    g = each.groupBy("model", "fold", "class").agg(over(is_t & is_p).alias("tp"), over(is_t).alias("support"), over(is_p).alias("given"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    g = g.withColumns({"precision": ratio("tp", "given"), "recall": ratio("tp", "support")})
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("given")), F.lit(0.0))
    return g.select("model", "fold", "class", "support", "precision", "recall", f1.alias("f1"))
