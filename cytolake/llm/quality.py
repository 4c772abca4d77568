"""Quality classification by co-training two views of a document.

One view is the text (shares of characters, signs, capitals, repeats and line shapes of the whole text), the other the
metadata (language, source, stated length). A logistic classifier learns each view from the labelled sample. In every round
each view labels the unlabelled sample, and its most confident labels, at most ``exchange`` per class and only beyond
``confident``, join the training rows of the other view. In the end each view is calibrated on labelled rows that took no
part in fitting, and a logistic combination of the calibrated views, learned on the same rows, scores all documents.

The fit uses at most ``per_class`` labelled documents of each label and ``unlabelled`` others (those of smallest hash); this
is its documented bound, and only their features reach the driver; calibration weighs them back to the shares of all labels. Every document is scored over its whole text, where it is
read. A null text counts as empty, null metadata as a value of its own, a null n_chars as 0. Without labels of both kinds
every score is the share of label 1 (1 without labels: nothing is rejected). Labels that occur on several rows of one
document count as their smallest. Repeated documents get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Tables, small_enough
from .words import encode

_SOURCES, _LANGS = 64, 16
_RUNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
_GROUPS = [b"#*$%&|<>", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b"\n", b" ", b"()[]{}\"'", b"@/\\_=+-~^`"]


def text_view(text) -> list[float]:
    data = encode(text)
    words = data.split()
    n, chars = max(1, len(words)), max(1, len(data))
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = [float(bytes_[list(g)].sum()) / chars for g in _GROUPS]
    rest = float(bytes_[128:].sum()) / chars
    lines = [x for x in data.split(b"\n") if x.strip()]
    kinds = set(words)
    runs = _RUNS.findall(data)
    line_words = n / max(1, len(lines))
    top = float(bytes_.max()) / chars
    repeat = 1 - len(kinds) / n
    ended = sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines) / max(1, len(lines))
    return [
        *np.sqrt(shares).tolist(), rest, np.log1p(len(words)), chars / n / 10, repeat, repeat / np.log1p(n), 1 - len(set(lines)) / max(1, len(lines)), len(runs) / n,
        sum(map(len, runs)) / chars, np.log1p(line_words), ended, top, float(len(words) < 10), float(max(map(len, words), default=0) > 40), 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2),
    ]


def meta_view(lang, source, n_chars) -> list[float]:
    out = [0.0] * (_LANGS + _SOURCES + 2)
    out[zlib.crc32(repr(lang).encode()) % _LANGS] = 1.0
    out[_LANGS + zlib.crc32(repr(source).encode()) % _SOURCES] = 1.0
    size = np.log1p(max(0, n_chars or 0))
    out[-2:] = [size, size**2 / 10]
    return out


@dataclass
class View:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    level: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.centre) / self.spread, -8, 8), np.ones(len(x))] @ self.weights

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.level, -20, 20)


@dataclass
class Model:
    prior: float = 1.0
    views: list[View] = field(default_factory=list)
    joint: np.ndarray | None = None
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: combined score, and those of the calibrated views."""
        if self.joint is None:
            return np.full((len(text), 3), self.prior)
        z = np.stack([v.logit(x) for v, x in zip(self.views, (text, meta), strict=True)], 1)
        joint = np.c_[z, np.ones(len(z))] @ self.joint
        return 1 / (1 + np.exp(-np.clip(np.c_[joint, z], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    w, pull = np.zeros(x.shape[1]), ridge * np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ ((weight * p * (1 - p))[:, None] * x) + np.diag(pull + 1e-9)
        step = np.clip(np.linalg.solve(h, x.T @ (weight * (p - y)) + pull * w), -3, 3)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _fit_view(x: np.ndarray, y: np.ndarray, ridge: float) -> View:
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.c_[np.clip((x - centre) / spread, -8, 8), np.ones(len(x))]
    balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    return View(centre, spread, _logistic(z, y, balance, ridge))


def _calibrated(view: View, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = _logistic(np.c_[view.raw(x), np.ones(len(x))], target, weight, 1e-3)
    view.slope, view.level = max(float(w[0]), 0.0), float(w[1])
    return view


def cotrain(x: list[np.ndarray], y: np.ndarray, held: np.ndarray, pool: list[np.ndarray], rounds: int = 4, exchange: int = 200, confident: float = 0.97, ridge: float = 1.0, odds: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model from labelled rows of two views (held: those for calibration) and unlabelled rows. odds: how many labelled
    documents a row of each label stands for; calibration weighs by them."""
    weight = np.where(y > 0, odds[1], odds[0])
    model = Model(float(np.average(y, weights=weight)))
    weight = weight[held] / weight[held].mean()
    own = [(x[v][~held], y[~held]) for v in (0, 1)]
    free = np.ones(len(pool[0]), bool)
    for turn in range(rounds + 1):
        model.views = [_calibrated(_fit_view(*own[v], ridge), x[v][held], y[held], weight) for v in (0, 1)]
        if turn == rounds:
            break
        given, moved = [], []
        for v in (0, 1):
            p = 1 / (1 + np.exp(-model.views[v].logit(pool[v]))) if len(free) else np.zeros(0)
            chosen = []
            for sure, label in ((p, 1.0), (1 - p, 0.0)):
                at = np.flatnonzero(free & (sure >= confident))
                at = at[np.argsort(-sure[at], kind="stable")][:exchange]
                chosen.append((at, label))
            given.append(chosen)
            moved.append(sum(len(a) for a, _ in chosen))
        for v, chosen in ((1, given[0]), (0, given[1])):
            for at, label in chosen:
                own[v] = np.concatenate([own[v][0], pool[v][at]]), np.concatenate([own[v][1], np.full(len(at), label)])
                free[at] = False
        model.exchanged.append(tuple(moved))
        if not sum(moved):
            break
    z = np.stack([model.views[v].logit(x[v][held]) for v in (0, 1)], 1)
    model.joint = _logistic(np.c_[z, np.ones(len(z))], y[held], weight, 1e-2)
    return model


def _views(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, lang, source, n = (rows.column(i).to_pylist() for i in range(4))
    return np.array([text_view(t) for t in text], float), np.array([meta_view(*m) for m in zip(lang, source, n, strict=True)], float)


def _inputs() -> list[Column]:
    return [F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, unlabelled: int = 6000) -> Model:
    tables = Tables(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.col("quality").cast("int")).alias("y"))
    known = tables.cut(known, "known")
    every = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    by = F.xxhash64("id", F.lit("quality")), F.col("id")
    part = [known.where(F.col("y") == k).orderBy(*by).limit(per_class) for k in (0, 1)]
    other = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").join(known.select("id"), "id", "left_anti")
    part.append(other.distinct().orderBy(*by).limit(unlabelled).select("id", F.lit(None).cast("int").alias("y")))
    chosen = tables.cut(part[0].unionByName(part[1]).unionByName(part[2]), "chosen")
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), *_inputs()).join(F.broadcast(chosen) if small_enough(chosen, 16) else chosen, "id").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, meta = _views(batch)
                yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())], ["id", "y", "t", "m"])

    rows = sample.select("text", "lang", "source", "n_chars", "id", "y").mapInArrow(run, "id long, y int, t binary, m binary").orderBy("id").collect()
    tables.drop("known", "chosen")
    y = np.array([np.nan if r["y"] is None else r["y"] for r in rows])
    lab = ~np.isnan(y)
    if not (y[lab] == 1).any() or not (y[lab] == 0).any():
        return Model(float(y[lab].mean()) if lab.any() else 1.0)
    x = [np.array([np.frombuffer(r[c]) for r in rows]) for c in "tm"]
    held = np.array([zlib.crc32(b"%d" % r["id"]) % 10 < 3 for r in rows])[lab]
    for label in (0, 1):  # few labels: both kinds must be on both sides
        if not (held & (y[lab] == label)).any() or not (~held & (y[lab] == label)).any():
            held = np.arange(int(lab.sum())) % 2 == 0
    odds = tuple(every[k] / min(every[k], per_class) for k in (0, 1))
    if any(len(set(y[lab][side])) < 2 for side in (held, ~held)):
        return Model(float(np.average(y[lab], weights=np.where(y[lab] > 0, odds[1], odds[0]))))
    return cotrain([v[lab] for v in x], y[lab], held, [v[~lab] for v in x], odds=odds)


def score(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``score``, ``text_score``, ``meta_score`` and ``predicted`` (1: good) of every row."""
    base = docs.select(*_inputs(), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)])
    names = [f"__{i}" for i in range(len(keep))]
    scores = [T.StructField(c, T.DoubleType()) for c in ("score", "text_score", "meta_score")]
    schema = T.StructType([*base.schema.fields[4:], *scores])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                s = model.score(*_views(part))
                yield pa.RecordBatch.from_arrays([*part.columns[4:], *(pa.array(c) for c in s.T)], [*names, "score", "text_score", "meta_score"])

    out = base.mapInArrow(run, schema).withColumnsRenamed({n: c for n, c in zip(names, keep, strict=True)})
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
