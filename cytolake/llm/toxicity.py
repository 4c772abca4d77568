"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

Instances are the words of sentences, in letters only (case, accents of leetspeak and inserted signs are undone, letters
set apart by spaces are rejoined). The kernel of two words counts their common subsequences of three characters, each
weighted by ``decay`` for every character that it spans, so an insult with inserted or dropped characters stays close to
itself. Landmark words give the Nystroem map k(w, Z) K^-1/2, in which a linear machine is trained.

Labels are of whole documents, so learning is of multiple instances: a sentence of a toxic document is positive through
its witness, a word (or beginning of words) whose counts in toxic and clean documents of the sample no chance explains; all words of clean documents
are negative. Near copies with one label count as one document there, as all words of a toxic text that was copied often would seem to be witnesses. After each of ``rounds`` fits, the words with which clean sample documents score highest become further
negatives. Since the kernel is an inner product of explicit subsequence counts, the trained machine is one weight per
subsequence: a word costs a few table look-ups, once per worker while it is remembered. The margins of a document's two
worst words and the share of its words with a positive margin are calibrated by logistic regression on the sample.

The fit uses at most ``per_class`` labelled documents of each label (those of smallest hash), which is its documented
bound, and the calibration weighs them back to the shares of all labels; every document is scored over its whole text. Nothing but the sample is joined or shuffled.

A null or empty text has no words and gets the lowest score. Without labels of both kinds every score is the share of
label 1 (0 without labels). Labels of one document on several rows count as toxic if one of them is; null labels and ids
are ignored. Repeated documents get equal scores.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neardup import minhashes
from .shared import FORGET, Tables, lean, small_enough
from .words import encode, runs, shingle_sets

#: Codes: 0 word start, 1 word end, 2 to 31 characters.
_CODES, _WIDTH, _STEP = 32, 24, 12
_LEET = str.maketrans("013457@$!|", "oieastasii")
_STRIP = re.compile(r"[\W\d_]+")
CACHE_WORDS = 400_000
#: Lengths of word beginnings that count as evidence for all their words.
STEMS = (4, 5)
#: Minhashes of a document's pairs of words; documents that agree in half of them are near copies.
SKETCH = 32
_MEMORY: dict[bytes, dict[bytes, float]] = {}
FORGET.append(_MEMORY.clear)


def letters(word: bytes) -> str:
    """A word in lower-case letters: signs at its ends go first, then leetspeak and inserted signs are undone."""
    text = word.decode("utf-8", "replace").strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
    return text if text.isalpha() else _STRIP.sub("", text.translate(_LEET))


def windows(text: str) -> list[str]:
    """The word, or overlapping windows that cover a long one."""
    return [text] if len(text) <= _WIDTH else [text[i : i + _WIDTH] for i in range(0, len(text) - _STEP, _STEP)]


def _codes(words: list[str], n: int) -> np.ndarray:
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)
    out = np.empty((len(words), n + 2), np.int64)
    out[:, 0], out[:, -1] = 0, 1
    plain = (points >= 97) & (points <= 122)
    out[:, 1:-1] = np.where(plain, points - 95, 28 + points % 4)
    return out


def subsequences(words: list[str], decay: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (numbers of the words, features of their character triples, weights of the triples)."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, at in by.items():
        a, b, c = np.array(list(itertools.combinations(range(n + 2), 3))).T if n else (np.array([], int),) * 3
        weight = decay ** (c - a - 2.0)
        step = max(1, (1 << 20) // max(1, len(a)))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            code = _codes([words[i] for i in part], n)
            yield np.array(part), (code[:, a] * _CODES + code[:, b]) * _CODES + code[:, c], weight


def features(words: list[str], decay: float, column: np.ndarray) -> np.ndarray:
    """Normalised subsequence counts of a few words. column: of each feature, the last for those that are left out."""
    out = np.zeros((len(words), int(column.max()) + 1), np.float32)
    for part, f, weight in subsequences(words, decay):
        if f.shape[1]:
            np.add.at(out, (part[:, None], column[f]), np.broadcast_to(weight, f.shape))
            out[part] /= np.maximum(_norms(f, weight), 1e-9)[:, None].astype(np.float32)
    return out[:, :-1]


def _norms(f: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Length of each row's count vector, where one feature may stand in several places."""
    order = np.argsort(f, axis=1)
    f, w = np.take_along_axis(f, order, 1), weight[order]
    first = np.ones(f.shape, bool)
    first[:, 1:] = f[:, 1:] != f[:, :-1]
    total = np.add.reduceat(w.reshape(-1), np.flatnonzero(first))
    rows = np.repeat(np.arange(len(f)), first.sum(1))
    return np.sqrt(np.bincount(rows, total**2, len(f)))


@dataclass
class Model:
    decay: float = 0.5
    weights: np.ndarray | None = None  # one per subsequence
    bias: float = 0.0
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))
    prior: float = 0.0
    key: bytes = b""
    words: dict = field(default_factory=dict)  # the words learned from, with their labels

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -2.0)
        for part, f, weight in subsequences(words, self.decay):
            if f.shape[1]:
                out[part] = (self.weights[f] @ weight) / np.maximum(_norms(f, weight), 1e-9) + self.bias
        return out

    def score(self, signs: np.ndarray) -> np.ndarray:
        """signs: of each text, as of ``signs()``."""
        if self.weights is None:
            return np.full(len(signs), self.prior)
        return 1 / (1 + np.exp(-np.clip(np.c_[signs, np.ones(len(signs))] @ self.calibration, -30, 30)))


def instances(text) -> set[bytes]:
    """Distinct words of a text, and the joins of three or more letters in a row that stand alone."""
    words = encode(text).split()
    out = set(words)
    if sum(len(w) == 1 for w in out) >= 2:
        for alone, run in itertools.groupby(words, key=lambda w: len(w) == 1):
            if alone and len(run := list(run)) >= 3:
                out.add(b"".join(run))
    return out


#: Of a text without words.
NOTHING = (-2.0, -2.0, 0.0)


def signs(model: Model, texts: list) -> tuple[np.ndarray, list[bytes]]:
    """Of each text: margins of its worst and second worst word, log of the share of its distinct words with a positive
    margin; and its worst word."""
    if model.weights is None:
        return np.array([NOTHING] * len(texts)).reshape(len(texts), 3), [b""] * len(texts)
    known = _MEMORY.get(model.key)
    if known is None:
        _MEMORY.clear()
        known = _MEMORY[model.key] = {}
    held = [instances(t) for t in texts]
    new = [w for w in set().union(*held) if w not in known]
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()
        new = list(set().union(*held))
    if new:
        pieces, owner = [], []
        for i, w in enumerate(new):
            for piece in windows(letters(w)):
                pieces.append(piece)
                owner.append(i)
        top = np.full(len(new), -2.0)
        np.maximum.at(top, np.array(owner, np.int64), model.margins(pieces))
        known.update(zip(new, top.tolist(), strict=True))
    out, words = np.array([NOTHING] * len(texts)).reshape(len(texts), 3), [b""] * len(texts)
    for i, h in enumerate(held):
        if h:
            found = list(h)
            margin = np.fromiter(map(known.__getitem__, found), float, len(found))
            at = int(margin.argmax())
            words[i], first = found[at], margin[at]
            margin[at] = -2.0
            hits = (first > 0) + int((margin > 0).sum())
            out[i] = first, margin.max(), np.log1p(100 * hits / len(found))
    return out, words


def _fit_words(pos: list[str], neg: list[str], decay: float, landmarks: int, strength: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the machine, as one weight per subsequence."""
    marks = pos[: landmarks // 2] + neg[: landmarks - min(len(pos), landmarks // 2)]
    present = np.unique(np.concatenate([f.reshape(-1) for _, f, _ in subsequences(marks, decay)]))
    column = np.full(_CODES**3, len(present))
    column[present] = np.arange(len(present))
    z = features(marks, decay, column)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # K^-1/2, up to a rotation
    basis = z.T.astype(np.float64) @ root
    words = [*pos, *neg]
    x = np.concatenate([features(words[i : i + 1000], decay, column) @ basis for i in range(0, len(words), 1000)])
    x = np.c_[x, np.ones(len(x))]
    y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
    cost = np.where(y > 0, strength / len(pos), strength / len(neg)) * len(y) / 2
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(30):  # Newton steps of the squared hinge loss
        slack = 1 - y * (x @ w)
        on = slack > 0
        gradient = ridge * w - 2 * x[on].T @ (cost[on] * y[on] * slack[on])
        step = np.linalg.solve(np.diag(ridge) + 2 * x[on].T @ (cost[on, None] * x[on]), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    out = np.zeros(_CODES**3, np.float32)
    out[present] = basis @ w[:-1]
    return out, float(w[-1])


def _calibrate(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the signs, towards smoothed targets. weight: of each row, 1 on average."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ ((weight * p * (1 - p) + 1e-9)[:, None] * x) + 1e-2 * np.eye(x.shape[1])
        step = np.clip(np.linalg.solve(h, x.T @ (weight * (p - target)) + 1e-2 * w), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(tables: Tables, docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(toxic, text) of at most per_class labelled documents of each kind, those of smallest hash, and how
    many labelled documents one of each kind stands for."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    every = {r[0]: r[1] for r in ids.groupBy("toxic").count().collect()}
    part = [ids.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    chosen = tables.cut(part[0].unionByName(part[1]), "chosen")
    found = docs.join(F.broadcast(chosen) if small_enough(chosen, 16) else chosen, "doc_id").dropDuplicates(["doc_id"])
    picked = {r[0]: r[1] for r in chosen.groupBy("toxic").count().collect()}
    return tables.cut(found.select("doc_id", "toxic", "text"), "sample"), {t: every[t] / n for t, n in picked.items()}


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, sketch) of the texts with words."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for lo, hi in runs(texts):
            sets = shingle_sets(texts[lo:hi], 2)
            full = [i for i, x in enumerate(sets) if len(x)]
            if full:
                rows = minhashes([sets[i] for i in full], SKETCH)
                part = batch.slice(lo, hi - lo).take(pa.array(full))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "toxic", "sketch"])


def _shares(sketches: np.ndarray) -> np.ndarray:
    """Of each document the share that it has in its group of near copies: those of no earlier group that are near its first one."""
    out = np.ones(len(sketches))
    left = np.arange(len(sketches))
    while len(left):
        near = (sketches[left] == sketches[left[0]]).sum(1) * 2 >= sketches.shape[1]
        out[left[near]] = 1 / near.sum()
        left = left[~near]
    return out


def _copies(sample: DataFrame) -> tuple[dict[int, float], list[float]]:
    """The shares of the documents that have near copies with their label in the sample, whose size is bounded; and by how much less
    than their number the documents of label 0 and of label 1 count."""
    rows = sorted(sample.select("doc_id", "toxic", "text").mapInArrow(lean("toxicity", _sketches), "doc_id long, toxic int, sketch binary").collect())
    out: dict[int, float] = {}
    less = []
    for toxic in (0, 1):
        own = [r for r in rows if int(r[1]) == toxic]
        share = _shares(np.frombuffer(b"".join(bytes(r[2]) for r in own), np.uint32).reshape(-1, SKETCH))
        out |= {r[0]: x for r, x in zip(own, share.tolist(), strict=True) if x < 1}
        less.append(float((1 - share).sum()))
    return out, less


def _pairs(copies: dict[int, float]):
    """(word, toxic, share): the words of a document, which together with its near copies counts as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, labels, shares = [], [], []
            for doc_id, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = {p for w in instances(text) for p in windows(letters(w)) if len(p) > 1}
                words += found
                labels += [int(toxic)] * len(found)
                shares += [copies.get(doc_id, 1.0)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int64()), pa.array(shares, pa.float64())], ["word", "toxic", "share"])

    return run


def _evidence(a: Column, b: Column, share: float) -> Column:
    """Log likelihood ratio for more toxic holders than their share of the sample explains."""
    side = lambda c, p: F.when(c > 0, c * F.log(c / ((a + b) * p))).otherwise(0.0)
    return F.when(a > (a + b) * share, side(a, share) + side(b, 1 - share)).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, landmarks: int = 192, words: int = 2500, rounds: int = 3, decay: float = 0.5, margin: float = 2.0, purity: float = 0.7) -> Model:
    """A model from the labelled documents that are not held out (crc32 of the id as text, mod 5, is not 0)."""
    tables, model = Tables(docs.sparkSession), Model(decay)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sample, odds = _sample(tables, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, per_class)
    count = {int(r[0]): r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = count.get(1, 0), count.get(0, 0)
    model.prior = n1 * odds.get(1, 1.0) / max(1.0, n0 * odds.get(0, 1.0) + n1 * odds.get(1, 1.0))
    if not n0 or not n1:
        tables.drop("chosen", "sample")
        return model
    copies, less = _copies(sample)
    held = sample.select("doc_id", "toxic", "text").mapInArrow(lean("toxicity", _pairs(copies)), "word string, toxic long, share double")
    # rounded, as the order of a sum is not fixed
    stats = held.groupBy("word").agg(*(F.round(F.sum(F.col("share") * (F.col("toxic") == t).cast("int")), 6).alias(c) for t, c in ((1, "a"), (0, "b"))))
    share = (n1 - less[1]) / (n0 + n1 - less[0] - less[1])
    stats = tables.cut(stats.withColumn("evidence", _evidence(F.col("a"), F.col("b"), share)), "stats")
    # evidence is a log likelihood ratio; a threshold of the log of the number of words leaves none to chance
    least = float(np.log(max(2, stats.where("a + b > 1").count()))) + margin
    strong = (F.col("evidence") >= least) & (F.col("a") > purity * (F.col("a") + F.col("b")))
    known = strong
    for n in STEMS:  # beginnings that stay telling without their most telling word
        stem = F.substring("word", 1, n)
        by = stats.where(F.length("word") > n).groupBy(stem.alias("stem")).agg((F.sum("a") - F.max("a")).alias("a"), F.sum("b").alias("b"))
        by = by.where((_evidence(F.col("a"), F.col("b"), share) >= least) & (F.col("a") > 0.95 * (F.col("a") + F.col("b"))))
        known = known | (stem.isin([r[0] for r in by.orderBy(F.desc("a"), "stem").limit(words).collect()]) & (F.col("a") > 0) & (F.col("b") == 0))
    pos = [r[0] for r in stats.where(known).orderBy(F.desc("evidence"), F.desc("a"), "word").limit(words).collect()]
    if not pos:  # too few labels for evidence: the words of toxic documents that no clean one holds
        pos = [r[0] for r in stats.where("b = 0 and a > 0").orderBy(F.desc("a"), "word").limit(words).collect()]
    clean = stats.where("b > 0").where(~known)
    neg = [r[0] for r in clean.orderBy(F.desc("b"), "word").limit(words).collect()] + [r[0] for r in clean.orderBy(F.xxhash64("word"), "word").limit(words).collect()]
    neg = list(dict.fromkeys(neg))
    if not pos or not neg:
        tables.drop("chosen", "sample", "stats")
        return model
    for turn in range(rounds):
        model.weights, model.bias = _fit_words(pos, neg, decay, landmarks, 1.0)
        model.key = model.weights.tobytes()[:64] + str(model.bias).encode()
        seen = sample.select("toxic", "text").mapInArrow(lean("toxicity", _signs(model)), "toxic int, m1 double, m2 double, rate double, word binary").collect()
        if turn < rounds - 1:
            hard = {p for r in seen if not r[0] and r[1] > -0.7 for p in windows(letters(bytes(r[4]))) if len(p) > 1}
            neg = [*(hard - set(neg) - set(pos)), *neg]
    # rows weigh as the labels they stand for, so that the 0.5 cut means the same on every size of data
    weight = np.array([odds[int(r[0])] for r in seen])
    model.calibration = _calibrate(np.array([r[1:4] for r in seen]), np.array([float(r[0]) for r in seen]), weight / weight.mean())
    model.words = {"pos": pos, "neg": len(neg)}
    tables.drop("chosen", "sample", "stats")
    return model


def _signs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                x, words = signs(model, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in x.T), pa.array(words, pa.binary())], ["toxic", "m1", "m2", "rate", "word"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep`` (of docs) with ``score`` and ``predicted`` for every row."""
    from pyspark.sql import types as T

    kept = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("__score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                x, _ = signs(model, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.score(x), pa.float64())], [*part.schema.names[:-1], "__score"])

    out = kept.mapInArrow(lean("toxicity", run), schema).withColumnRenamed("__score", "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
