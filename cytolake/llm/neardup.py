"""MinHash near-duplicates with tensored banding.

A document's set holds the hashes of its distinct word shingles. Two small collections of ``bands`` bands, each of
``rows`` minhashes, are computed; a table's key combines a band of the first with a band of the second, so 2 * bands * rows
minhashes give bands**2 tables of 2 * rows minhashes each, where independent tables would take bands**2 * 2 * rows. Pairs
that share a key are candidates (two sets of similarity 0.8 miss with probability 6e-4 and are found more surely above it);
every link is then confirmed on the full sets. Documents with equal sets are one class before that, by a 128-bit digest,
and return to their class at the end, so copies cost one row each.

Full sets travel only for documents with a candidate, after a signature estimate has dropped the unlikely ones.

Null or empty texts, and texts of only white space, have an empty set, are linked with nothing and are their own component.
Texts with fewer words than a shingle have the whole sequence as their one shingle. Rows with one id are one document
whose set is that of its smallest text digest; each row is returned. Rows with a null id are returned with a null component,
linked with nothing and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import link, verified
from .shared import lean, semi, Tables
from .words import mix, runs, shingle_sets, stacked

_FEATURES = "id long, n_shingles long, digest binary, sig binary"


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(sets, n) minima of n hash functions, 32 bits each; every set has an element."""
    sizes = [len(s) for s in sets]
    flat, start = np.concatenate(sets), np.r_[0, np.cumsum(sizes)[:-1]]
    a, b = _seeds(n)
    out = np.empty((len(sets), n), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(n):
            out[:, j] = np.minimum.reduceat((flat * a[j] + b[j]) >> np.uint64(32), start)
    return out


def tensored_keys(bands: int, rows: int):
    """Keys of the bands**2 tables from signatures of 2 * bands * rows minhashes."""

    def keys(signatures: list[bytes] | np.ndarray) -> np.ndarray:
        m = stacked(signatures, np.uint32).reshape(len(signatures), 2, bands, rows).astype(np.uint64)
        with np.errstate(over="ignore"):
            half = np.zeros(m.shape[:3], np.uint64)
            for r in range(rows):
                half = mix(half * np.uint64(0x9E3779B97F4A7C15) + m[..., r] + np.uint64(1))
            table = np.arange(bands * bands, dtype=np.uint64).reshape(1, bands, bands) + np.uint64(1)
            both = mix(half[:, 0, :, None] * np.uint64(0xD6E8FEB86659FD93) + half[:, 1, None, :] + mix(table))
        return both.reshape(len(signatures), -1).view(np.int64)

    return keys


def _features(width: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in runs(texts):
                part = batch.slice(lo, hi - lo)
                sets = shingle_sets(texts[lo:hi], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, minhashes([sets[i] for i in full], n), strict=True):
                        sig[i] = row.tobytes()
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                cols = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_shingles", "digest", "sig"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in runs(texts):
                data = [x.tobytes() for x in shingle_sets(texts[lo:hi], width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(data, pa.binary())], ["id", "data"])

    return run


def similar(least: int):
    """Which sets have 100 * intersection >= least * union with a centre."""

    def check(centre: bytes, members: list[bytes]) -> list[bool]:
        a, out = np.frombuffer(centre, np.uint64), []
        for m in members:
            b = np.frombuffer(m, np.uint64)
            if not len(a) or 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
                out.append(False)
                continue
            at = np.searchsorted(a, b)
            both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
            out.append(both > 0 and 100 * both >= least * (len(a) + len(b) - both))
        return out

    return check


def near_duplicates(docs: DataFrame, width: int = 5, least: int = 80, bands: int = 8, rows: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    tables, n = Tables(docs.sparkSession), 2 * bands * rows
    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    every = tables.cut(two.mapInArrow(lean("sets", _features(width, n)), _FEATURES), "features")
    one = every.where("id is not null and digest is not null").groupBy("id").agg(F.min(F.struct("digest", "sig")).alias("d")).select("id", "d.digest", "d.sig")
    # documents with equal sets: their smallest id stands for them
    classes = one.groupBy("digest").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    classes = tables.cut(classes, "classes")
    # of n minhashes, a pair of similarity 0.8 agrees on at least half, but for a chance below 1e-4
    bar = int(np.ceil(n * (least / 100 - 0.31)))

    def score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        equal = (x == y).sum(1)
        return np.where(equal >= bar, equal, 0)

    near = score, np.uint32

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        ids = tables.cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), f"{name}-ids")
        texts = semi(two, ids, "id")
        with_sets = texts.mapInArrow(lean("sets", _sets(width)), "id long, data binary")
        with_sets = with_sets.dropDuplicates(["id"]) if repeated else with_sets
        payload = tables.cut(with_sets, f"{name}-sets")
        edges = tables.cut(verified(pairs, payload, similar(least)), f"{name}-kept")
        tables.drop(f"{name}-sets", f"{name}-ids")
        return edges

    counts = every.where("id is not null and digest is not null").agg(F.count("*")).first()[0]
    repeated = counts != one.count()
    found = link(tables, classes.select("id", "sig"), tensored_keys(bands, rows), near, verify)
    group = classes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    member = tables.cut(one.select("id", "digest").join(group, "digest").select("id", "component"), "members")
    out = every.select("id", "n_shingles").join(member, "id", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
