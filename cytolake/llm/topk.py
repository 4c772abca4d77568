"""Exact top-k search by tiled integer matrix products.

Queries are gathered into blocks, all vectors into shards of blocks. Every query block meets every shard once (an
equi-join on the shard number, so nothing is broadcast); a tile is one matrix product, of which each query keeps its k
best before anything is shuffled; the short lists merge pairwise-by-aggregation up to one list per query.

Components become floor(scale * x). Scores are exact: float64 products are used only where no partial sum can reach
2**53, else 64-bit integers, else Python integers (limited to the 64-bit range).

Null vectors, and vectors with a null or non-finite component, take no part; neither do rows with a null id. Vectors of
different length have no score with each other. Rows with equal ids are one point: none is a candidate for its own id,
and a candidate id that occurs on several rows is listed once for each row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = "dim int, ids binary, rows binary"
_LIMIT = 2**63 - 1


def _blocks(column: str, scale: int, rows: int):
    """Packs rows of (id, vector) into blocks of at most ``rows`` vectors of one length, ids ascending."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int, part: list) -> pa.RecordBatch:
            ids, mat = np.concatenate([x for x, _ in part]), np.concatenate([x for _, x in part])
            order = np.argsort(ids, kind="stable")
            data = [np.int32(dim)], [ids[order].tobytes()], [mat[order].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["dim", "ids", "rows"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            flat = lists.flatten()
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            lengths = np.diff(ends, prepend=0)
            with np.errstate(all="ignore"):
                good = np.isfinite(values)
                whole = np.floor(scale * np.where(good, values, 0.0))
            whole = np.clip(whole, -(2.0**62), 2.0**62).astype(np.int64)
            bad = np.zeros(len(ids), bool)
            bad[np.repeat(np.arange(len(ids)), lengths)[~good]] = True
            for dim in np.unique(lengths[~bad]):
                at = np.flatnonzero(~bad & (lengths == dim))
                mat = whole[(ends[at] - dim)[:, None] + np.arange(dim)[None, :]].reshape(len(at), dim)
                part = held.setdefault(int(dim), [])
                part.append((ids[at], mat))
                while sum(len(x) for x, _ in part) >= rows:
                    full = np.concatenate([x for x, _ in part]), np.concatenate([x for _, x in part])
                    yield block(int(dim), [(full[0][:rows], full[1][:rows])])
                    part[:] = [(full[0][rows:], full[1][rows:])]
        for dim, part in held.items():
            if sum(len(x) for x, _ in part):
                yield block(dim, part)

    return pack


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    bound = int(np.abs(q).max()) * int(np.abs(c).max()) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -_LIMIT, _LIMIT).astype(np.int64)


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores where ``own`` is false, ties to the smaller column."""
    n = scores.shape[1]
    low = np.iinfo(np.int64).min
    scores = np.where(own, low, scores)
    if n > k:
        if np.abs(np.where(own, 0, scores)).max(initial=0) < 2**62 // n:
            keys = np.where(own, low, scores * n + (n - 1 - np.arange(n)))
            cols = np.argpartition(keys, n - k, axis=1)[:, n - k :]
        else:
            cols = np.argsort(-scores.astype(object), axis=1, kind="stable")[:, :k]
    else:
        cols = np.broadcast_to(np.arange(n), scores.shape)
    rows = np.repeat(np.arange(len(scores)), cols.shape[1])
    cols = cols.reshape(-1)
    keep = ~own[rows, cols]
    return rows[keep], cols[keep]


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, qi, qr, ci, cr in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                q_ids, c_ids = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                q = np.frombuffer(qr, np.int64).reshape(len(q_ids), dim)
                c = np.frombuffer(cr, np.int64).reshape(len(c_ids), dim)
                scores = _products(q, c)
                rows, cols = _best(scores, q_ids[:, None] == c_ids[None, :], k)
                out = q_ids[rows], c_ids[cols], scores[rows, cols]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    return run


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    query_rows: int = 256,
    block_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to smaller vec_id."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    points = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    queries = rows.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).dropDuplicates(["id"])
    shards = max(8, spark.sparkContext.defaultParallelism)
    q = queries.repartition(max(1, shards // 4)).mapInArrow(_blocks(vector_col, scale, query_rows), _BLOCK).withColumnsRenamed({"ids": "q_ids", "rows": "q_rows"})
    c = points.mapInArrow(_blocks(vector_col, scale, block_rows), _BLOCK).withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("long"))
    pairs = c.join(q, ["shard", "dim"]).select("dim", "q_ids", "q_rows", "ids", "rows")
    best = pairs.mapInArrow(_tiles(k), "query_id long, vec_id long, score long")
    order = F.struct((-F.col("score")).alias("a"), F.col("vec_id").alias("b"))
    return _merge(best.withColumn("o", order), k)


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """Tree merge: short lists of a query join within salts first, then across salts."""
    top = lambda c: F.slice(F.array_sort(c), 1, k)
    salted = lists.groupBy("query_id", F.pmod(F.hash("vec_id"), F.lit(16)).alias("salt")).agg(top(F.collect_list("o")).alias("l"))
    merged = salted.groupBy("query_id").agg(top(F.flatten(F.collect_list("l"))).alias("l"))
    return merged.select("query_id", F.posexplode("l").alias("p", "o")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("o.b").alias("vec_id"), (-F.col("o.a")).alias("score"))
