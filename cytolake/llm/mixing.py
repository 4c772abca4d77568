"""Mixing sources to target weights by entropy balancing.

Sources in code-point order (null last) weigh 5, 2, 1, 5, ...; a target stops at ``ceiling`` times its source's size and the
excess is shared again by weight. The mix is the set of document rates nearest to 1 in relative entropy that meets every
source's token target with no rate above the ceiling. Its convex dual has one multiplier per source; at the optimum a
document of size z has rate min(ceiling, exp(multiplier * z / scale)), where scale is its source's mean size.

The dual depends on documents only through how many of each size a source has, so one aggregation leaves a histogram of
(source, size), cut to a table. Every Newton iteration is a distributed aggregation of that table into gradient and
curvature per source, joined with the few multipliers; steps that leave the bracket of the root are halved into it. The
driver holds a handful of numbers for each source and nothing per document.

Rates become copies by sequential Poisson rounding: the whole part is kept, and the fractional parts compete by
priority hash(id) / fraction. A histogram of priorities per source (at most ``BINS`` rows) gives the threshold that
meets the source's rest, and at most two documents next to the threshold change sides to meet it closer. No source's
documents meet in one task, whatever its share.

The result depends on ids and sizes only, so reruns agree. Null texts have size 0 and are never taken. A null id is hashed
as 0. Repeated rows with one id get equal copies. An empty table gives an empty result; sources of only empty texts have
target 0.
"""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import Tables

#: The weights that repeat over the sources.
WEIGHTS = (5, 2, 1)
BINS = 1 << 16
NEAR = 200
WORD = r"[^\x20\x09-\x0D]+"
_STATE = T.StructType([T.StructField("src", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("rate", T.DoubleType())])


def words_of(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], ceiling: float = 3.0, weights: tuple = WEIGHTS) -> list[float]:
    """Targets of sources in their order: shares of the sum of all sizes by weight, none above its ceiling."""
    total = sum(n for _, n in sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        share = rest / sum(weight[i] for i in free)
        full = {i for i in free if share * weight[i] > ceiling * sizes[i][1]}
        if not full:
            for i in free:
                out[i] = share * weight[i]
            break
        for i in full:
            out[i] = ceiling * sizes[i][1]
        rest -= sum(out[i] for i in full)
        free -= full
    return out


def _frame(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, _STATE)


def _join(df: DataFrame, state: DataFrame) -> DataFrame:
    """Per-source numbers next to rows: one row for each source is broadcast (their count bounds it)."""
    return df.join(F.broadcast(state), df["src"].eqNullSafe(state["src"]), "inner").drop(state["src"])


def balance(hist: DataFrame, ceiling: float, iterations: int = 60, tolerance: float = 1e-9) -> list[tuple]:
    """(source, size, target, multiplier per word) of every source, by safeguarded Newton steps on the dual."""
    spark = hist.sparkSession
    seen = hist.groupBy("src").agg(F.sum(F.col("z") * F.col("n")).alias("s"), F.sum("n").alias("n")).collect()
    rows = sorted(((r["src"], int(r["s"]), int(r["n"])) for r in seen), key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([(s, size) for s, size, _ in rows], ceiling)
    top = math.log(ceiling)
    # the multiplier is sought in units of the source's mean size: rate = min(ceiling, exp(x * z / mean))
    state = {}
    for (src, size, n), t in zip(rows, goal, strict=True):
        mean = max(1.0, size / max(1, n))
        state[src] = {"size": size, "t": t, "mean": mean, "lo": -1e4 * mean, "hi": top * mean, "x": max(min(math.log(t / size), top), -30.0) if size and t else 0.0, "done": not size or t <= 0 or t >= ceiling * size}
        if t <= 0 and size:
            state[src]["x"] = -1e4 * mean
        elif size and t >= ceiling * size:
            state[src]["x"] = top * mean
    for _ in range(iterations):
        open_ = [(src, 0, 0.0, s["x"] / s["mean"]) for src, s in state.items() if not s["done"]]
        if not open_:
            break
        e = F.exp(F.least(F.col("rate") * F.col("z"), F.lit(top)))
        inner = F.col("rate") * F.col("z") < top
        mass = F.col("n") * F.col("z") * e
        sums = _join(hist, _frame(spark, open_)).groupBy("src").agg(F.sum(mass).alias("g"), F.sum(F.when(inner, mass * F.col("z")).otherwise(0.0)).alias("h"))
        for r in sums.collect():
            s = state[r["src"]]
            miss = r["g"] - s["t"]
            if abs(miss) <= tolerance * max(1.0, s["t"]):
                s["done"] = True
                continue
            s["hi" if miss > 0 else "lo"] = s["x"]
            step = s["x"] - miss / (r["h"] / s["mean"]) if r["h"] > 0 else math.nan
            s["x"] = step if s["lo"] < step < s["hi"] else (s["lo"] + s["hi"]) / 2
            s["done"] = s["hi"] - s["lo"] < 1e-12 * max(1.0, abs(s["x"]))
    return [(src, s["size"], s["t"], s["x"] / s["mean"]) for src, s in state.items()]


def _toggles(chosen: DataFrame, bins: DataFrame, edge: DataFrame) -> list[tuple]:
    """(source, id, +1 or -1): at most two documents of each source, next to its threshold, that bring it closest to its
    target. Only bins of at most ``NEAR`` documents around the threshold are fetched; where those hold more, one
    document no longer matters."""
    far = F.abs(F.col("bin") - F.greatest(F.col("edge"), F.lit(0)))
    at = bins.where("bin is not null").join(F.broadcast(edge), bins["src"].eqNullSafe(edge["src"])).drop(edge["src"]).withColumn("far", far)
    by = Window.partitionBy("src").orderBy("far").rangeBetween(Window.unboundedPreceding, 0)
    reach = at.withColumn("c", F.sum("n").over(by)).where(F.col("c") <= NEAR).groupBy("src").agg(F.max("far").alias("reach"))
    near = chosen.where("bin is not null and doc_id is not null").withColumn("far", far)
    near = near.join(F.broadcast(reach), near["src"].eqNullSafe(reach["src"])).drop(reach["src"]).where("far <= reach")
    held: dict = {}
    for r in near.groupBy("src", "gap", "doc_id", "extra").agg(F.sum("z").alias("z")).collect():
        held.setdefault((r["src"], r["gap"]), []).append((-r["z"] if r["extra"] else r["z"], r["doc_id"]))
    out = []
    for (src, gap), found in held.items():
        found.sort()
        z = np.array([0, *(x for x, _ in found)])
        left = np.abs(gap - (z[:, None] + z[None, :]))
        np.fill_diagonal(left, np.inf)
        left[0, 0] = abs(gap)
        i, j = divmod(int(left.argmin()), len(z))
        out += [(src, found[x - 1][1], 1 if found[x - 1][0] > 0 else -1) for x in (i, j) if x]
    return out


def mix(docs: DataFrame, ceiling: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row (and its columns ``keep``)."""
    spark = docs.sparkSession
    tables = Tables(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("src"), words_of(F.col(text_col)).alias("z"), *keep)
    rows = tables.cut(base, "sizes") if not keep else base
    hist = tables.cut(rows.groupBy("src", "z").agg(F.count("*").alias("n")), "histogram")
    solved = _frame(spark, balance(hist, float(ceiling)))
    rated = _join(rows, solved)
    rate = F.exp(F.least(F.col("rate") * F.col("z"), F.lit(math.log(ceiling))))
    rate = F.when(F.col("z") == 0, 0.0).otherwise(F.least(rate, F.lit(float(ceiling))))
    # a rate within rounding of a whole number is that number
    rated = rated.withColumn("r", F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate))
    rated = rated.withColumn("whole", F.floor("r")).withColumn("part", F.col("r") - F.col("whole"))
    unit = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("mix")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # priority, smaller first; where nothing is fractional a document can still take one more copy, but last
    priority = F.when(F.col("part") > 0, unit / F.col("part")).otherwise(4.0 + unit)
    can = (F.col("whole") < ceiling) & (F.col("z") > 0)
    rated = rated.withColumn("bin", F.when(can, F.least(F.floor(priority * (BINS / 8)), F.lit(BINS - 1)).cast("long")))
    by = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = rated.groupBy("src", "bin", "target").agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("z")).otherwise(0)).alias("m"), F.sum(F.col("whole") * F.col("z")).alias("w"), F.count("*").alias("n"))
    bins = tables.cut(bins, "bins")
    have = bins.groupBy("src", "target").agg(F.sum("w").alias("w"))
    need = have.select("src", (F.col("target") - F.col("w")).alias("need"))
    summed = bins.where("bin is not null").withColumn("c", F.sum("m").over(by))
    summed = summed.join(F.broadcast(need), summed["src"].eqNullSafe(need["src"])).drop(need["src"])
    fits = F.when(F.col("c") <= F.col("need"), F.struct(F.col("bin").alias("bin"), F.col("c").alias("c")))
    edge = summed.groupBy("src", "need").agg(F.max(fits).alias("e"))
    edge = edge.select("src", F.coalesce("e.bin", F.lit(-1)).alias("edge"), (F.col("need") - F.coalesce("e.c", F.lit(0))).alias("gap"))
    edge = tables.cut(edge, "edges")
    chosen = rated.join(F.broadcast(edge), rated["src"].eqNullSafe(edge["src"]), "left").drop(edge["src"])
    extra = F.col("bin").isNotNull() & (F.col("bin") <= F.col("edge"))
    toggles = spark.createDataFrame(_toggles(chosen.withColumn("extra", extra), bins, edge), "t_src string, t_id long, toggle int")
    same = chosen["src"].eqNullSafe(toggles["t_src"]) & (chosen["doc_id"] == toggles["t_id"]) & chosen["bin"].isNotNull()
    chosen = chosen.join(F.broadcast(toggles), same, "left")
    copies = F.col("whole") + F.when(extra, 1).otherwise(0) + F.coalesce("toggle", F.lit(0))
    out = chosen.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", F.col("z").alias("size"), F.col("source_size"), F.col("target"), (F.col("copies") * F.col("z")).alias("taken"), "copies", *keep)


def mixed_documents(docs: DataFrame, ceiling: int = 3) -> DataFrame:
    """The rows of docs, each as often as its copies."""
    names = docs.columns
    kept = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)], F.col("doc_id"), F.col("text"), F.col("source"))
    out = mix(kept, ceiling, keep=[f"__{i}" for i in range(len(names))])
    out = out.where("copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])
