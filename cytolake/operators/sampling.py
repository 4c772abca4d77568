"""Deterministic sampling and splitting: every random choice is an order by a hash of the id, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str, seed: int = 42) -> Column:
    """The order of a seeded shuffle."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def even_sample(df: DataFrame, group: str, key: str, per_group: int, seed: int = 42) -> DataFrame:
    """At most per_group rows of each group; Spark keeps only so many per task and group before the shuffle."""
    w = Window.partitionBy(group).orderBy(shuffled(key, seed), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_group).drop("__r")


def stratified_split(df: DataFrame, group: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``train``: the first max(1, int(n * share)) rows of each group in shuffled order."""
    w = Window.partitionBy(group)
    r, n = F.row_number().over(w.orderBy(shuffled(key, seed), key)), F.count("*").over(w)
    return df.withColumn("train", r <= F.greatest(F.lit(1), F.floor(n * share)))


def kfold(df: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold``: shuffled rows of each group dealt in turn; k shrinks to the rarest group, 2 at least."""
    rarest = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    k = max(2, min(k, rarest or 0))
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(group).orderBy(shuffled(key, seed), key)) - 1) % k).cast("int"))


#: Tier budgets at a sample of 256, and rows per group of each tier.
TIERS = {"fov": (84, 14), "type": (112, 16), "rare": (60, 10)}


def uncertainty_sample(pred: DataFrame, size: int = 256, seed: int = 42, fov: str | None = "fov") -> DataFrame:
    """(id, tier) of a review sample of rows (id, m1, m2, reviewed[, fov]).

    Tiers in turn: fields of view and types by their share of disagreement, rare types by their size, then a random fill.
    A tier takes a few disagreeing rows from each group in rank order until its budget is spent. The field tier, as in the
    practice it follows, does not leave reviewed rows out. Only ranks of groups and budgets exist outside the windows.
    """
    rows = pred.withColumn("differs", (F.col("m1") != F.col("m2")).cast("int")).withColumn("__o", shuffled("id", seed))
    fresh = rows.where(~F.col("reviewed"))
    taken: DataFrame | None = None

    def tier(name: str, pool: DataFrame, group: str, order: Column) -> None:
        nonlocal taken
        budget, each = TIERS[name]
        budget = max(1, round(budget * size / 256))
        ranks = pool.groupBy(group).agg(F.avg("differs").alias("share"), F.count("*").alias("n"))
        ranks = ranks.withColumn("rank", F.row_number().over(Window.orderBy(order, group))).select(group, "rank")
        left = pool.where("differs = 1")
        if taken is not None:
            left = left.join(taken.select("id"), "id", "left_anti")
        few = left.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__o", "id"))).where(F.col("__r") <= each)
        some = few.join(F.broadcast(ranks), group).orderBy("rank", "__r").limit(budget).select("id", F.lit(name).alias("tier"))
        taken = some if taken is None else taken.unionByName(some)

    if fov:
        tier("fov", rows, fov, F.desc("share"))
    tier("type", fresh, "m1", F.desc("share"))
    tier("rare", fresh, "m1", F.asc("n"))
    taken = taken.limit(size)
    rest = fresh.join(taken.select("id"), "id", "left_anti").orderBy("__o", "id").limit(size).select("id", F.lit("fill").alias("tier"))
    order = F.when(F.col("tier") == "fill", 1).otherwise(0)
    return taken.unionByName(rest).orderBy(order, shuffled("id", seed), "id").limit(size)
