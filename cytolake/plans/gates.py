"""Queries on gating (part: size, price and brand thresholds as markers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gating as G
from .registry import query, table

EXPRESSION = "(Large | Pricey) & !Eco & Absent & (Odd | !Large)"


@query("""
WITH m AS (SELECT p_partkey, p_size > 25 AS large, p_retailprice > 1200 AS pricey, p_type = 'ECONOMY' AS eco, p_partkey % 2 = 1 AS odd FROM part)
SELECT p_partkey, (large OR pricey) AND NOT eco AND (odd OR NOT large) AS gate FROM m""")
def gating_mask(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 25).alias("Large"), (F.col("p_retailprice") > 1200).alias("Pricey"), (F.col("p_type") == "ECONOMY").alias("Eco"), (F.col("p_partkey") % 2 == 1).alias("Odd"))
    return df.select("p_partkey", G.mask(G.parse(EXPRESSION), df.columns).alias("gate"))
