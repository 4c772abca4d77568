"""Queries on exports (customer as cells) and on incremental scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..sources import tables as T
from .predicted import _PRED, predictions
from .registry import query
from .spatial import _CELLS, cells


@query(_CELLS + " SELECT image AS Image, CAST(id AS VARCHAR) AS ObjectID, type AS Class, printf('%.2f', x * 2) AS CentroidX, printf('%.2f', y * 2) AS CentroidY, printf('%.2f', x) AS x, 'NA' AS missing FROM cells")
def celltable_export(spark, sf_dir):
    return T.cell_table(cells(spark, sf_dir), ["x", "missing"], pixel=2.0)


@query(_CELLS + " SELECT image AS Image, type AS Label, printf('%.2f', x) AS CentroidX, printf('%.2f', y) AS CentroidY, x FROM cells WHERE id % 3 = 0")
def groundtruth_roundtrip(spark, sf_dir):
    c = cells(spark, sf_dir)
    return T.ground_truth_rows(c, c.where("id % 3 = 0").select("image", "id", F.col("type").alias("label")), ["x"])


@query(_PRED + ", c AS (SELECT m1, m2, count(*) AS n FROM pred GROUP BY 1, 2) SELECT m1 AS true, m2 AS predicted, n AS count, printf('%.6f', n / sum(n) OVER (PARTITION BY m1)) AS row_normalised FROM c")
def confusion_export(spark, sf_dir):
    return T.confusion_rows(L.confusion(predictions(spark, sf_dir), "m1", "m2"))
