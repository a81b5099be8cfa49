"""Registered queries on the cells' vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellforge.llm.clusters import chained_groups, clusters
from wellforge.llm.neighbours import nearest
from wellforge.llm.vectors import usable
from wellforge.session import table

DIM = 32


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(table(spark, sf_dir, "cells"), "cell_id", "data", DIM)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(_cells(spark, sf_dir), DIM, k=5)
    return near.select(F.least("id", "neighbour").alias("cell_id_a"), F.greatest("id", "neighbour").alias("cell_id_b")).distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar cells of every usable cell, with the labels of both."""
    cells = table(spark, sf_dir, "cells")
    near = nearest(_cells(spark, sf_dir), DIM, k=5)
    a, b = (cells.select(F.col("cell_id").alias(k), F.col("index").alias(v)) for k, v in (("id", "label"), ("neighbour", "neighbour_label")))
    out = near.join(a, "id").join(b, "neighbour")
    return out.select(F.col("id").alias("cell_id"), "label", F.col("neighbour").alias("neighbour_id"), "neighbour_label", F.round("distance", 6).alias("distance"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained_groups(_cells(spark, sf_dir), DIM, 0.7).select(F.col("first_id").alias("first_cell_id"), F.col("id").alias("cell_id"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(_cells(spark, sf_dir), DIM)


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p3_clusters": p3_clusters}

_USABLE = "SELECT cell_id, data FROM cells WHERE len(data) = 32 AND len(list_filter(data, lambda x: x IS NULL OR isnan(x))) = 0"

ORACLES = {
    "p2_found": f"""
WITH c AS ({_USABLE}),
d AS (SELECT a.cell_id AS a, b.cell_id AS b, list_distance(a.data, b.data) AS d FROM c a JOIN c b ON a.cell_id <> b.cell_id),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM d)
SELECT DISTINCT least(a, b) AS cell_id_a, greatest(a, b) AS cell_id_b FROM r WHERE rn <= 5""",
    "p2_neighbours": f"""
WITH c AS ({_USABLE}),
d AS (SELECT a.cell_id AS a, b.cell_id AS b, list_distance(a.data, b.data) AS d FROM c a JOIN c b ON a.cell_id <> b.cell_id),
r AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM d)
SELECT r.a AS cell_id, x."index" AS label, r.b AS neighbour_id, y."index" AS neighbour_label, round(r.d, 6) AS distance
FROM r JOIN cells x ON x.cell_id = r.a JOIN cells y ON y.cell_id = r.b WHERE rn <= 5""",
    "p3_found": f"""
WITH RECURSIVE c AS ({_USABLE}),
e AS (SELECT a.cell_id AS a, b.cell_id AS b FROM c a JOIN c b ON a.cell_id <> b.cell_id AND list_distance(a.data, b.data) <= 0.7),
w AS (SELECT DISTINCT a AS first_cell_id, a AS cell_id FROM e UNION SELECT w.first_cell_id, e.b FROM w JOIN e ON e.a = w.cell_id)
SELECT min(first_cell_id) AS first_cell_id, cell_id FROM w GROUP BY cell_id HAVING min(first_cell_id) <> cell_id""",
}
