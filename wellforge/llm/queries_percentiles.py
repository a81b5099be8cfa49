"""Registered queries on percentiles of distances and of cell features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellforge.llm.percentiles import percentiles, summarise
from wellforge.session import table

PERCENTS = (0.05, 0.25, 0.5, 0.75, 0.95)


def distance_values(df: DataFrame) -> DataFrame:
    """(kind, key, v): both distances of every row per Group, per Sample and per day."""
    groups = {"group": F.col("Group"), "sample": F.col("Sample"), "day": F.to_date("measured_at").cast("string")}
    one = [F.struct(F.lit(f"{g}_{m}").alias("kind"), k.alias("key"), F.col(m).alias("v")) for g, k in groups.items() for m in ("miel_distance", "miel_orthogonal")]
    return df.select(F.explode(F.array(*one)).alias("x")).select("x.*")


def feature_values(cells: DataFrame) -> DataFrame:
    """(kind, key, v): each element of `data` per WellIndex, numbered from 0."""
    return cells.select("WellIndex", F.posexplode("data").alias("i", "v")).select(F.concat(F.lit("data_"), "i").alias("kind"), F.col("WellIndex").cast("string").alias("key"), "v")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance_values(table(spark, sf_dir, "df_distance")).unionByName(feature_values(table(spark, sf_dir, "cells")))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(_values(spark, sf_dir), PERCENTS)


def p5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combinable counts themselves."""
    return summarise(_values(spark, sf_dir))


QUERIES = {"p5_percentiles": p5_percentiles, "p5_summary": p5_summary}

_VALUES = """
d AS (SELECT g || '_' || m AS kind, CASE g WHEN 'group' THEN "Group" WHEN 'sample' THEN "Sample" ELSE CAST(CAST(measured_at AS DATE) AS VARCHAR) END AS key,
             CASE m WHEN 'miel_distance' THEN miel_distance ELSE miel_orthogonal END AS v
      FROM df_distance, (VALUES ('group'), ('sample'), ('day')) t(g), (VALUES ('miel_distance'), ('miel_orthogonal')) u(m)),
e AS (SELECT 'data_' || (generate_subscripts(data, 1) - 1) AS kind, CAST("WellIndex" AS VARCHAR) AS key, unnest(data) AS v FROM cells),
x AS (SELECT * FROM d UNION ALL SELECT * FROM e)"""

ORACLES = {
    "p5_percentiles": f"""
WITH {_VALUES},
r AS (SELECT kind, key, v, row_number() OVER w AS rn, count(*) OVER (PARTITION BY kind, key) AS n FROM x WHERE v IS NOT NULL AND NOT isnan(v)
      WINDOW w AS (PARTITION BY kind, key ORDER BY v)),
p AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS p)
SELECT kind, key, p, n, v + 0.0 AS value, 0.0::DOUBLE AS error FROM r, p WHERE rn = greatest(1, ceil(round(p * n, 9))::BIGINT)"""
}
