"""Queries of the core's two data problems: many small files, and drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellforge.operators.compaction import compacted, redundant_files
from wellforge.operators.drift import quantity_map, schema_changes, unified_table, widest_types
from wellforge.session import cut, stored, table
from wellforge.sources.feature_files import feature_records


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundant_files(table(spark, sf_dir, "feature_files"), table(spark, sf_dir, "file_information"))


def p1_compacted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compacted feature records and image planes hold: kind, rows, how many files they are of, and the sum of their ids."""
    out = []
    for kind, rows in (("feature", feature_records(table(spark, sf_dir, "feature_files"))), ("image", table(spark, sf_dir, "file_information"))):
        whole = compacted(rows, f"compact_{kind}")
        out.append(whole.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.countDistinct("file_id").alias("of_files"), F.sum("file_id").alias("id_sum")))
    return out[0].unionByName(out[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "feature_files"))


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "feature_files")
    return stored(unified_table(files, quantity_map(cut(schema_changes(files)), files)), "unified")


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all feature files in one consistent table, each column in its widest type."""
    return widest_types(_unified(spark, sf_dir))


def p4_table_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and values of each file in the consistent table, and the sum of its whole numbers: nothing is lost or doubled."""
    one = _unified(spark, sf_dir)
    cells = F.array(*(F.col(f"`{c}`") for c in one.columns[3:]))
    whole = F.filter(cells, lambda x: x.rlike("^[0-9]{1,9}$"))
    per = one.select("file_id", F.size(F.filter(cells, lambda x: x.isNotNull())).alias("v"), F.aggregate(whole, F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("s"))
    return per.groupBy("file_id").agg(F.count("*").alias("records"), F.sum("v").alias("values"), F.sum("s").alias("whole_sum"))


QUERIES = {"p1_found": p1_found, "p1_compacted_files": p1_compacted_files, "p4_found": p4_found, "p4_table": p4_table, "p4_table_values": p4_table_values}

ORACLES = {
    "p1_found": r"""
WITH files AS (
  SELECT file_id, coalesce(name, list_filter(string_split("Path", '/'), lambda x: x <> '')[-2]) AS series, columns, "index" AS labels,
         string_split(content, chr(10)) AS lines
  FROM feature_files WHERE content <> ''),
records AS (SELECT file_id, series, columns, labels, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM files),
cells AS (
  SELECT file_id, series, labels[pos] AS label, pos, unnest(columns) AS col, unnest(string_split(line, chr(9))) AS v FROM records),
keyed AS (
  SELECT file_id, series, label, pos, list(col || chr(1) || CASE WHEN v IN ('', 'NA', 'NaN', 'null') THEN 'm'
      WHEN regexp_matches(v, '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'n' || (CAST(v AS DOUBLE) + 0.0)
      ELSE 't' || v END ORDER BY col, v) AS body
  FROM cells GROUP BY ALL),
firsts AS (SELECT file_id, min(file_id) OVER (PARTITION BY series, label, body) AS first_id FROM keyed),
planes AS (
  SELECT file_id, min(file_id) OVER (PARTITION BY plate, "row", "column", "FOV", zstack, "time", lower(channel), checksum) AS first_id
  FROM file_information)
SELECT 'feature' AS kind, file_id FROM firsts GROUP BY file_id HAVING bool_and(first_id < file_id)
UNION ALL SELECT 'image' AS kind, file_id FROM planes WHERE first_id < file_id""",
    "p4_table_values": r"""
WITH files AS (SELECT file_id, columns, string_split(content, chr(10)) AS lines FROM feature_files WHERE content <> ''),
records AS (SELECT file_id, columns, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM files),
cells AS (SELECT file_id, pos, unnest(string_split(line, chr(9))) AS v, generate_subscripts(string_split(line, chr(9)), 1) AS k, len(columns) AS n FROM records),
kept AS (SELECT file_id, pos, CASE WHEN v NOT IN ('', 'NA', 'NaN', 'null') AND k <= n THEN v END AS v FROM cells)
SELECT file_id, count(DISTINCT pos) AS records, count(v) AS "values", coalesce(sum(CASE WHEN regexp_matches(v, '^[0-9]{1,9}$') THEN CAST(v AS BIGINT) ELSE 0 END), 0)::BIGINT AS whole_sum FROM kept GROUP BY 1""",
    "p1_compacted_files": r"""
SELECT 'feature' AS kind, sum(n)::BIGINT AS "rows", count(*) AS of_files, sum(n * file_id)::BIGINT AS id_sum FROM (SELECT file_id, len(string_split(content, chr(10))) AS n FROM feature_files WHERE content <> '')
UNION ALL SELECT 'image', count(*), count(DISTINCT file_id), sum(file_id)::BIGINT FROM file_information""",
}
