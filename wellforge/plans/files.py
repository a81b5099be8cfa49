"""Queries that go through files: tables are written as many files to the shared folder, read with the sources, and come out as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellforge.functions.arrays import doubles
from wellforge.operators import objects
from wellforge.operators.compaction import compact, file_sizes
from wellforge.session import scratch_path, table
from wellforge.sources import tables as src
from wellforge.sources.tiff import decoded, encoded, projected

PARTS = 200


def _many_files(df: DataFrame, label: str, parts: int = PARTS, file_format: str = "parquet") -> str:
    """The rows in up to `parts` folders by a hash of them all, a file each: the state that compaction starts from."""
    path = scratch_path(df.sparkSession, label)
    rows = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    writer = rows.repartition("_part").write.partitionBy("_part")
    writer.option("header", True).csv(path) if file_format == "csv" else writer.parquet(path)
    return path


def feature_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature files with unlike columns, read under the union of them."""
    cells = table(spark, sf_dir, "cells")
    path = scratch_path(spark, "features")
    src.write_features(cells.filter("cell_id % 2 = 0").select("cell_id", "WellIndex", "MOR_object_pixel_count"), f"{path}/even_features")
    src.write_features(cells.filter("cell_id % 2 = 1").select("cell_id", "index", "Ch1_TXT_TAS_1_10"), f"{path}/odd_features")
    rows = src.read_features(spark, path, "*.parquet")
    return rows.select("cell_id", "WellIndex", "MOR_object_pixel_count", "index", "Ch1_TXT_TAS_1_10")


def quality_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality tables of single plates as CSV files, read without the rows that hold only keys."""
    columns = ["WellIndex", "row", "column", "FOV", "ch1_percent_max", "ch1_percent_median2sd", "ch1_loglog_slope"]
    path = _many_files(table(spark, sf_dir, "imageqc").select(*columns), "imageqc", 50, "csv")
    schema = "WellIndex int, row int, column int, FOV int, ch1_percent_max double, ch1_percent_median2sd double, ch1_loglog_slope double"
    rows = src.read_quality(spark, path, schema, "*.csv", nan_counts=True)
    return rows.select(*columns[:4], *(F.round(c, 6).alias(c) for c in columns[4:]))


def plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image as the content of a TIFF file, decoded, and the planes of each group projected to their largest pixels."""
    images = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("/planes/"), "label", F.lit("/"), "vec_id", F.lit(".tif")).alias("path"), doubles(F.col("embedding")).alias("px"))
    stored = scratch_path(spark, "planes")
    encoded(images, 8).write.parquet(stored)
    planes = decoded(spark.read.parquet(stored)).withColumn("label", F.element_at(F.split("file_path", "/"), -2).cast("int"))
    return projected(planes, ["label"]).select("label", "height", "width", F.posexplode("px").alias("k", "v")).select("label", "height", "width", "k", F.round("v", 6).alias("v"))


def segmentation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmented images written as the three tables of a segmentation and read back: pixels and objects of each well and field."""
    images = table(spark, sf_dir, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("px"))
    masks = objects.segment(images, "vec_id", "px", 8, 0.05).select(F.col("id").alias("vec_id"), (F.col("id") % 7).alias("WellIndex"), (F.col("id") % 3).alias("FOV"), "labels")
    labelled = masks.select("vec_id", "WellIndex", "FOV", F.explode("labels").alias("label")).filter("label > 0")
    path = scratch_path(spark, "segmentation")
    src.write_segmentation(path, masks.select("WellIndex", "FOV", "vec_id"), masks, labelled.groupBy("vec_id", "WellIndex", "FOV", "label").agg(F.count("*").alias("pixel_count")))
    details, full, found = src.read_segmentation(spark, path)
    per = found.groupBy("WellIndex", "FOV").agg(F.count("*").alias("objects"), F.sum("pixel_count").alias("pixels"))
    return details.groupBy("WellIndex", "FOV").agg(F.count("*").alias("images")).join(per, ["WellIndex", "FOV"]).join(full.groupBy("WellIndex", "FOV").agg(F.sum(F.size("labels")).cast("bigint").alias("all_pixels")), ["WellIndex", "FOV"])


def illumination_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat and dark field of each label, written as a table and read back."""
    images = table(spark, sf_dir, "embeddings").select("label", doubles(F.col("embedding")).alias("px"))
    path = scratch_path(spark, "illumination")
    src.write_illumination(objects.illumination(images, ["label"], "px"), path)
    return src.read_illumination(spark, path).select("label", "k", F.round("flat", 6).alias("flat"), F.round("dark", 6).alias("dark"))


def compacted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance scores in up to 200 files, compacted to files of about 256 kB: rows, distinct ids, and whether the files are few and even."""
    rows = table(spark, sf_dir, "df_distance").select("dist_id", "Group", "Sample", "WellIndex", "bootstrap", "miel_distance", "miel_orthogonal")
    small = spark.read.parquet(_many_files(rows, "small_files")).drop("_part")
    path = scratch_path(spark, "compacted")
    compact(small, path, 256 << 10)
    sizes = file_sizes(spark, path)
    whole = spark.read.parquet(path)
    totals = whole.agg(F.count("*").alias("rows"), F.countDistinct("dist_id").alias("ids"), F.sum("dist_id").alias("id_sum"))
    total = F.sum("bytes")
    even = sizes.agg((F.count("*") <= 2 * F.ceil(total / (256 << 10)) + 1).alias("few"), (F.max("bytes") <= 4 * (256 << 10)).alias("none_large"))
    return totals.crossJoin(F.broadcast(even)).select("rows", "ids", "id_sum", "few", "none_large")


QUERIES = {f.__name__: f for f in (feature_tables, quality_files, plane_files, segmentation_tables, illumination_table, compacted_rows)}

ORACLES = {
    "feature_tables": """SELECT cell_id, CASE WHEN cell_id % 2 = 0 THEN "WellIndex" END AS "WellIndex", CASE WHEN cell_id % 2 = 0 THEN "MOR_object_pixel_count" END AS "MOR_object_pixel_count",
CASE WHEN cell_id % 2 = 1 THEN "index" END AS "index", CASE WHEN cell_id % 2 = 1 THEN "Ch1_TXT_TAS_1_10" END AS "Ch1_TXT_TAS_1_10" FROM cells""",
    "quality_files": """SELECT "WellIndex", "row", "column", "FOV", round(ch1_percent_max, 6) AS ch1_percent_max, round(ch1_percent_median2sd, 6) AS ch1_percent_median2sd, round(ch1_loglog_slope, 6) AS ch1_loglog_slope
FROM imageqc WHERE ch1_percent_max IS NOT NULL OR ch1_percent_median2sd IS NOT NULL OR ch1_loglog_slope IS NOT NULL""",
    "plane_files": """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INT AS k FROM embeddings)
SELECT label, 8 AS height, 8 AS width, k, round(max(v), 6) AS v FROM p GROUP BY label, k""",
    "segmentation_tables": """WITH RECURSIVE p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INT AS k FROM embeddings), o AS (SELECT vec_id, k, k // 8 AS r, k % 8 AS c FROM p WHERE v > 0.05),
w AS (SELECT vec_id, k, k AS root FROM o UNION SELECT b.vec_id, b.k, w.root FROM w JOIN o a ON a.vec_id = w.vec_id AND a.k = w.k JOIN o b ON b.vec_id = a.vec_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE w.root < b.k),
m AS (SELECT vec_id, k, min(root) AS object FROM w GROUP BY 1, 2), n AS (SELECT (vec_id % 7)::INT AS "WellIndex", (vec_id % 3)::INT AS "FOV", count(DISTINCT (vec_id, object)) AS objects, count(*) AS pixels FROM m GROUP BY 1, 2)
SELECT "WellIndex", "FOV", count(*) AS images, any_value(objects) AS objects, any_value(pixels) AS pixels, count(*) * 64 AS all_pixels FROM embeddings e JOIN n ON n."WellIndex" = e.vec_id % 7 AND n."FOV" = e.vec_id % 3 GROUP BY 1, 2""",
    "illumination_table": """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INT AS k FROM embeddings), q AS (SELECT label, k, median(v) AS m, quantile_cont(v, 0.05) AS dark FROM p GROUP BY 1, 2)
SELECT label, k, round(m / avg(m) OVER (PARTITION BY label), 6) AS flat, round(dark, 6) AS dark FROM q""",
    "compacted_rows": """SELECT count(*) AS "rows", count(DISTINCT dist_id) AS ids, sum(dist_id)::BIGINT AS id_sum, true AS few, true AS none_large FROM df_distance""",
}
