"""Feature tables and quality files on disk: reading with the union of all columns, and writing without a silent overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_features(spark: SparkSession, path: str, glob: str = "*_features*") -> DataFrame:
    """All Parquet feature files below `path` under the union of their columns; `Path` is the file that a row is from."""
    rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).parquet(path)
    return rows.withColumn("Path", F.col("_metadata.file_path"))


def write_features(df: DataFrame, path: str) -> None:
    """Mixed types in one table; an existing path raises."""
    df.write.mode("errorifexists").parquet(path)


def read_quality(spark: SparkSession, path: str, schema: str, glob: str = "*imageqc*", nan_counts: bool = False) -> DataFrame:
    """All CSV quality files below `path`, without rows that hold only keys, in the order of the keys.

    NaN is no value, like null; with `nan_counts` a row that has it stays, as in SQL.
    """
    keys = ["WellIndex", "row", "column", "FOV"]
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).schema(schema).csv(path)
    values = [c for c in rows.columns if c not in keys]
    kept = rows.filter(F.greatest(*(F.col(c).isNotNull() for c in values), F.lit(False))) if nan_counts else rows.na.drop("all", subset=values)
    return kept.orderBy(*keys)


def write_csv(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_segmentation(path: str, details: DataFrame, masks: DataFrame, objects: DataFrame) -> None:
    """The three tables of a segmentation, partitioned by well and field; an existing path raises."""
    for name, df in (("details", details), ("fullmask", masks), ("objects", objects)):
        df.write.mode("errorifexists").partitionBy("WellIndex", "FOV").parquet(f"{path}/{name}")


def read_segmentation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("details", "fullmask", "objects"))


def write_illumination(fields: DataFrame, path: str) -> None:
    """The flat and dark fields of a channel as a table; an existing path raises."""
    fields.write.mode("errorifexists").parquet(path)


def read_illumination(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
