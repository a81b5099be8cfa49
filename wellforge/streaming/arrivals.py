"""Files that keep arriving: plate quality and distance scores as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_arrivals(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear below `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(path)


def hourly_scores(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Count, sum and sum of squares of finite distances per Group and hour of measurement, closed once `late` has passed.

    The sums add up over windows and runs; rows that come later than the watermark are left out by Spark.
    """
    d = F.col("miel_distance")
    ok = stream.filter(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))).withColumn("at", F.col("measured_at").cast("timestamp"))
    per = ok.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "Group")
    return per.agg(F.count("*").alias("n"), F.sum(d).alias("total"), F.sum(d * d).alias("squares")).select(F.col("window.start").alias("hour"), "Group", "n", "total", "squares")


def first_deliveries(stream: DataFrame, keys: list[str], at: str, late: str = "2 days") -> DataFrame:
    """The first row of every key; repeats within the watermark are left out."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; files and checkpoint make it exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
