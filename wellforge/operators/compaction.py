"""Consolidation of many small files into few files of about even size, and the finding of files that add nothing."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellforge.session import conf, scratch_path
from wellforge.sources.feature_files import feature_records, record_key

TARGET_BYTES = 128 << 20


@dataclass(frozen=True)
class Fingerprint:
    """Checksum of a multiset of rows: order and partitioning do not matter, every lost or doubled row does."""

    rows: int
    total: int
    mixed: int


def _hashable(c: Column, kind: str) -> Column:
    # -0.0 and 0.0, and the encodings of NaN, are normalised by the hash; maps have none and go in as text
    return F.to_json(c) if "map<" in kind else c


def fingerprint(df: DataFrame) -> Fingerprint:
    """Row count, sum of a 64-bit row hash, and sum of a second one, in one aggregation without a shuffle of rows.

    Nulls are marked one by one, since the hash functions skip them and would confuse (null, 1) with (1, null).
    """
    cols = [_hashable(F.col(f"`{c}`"), t) for c, t in df.dtypes]
    marks = [F.col(f"`{c}`").isNull() for c in df.columns]
    first, second = F.xxhash64(F.lit(17), *cols, *marks), F.xxhash64(F.lit(91), *marks, *cols)
    row = df.select(first.alias("a"), second.alias("b")).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.col("a").cast("decimal(20,0)")), F.lit(0)).alias("s"),
        F.coalesce(F.sum(F.col("b").cast("decimal(20,0)")), F.lit(0)).alias("t"),
    ).first()
    return Fingerprint(row["n"], int(row["s"]), int(row["t"]))


def compact(df: DataFrame, path: str, target_bytes: int = TARGET_BYTES, cluster_by: tuple[str, ...] = (), passes: int = 2) -> Fingerprint:
    """Write `df` to `path` as few files of about `target_bytes`, committing only after the rows have been verified.

    The REBALANCE hint shuffles the rows (by `cluster_by`, else round robin) and adaptive execution merges small and splits
    large output partitions, hot clustering keys included. It measures shuffled bytes, which Parquet makes fewer of; so if the files
    come out smaller than half the target or larger than twice, they are balanced once more (at most `passes` passes), at the size
    that the first pass has shown to give the target. The files go to a staging folder of their own beside `path`; when count and
    checksums of the staged rows equal those of `df`, the folder is renamed to `path`: one step on file systems with an atomic
    rename (on an object store, where a rename copies, readers must wait for this function). If they differ, ValueError is raised
    and nothing appears at `path`. An existing `path` raises FileExistsError. An empty `df` gives a folder with a schema and no
    rows. Null columns, repeated rows and long texts count like any other.
    """
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = fs_path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    before, source, advisory, stages = fingerprint(df), df, target_bytes, []
    try:
        while True:
            stages.append(f"{path}.staging-{uuid.uuid4().hex}")
            _balance(source, stages[-1], advisory, cluster_by)
            sizes = [s.getLen() for s in fs.listStatus(fs_path(stages[-1])) if s.getPath().getName().endswith(".parquet")]
            mean = sum(sizes) / max(len(sizes), 1)
            if len(stages) >= passes or not 0 < mean or (mean <= 2 * target_bytes and (len(sizes) == 1 or mean >= target_bytes / 2)):
                break
            advisory = max(1, int(min(advisory * target_bytes / mean, 64 * target_bytes)))
            source = spark.read.schema(df.schema).parquet(stages[-1])
        after = fingerprint(spark.read.schema(df.schema).parquet(stages[-1]))
        if before != after:
            raise ValueError(f"staged rows differ from the source: {before} and {after}")
        if fs.exists(target):  # another writer of this path was faster
            raise FileExistsError(path)
        if not fs.rename(fs_path(stages[-1]), target):
            raise OSError(f"could not commit {path}")
    finally:
        for stage in stages:
            fs.delete(fs_path(stage), True)
    return after


def _balance(df: DataFrame, path: str, advisory: int, cluster_by: tuple[str, ...]) -> None:
    with conf(
        df.sparkSession,
        spark__sql__adaptive__enabled="true",
        spark__sql__adaptive__optimizeSkewsInRebalancePartitions__enabled="true",
        spark__sql__adaptive__advisoryPartitionSizeInBytes=str(advisory),
        spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
    ):
        df.hint("rebalance", *cluster_by).write.parquet(path)


def compacted(df: DataFrame, label: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """`df` read back from a verified compaction in the shared folder."""
    path = scratch_path(df.sparkSession, label)
    compact(df, path, target_bytes)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Rows and bytes of each data file below `path`: file_path, rows, bytes."""
    meta = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("bytes"))
    return meta.groupBy("file_path").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes"))


def _not_first(keyed: DataFrame) -> DataFrame:
    """file_ids of `keyed` (file_id, key columns) that are the smallest of none of their keys.

    A file adds something exactly if it is the first to hold one of its records. So two partial aggregations and one join on
    unique ids suffice: no group is gathered and a key that fills a third of all rows costs one row a task.
    """
    keys = [c for c in keyed.columns if c != "file_id"]
    first = keyed.groupBy(*keys).agg(F.min("file_id").alias("file_id")).select("file_id").distinct()
    return keyed.select("file_id").distinct().join(first, "file_id", "left_anti")


def redundant_files(features: DataFrame, planes: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Files that add nothing: (kind, file_id), from tables that have been compacted first.

    'feature': a file with records, each of which is also in files with a smaller file_id. Records agree if series, label
    and the value of every column agree; numbers compare as numbers, all notations of a missing value alike.
    'image': a file for whose plane and checksum there is a smaller file_id; the channel's case is ignored and nulls agree
    with nulls. Files without records, and null file_ids, are never reported.
    """
    records = compacted(feature_records(features), "feature_records", target_bytes)
    images = compacted(planes, "image_planes", target_bytes)
    keyed = records.select("file_id", record_key(F.col("columns"), F.col("line"), F.col("series"), F.col("label")).alias("key"))
    plane = images.select(
        "file_id", "plate", "row", "column", "FOV", "zstack", "time", F.lower("channel").alias("channel"), "checksum"
    )
    found = [
        _not_first(part.filter(F.col("file_id").isNotNull())).select(F.lit(kind).alias("kind"), "file_id")
        for kind, part in (("feature", keyed), ("image", plane))
    ]
    return found[0].unionByName(found[1])
