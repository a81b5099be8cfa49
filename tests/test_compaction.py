import random

import pytest
from pyspark.sql import functions as F

from wellforge.operators import compaction as c
from wellforge.sources.feature_files import feature_records

FILES = "file_id long, Path string, name string, columns array<string>, index array<string>, content string"
PLANES = "file_id long, plate string, row int, column int, FOV int, zstack int, time int, channel string, checksum string"


def redundant(spark, files, planes=()):
    got = c.redundant_files(spark.createDataFrame(list(files), FILES), spark.createDataFrame(list(planes), PLANES))
    return sorted((r["kind"], r["file_id"]) for r in got.collect())


def test_compaction_keeps_every_row_and_makes_few_even_files(spark, tmp_path):
    df = spark.range(0, 20000, 1, 200).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("sometimes"))
    df = df.union(df.limit(50))
    path = str(tmp_path / "out")
    c.compact(df, path, target_bytes=200_000)
    back = spark.read.parquet(path)
    assert back.count() == 20050 and back.exceptAll(df).count() == 0
    sizes = [r["rows"] for r in c.file_sizes(spark, path).collect()]
    assert 2 <= len(sizes) <= 20 and max(sizes) <= 3 * min(sizes)


def test_hot_clustering_key_is_split(spark, tmp_path):
    df = spark.range(60000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    path = str(tmp_path / "out")
    c.compact(df, path, target_bytes=500_000, cluster_by=("key",))
    assert spark.read.parquet(path).count() == 60000
    rows = [r["rows"] for r in c.file_sizes(spark, path).collect()]
    assert len(rows) > 3 and max(rows) < 20000


def test_empty_input_and_existing_target(spark, tmp_path):
    path = str(tmp_path / "out")
    c.compact(spark.createDataFrame([], FILES), path)
    assert spark.read.parquet(path).count() == 0
    with pytest.raises(FileExistsError):
        c.compact(spark.createDataFrame([], FILES), path)


def test_nothing_is_committed_if_rows_differ(spark, tmp_path, monkeypatch):
    prints = iter([c.Fingerprint(1, 2, 3), c.Fingerprint(1, 2, 4)])
    monkeypatch.setattr(c, "fingerprint", lambda df: next(prints))
    with pytest.raises(ValueError):
        c.compact(spark.range(1).toDF("x"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() and not (tmp_path / "out.staging").exists()


def test_fingerprint_sees_nulls_and_repeats(spark):
    make = lambda rows: c.fingerprint(spark.createDataFrame(rows, "a int, b int"))
    assert make([(None, 1)]) != make([(1, None)])
    assert make([(1, 1)]) != make([(1, 1), (1, 1)])
    assert make([(1, 2), (3, 4)]) == make([(3, 4), (1, 2)])


def test_records_agree_as_numbers_in_any_column_order(spark):
    files = [
        (1, "/f/s/a.h5", "s", ["x", "y"], ["o1", "o2"], "1.0\tNA\n2\tliver"),
        (2, "/f/s/b.h5", None, ["y", "x"], ["o2", "o1"], "liver\t+2.00\n\t1e0"),  # both delivered before, other order and notation
        (3, "/f/s/c.h5", "s", ["x", "y"], ["o1"], "1.5\tNA"),  # corrected
        (4, "/f//s//d.h5", None, ["x", "y"], ["o1", "o9"], "1\tnull\n1\t2"),  # one is new
        (5, "/f/t/e.h5", "t", ["x", "y"], ["o1"], "1.0\tNA"),  # another series
        (6, "/f/s/f.h5", "s", ["x", "y"], [], ""),  # no records
        (7, "/f/s/g.h5", "s", ["x", "y"], ["o1"], None),
        (8, "/f/s/h.h5", "s", ["x", "y"], [], "1.0\tNA"),  # a record without a label
        (None, None, None, None, None, "1"),
    ]
    assert redundant(spark, files) == [("feature", 2)]


def test_images_agree_by_plane_and_checksum(spark):
    planes = [
        (1, "p", 1, 2, 3, 1, 1, "DAPI", "aa"), (2, "p", 1, 2, 3, 1, 1, "dapi", "aa"), (3, "p", 1, 2, 3, 1, 1, "DAPI", "bb"),
        (4, "q", 1, 2, 3, 1, 1, "DAPI", "aa"), (5, None, None, 2, 3, 1, 1, None, None), (6, None, None, 2, 3, 1, 1, None, None),
    ]
    assert redundant(spark, [], planes) == [("image", 2), ("image", 6)]
    assert redundant(spark, []) == []


def test_first_holders_against_brute_force(spark):
    rng = random.Random(1)
    files = []
    for i in range(1, 80):
        n = rng.randint(0, 3)
        lines = [f"{rng.randint(0, 4)}\t{rng.choice(['a', 'NA', ''])}" for _ in range(n)]
        files.append((i, "/x/s/f", "s", ["u", "v"], [f"o{rng.randint(0, 1)}" for _ in lines], "\n".join(lines)))
    seen, want = set(), []
    for fid, *_, labels, content in files:
        keys = {(lab, line.split("\t")[0], line.split("\t")[1].replace("NA", "")) for lab, line in zip(labels, content.split("\n"))} if content else set()
        if keys and keys <= seen:
            want.append(("feature", fid))
        seen |= keys
    assert redundant(spark, files) == want


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "/f/s/a", "s", ["x"], ["o"], "1")], FILES)
    extra = df.withColumns({"series": F.lit("other"), "pos": F.lit(9), "line": F.lit("z"), "label": F.lit("q"), "key": F.lit(1)})
    assert feature_records(extra).collect() == feature_records(df).collect()


def test_very_long_content(spark):
    text = "\n".join(f"{i}\tvalue {i}" for i in range(20000))
    files = [(1, "/f/s/a", "s", ["x", "y"], [str(i) for i in range(20000)], text), (2, "/f/s/b", "s", ["x", "y"], [str(i) for i in range(20000)], text)]
    assert redundant(spark, files) == [("feature", 2)]


def test_thousands_of_real_small_files(spark, tmp_path):
    """Files of a few rows each, compacted by measured Parquet bytes; every row once, few files, and nothing left beside them."""
    rows = spark.range(6000).selectExpr("id", "concat('name ', id % 7) AS name", "CASE WHEN id % 5 = 0 THEN NULL ELSE id / 3 END AS v", "sha2(CAST(id AS STRING), 256) AS body")
    small = str(tmp_path / "small")
    rows.withColumn("part", F.col("id") % 1500).repartition("part").write.partitionBy("part").parquet(small)
    files = c.file_sizes(spark, small)
    assert files.count() == 1500
    df, out = spark.read.parquet(small).drop("part"), str(tmp_path / "out")
    c.compact(df, out, 64 << 10)
    sizes = sorted(r["bytes"] for r in c.file_sizes(spark, out).collect())
    assert 2 <= len(sizes) <= 24 and sizes[-1] <= 4 * (64 << 10) and sum(sizes) / len(sizes) >= (64 << 10) / 4
    assert spark.read.parquet(out).exceptAll(rows).count() == 0 and spark.read.parquet(out).count() == 6000
    assert [x.name for x in tmp_path.iterdir() if "staging" in x.name] == []


def test_records_keep_where_they_come_from(spark):
    df = spark.createDataFrame([(1, "/a/s/f1", None, ["x"], ["k"], "1\n2", None)], "file_id long, Path string, name string, columns array<string>, index array<string>, content string, written_at timestamp_ntz")
    got = c.feature_records(df).collect()
    assert [(r["path"], r["series"], r["label"], r["line"]) for r in got] == [("/a/s/f1", "s", "k", "1"), ("/a/s/f1", "s", None, "2")]
