import numpy as np
import pytest
from pyspark.sql import functions as F

from wellforge.sources import tables as t
from wellforge.sources import tiff
from wellforge.streaming import arrivals


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["u1", "u2", "f4"])
def test_tiff_round_trip(order, kind):
    pages = [(np.arange(35).reshape(5, 7) * 900 % 60000 + k).astype(kind) for k in range(3)]
    back = tiff.decode(tiff.encode(pages, order))
    assert len(back) == 3 and all((a == b).all() for a, b in zip(pages, back))


def test_planes_names_and_projection(spark, tmp_path):
    rng = np.random.default_rng(1)
    stack = {}
    for name in ("r01c02f03p01-ch1.tiff", "r01c02f03p02-ch1.tiff", "rBcXX.tiff"):
        stack[name] = rng.integers(0, 60000, (4, 6)).astype("u2")
        (tmp_path / name).write_bytes(tiff.encode([stack[name]], ">"))
    (tmp_path / "broken.tiff").write_bytes(b"II nothing")
    pattern = r"r(\d{2})c(\d{2})f(\d{2})p(\d{2})-(\w+)\."
    planes = tiff.image_table(spark, str(tmp_path), pattern, {"row": 0, "column": 1, "FOV": 2, "zstack": 3, "channel": 4}).cache()
    assert planes.count() == 4 and planes.filter("px IS NULL").count() == 1
    named = planes.filter("channel = 'ch1'")
    assert {(r["row"], r["column"], r["FOV"], r["zstack"], r["WellIndex"]) for r in named.collect()} == {(1, 2, 3, 1, 1002), (1, 2, 3, 2, 1002)}
    top = tiff.projected(named, ["WellIndex", "FOV", "channel"]).first()
    want = np.maximum(stack["r01c02f03p01-ch1.tiff"], stack["r01c02f03p02-ch1.tiff"])
    assert (np.array(top["px"]).reshape(top["height"], top["width"]) == want).all()


def test_features_are_read_under_the_union_of_columns(spark, tmp_path):
    spark.range(3).select("id", F.lit(1.0).alias("a")).write.parquet(str(tmp_path / "x_features_1"))
    spark.range(2).select("id", F.lit("t").alias("b")).write.parquet(str(tmp_path / "y_features_2"))
    got = t.read_features(spark, str(tmp_path), "*.parquet")
    assert set(got.columns) == {"id", "a", "b", "Path"} and got.count() == 5 and got.filter("a IS NULL").count() == 2
    with pytest.raises(Exception):
        t.write_features(spark.range(1).toDF("x"), str(tmp_path / "x_features_1"))


def test_quality_files(spark, tmp_path):
    (tmp_path / "p1_imageqc.csv").write_text("WellIndex,row,column,FOV,m\n1002,1,2,1,0.5\n1001,1,1,1,\n")
    (tmp_path / "other.csv").write_text("WellIndex,row,column,FOV,m\n9,9,9,9,9\n")
    got = t.read_quality(spark, str(tmp_path), "WellIndex int, row int, column int, FOV int, m double").collect()
    assert [tuple(r) for r in got] == [(1002, 1, 2, 1, 0.5)]


def test_quality_rows_with_nan_alone_stay_as_in_the_sql(spark, tmp_path):
    import duckdb
    from oracle import connect

    from wellforge.plans.files import ORACLES, QUERIES

    duckdb.sql("SELECT * FROM (VALUES (1001::INT, 1::INT, 1::INT, 1::INT, 'nan'::DOUBLE, NULL::DOUBLE, NULL::DOUBLE), (1002, 1, 2, 1, NULL, NULL, NULL), (1003, 1, 3, 1, 0.25, 'nan', NULL)) t(\"WellIndex\", \"row\", \"column\", \"FOV\", ch1_percent_max, ch1_percent_median2sd, ch1_loglog_slope)").write_parquet(str(tmp_path / "imageqc.parquet"))
    got = sorted(repr(tuple(r)) for r in QUERIES["quality_files"](spark, str(tmp_path)).collect())
    assert got == sorted(map(repr, connect(str(tmp_path)).execute(ORACLES["quality_files"]).fetchall())) and len(got) == 2


def test_segmentation_and_csv(spark, tmp_path):
    keys = [F.lit(1001).alias("WellIndex"), F.lit(1).alias("FOV")]
    one = spark.range(4).select("id", *keys)
    t.write_segmentation(str(tmp_path / "seg"), one, one, one)
    assert [df.count() for df in t.read_segmentation(spark, str(tmp_path / "seg"))] == [4, 4, 4]
    t.write_csv(one, str(tmp_path / "csv"))
    t.write_csv(one.limit(1), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_streams_give_what_a_batch_gives(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/df_distance.parquet")
    source.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = arrivals.read_arrivals(spark, str(tmp_path / "in"), source.schema, 2)
    arrivals.run_once(arrivals.first_deliveries(stream, ["dist_id"], "measured_at", "10000 days"), str(tmp_path / "first"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "first")).count() == source.select("dist_id").distinct().count()
    stream = arrivals.read_arrivals(spark, str(tmp_path / "in"), source.schema, 100)
    q = arrivals.hourly_scores(stream, "10000 days").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = arrivals.hourly_scores(source).agg(F.sum("n"), F.count("*")).first()
    assert spark.table("hours").agg(F.sum("n"), F.count("*")).first() == batch


def test_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from wellforge import session

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_scratch_is_dropped(spark):
    from pathlib import Path

    from wellforge import session

    stored = session.stored(spark.range(3), "dropped")
    where = Path(session._scratch[-1][1].removeprefix("file:"))
    assert stored.count() == 3 and where.exists()
    kept, session._scratch[:-1] = session._scratch[:-1], []
    assert session.drop_scratch(spark) == 1 and not where.exists()
    session._scratch[:] = kept


def test_planes_of_a_table(spark):
    from wellforge.sources.tiff import decoded, encoded

    images = spark.createDataFrame([("a", [0.5, 1.0, 2.0, 3.0]), ("b", [1.0] * 6)], "path string, px array<double>")
    got = {r["file_path"]: (r["height"], r["width"], list(r["px"])) for r in decoded(encoded(images, 2)).collect()}
    assert got == {"a": (2, 2, [0.5, 1.0, 2.0, 3.0]), "b": (3, 2, [1.0] * 6)}
    assert decoded(spark.createDataFrame([("x", None), ("y", b"no")], "path string, content binary")).filter("px IS NULL").count() == 2
