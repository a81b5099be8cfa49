import pytest
from pyspark.sql import functions as F

from wellforge.llm import mixing as m

COUNTED, WEIGHTS = "doc_id long, source string, n_tokens long", "source string, target_weight double, max_repeats int"


def mixed(spark, counted, weights, **options):
    return m.mix(spark.createDataFrame(counted, COUNTED), spark.createDataFrame(weights, WEIGHTS), **options)


def test_tokens_of_a_public_vocabulary(spark):
    texts = ["Hello world", "", None, "密封圈 a1 " * 3, "x" * 100_000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r["n_tokens"] for r in m.token_counts(docs).collect()}
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] > 6 and got[4] > 1000


def test_shares_are_met_to_within_one_record(spark):
    counted = [(i, "big", 90 + i % 21) for i in range(3000)] + [(10_000 + i, "small", 50 + i % 13) for i in range(100)]
    out = mixed(spark, counted, [("big", 0.8, 1), ("small", 0.2, 3)], bucket_rows=64).cache()
    per = {r["source"]: r["t"] for r in out.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    total = int(100 * 56 * 3 / 0.2)
    small = sum(n for _, s, n in counted if s == "small")
    assert per["small"] <= small * 3 and per["small"] > small * 3 - 63
    want = min(small * 3 / 0.2, sum(n for _, s, n in counted if s == "big") / 0.8) * 0.8
    assert want - 111 < per["big"] <= want and total
    assert out.groupBy("doc_id").agg(F.max("use").alias("u"), F.count("*").alias("c")).filter("u <> c").count() == 0
    assert out.filter("source = 'big' AND use > 1").count() == 0


def test_result_does_not_depend_on_buckets_or_partitions(spark):
    counted = [(i, "ab"[i % 2], 1 + i % 17) for i in range(2000)]
    weights = [("a", 0.5, 2), ("b", 0.1, 1)]
    one, two = (sorted(map(tuple, mixed(spark, counted, weights, bucket_rows=b).select("doc_id", "use").collect())) for b in (50, 10**6))
    assert one == two and one


def test_prefix_is_in_hash_order(spark):
    counted = [(i, "s", 10) for i in range(100)]
    out = mixed(spark, counted, [("s", 1.0, 1)], total=333)
    assert out.count() == 33 and sorted(r["upto"] for r in out.collect()) == [10 * (k + 1) for k in range(33)]


def test_sources_without_documents_weight_or_tokens(spark):
    counted = [(1, "a", 10), (2, "a", 0), (3, None, 5), (4, "unweighted", 7), (5, "unlisted", 7), (6, "b", 10), (6, "b", 10), (7, "empty", 0)]
    weights = [("a", 0.3, 2), ("b", 0.3, 1), ("ghost", 0.2, 2), ("unweighted", None, None), ("empty", 0.2, 5), (None, 0.1, 1), ("a", 0.3, 2)]
    w = spark.createDataFrame(weights, WEIGHTS)
    out = mixed(spark, counted, weights)
    assert sorted((r["doc_id"], r["use"]) for r in out.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (6, 1), (6, 1)]
    share = {r["source"]: r["share"] for r in m.shares(out, w).collect()}
    assert share["a"] == share["b"] == 0.5 and share["ghost"] == share["unweighted"] == share["empty"] == 0
    assert mixed(spark, [], weights).count() == 0 and mixed(spark, counted, []).count() == 0


def test_total_beyond_what_is_there(spark):
    plan = {b.source: b for b in m.plan_budgets([("a", 100), ("b", 1000)], [("a", 0.5, 3), ("b", 0.5, 1)], total=2000)}
    assert plan["a"].tokens == 300 and plan["b"].tokens == 1000
    with pytest.raises(KeyError):
        plan["c"]
