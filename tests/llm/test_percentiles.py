import math
import random

from pyspark.sql import functions as F

from wellforge.llm import percentiles as p

SCHEMA = "kind string, key string, v double"
PERCENTS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def brute(rows):
    groups = {}
    for kind, key, v in rows:
        if v is not None and v == v:
            groups.setdefault((kind, key), []).append(v)
    return {(k, g, q): (len(v), sorted(v)[max(1, math.ceil(round(q * len(v), 9))) - 1]) for (k, g), v in groups.items() for q in PERCENTS}


def got(df):
    return {(r["kind"], r["key"], r["p"]): (r["n"], r["value"]) for r in df.collect()}


def sample():
    rng = random.Random(4)
    rows = [("a", None if i % 11 == 0 else f"g{i % 5}", rng.choice([rng.gauss(0, 1), rng.gauss(50, 1e-3), 7.0, -0.0, 10 ** rng.uniform(-300, 300), None, float("nan")])) for i in range(4000)]
    rows += [("b", "hot", float(i % 3)) for i in range(3000)] + [("c", "one", 5.0), ("c", "none", None), ("c", "ends", float("inf")), ("c", "ends", float("-inf")), ("c", "ends", 1.0)]
    rows += [("d", "close", 1.0 + k * 2.0**-52) for k in range(40)]
    return rows


def test_exact_percentiles(spark):
    rows = sample()
    out = p.percentiles(spark.createDataFrame(rows, SCHEMA), PERCENTS)
    assert got(out) == brute(rows)
    assert out.filter("error <> 0").count() == 0


def test_error_bound_holds(spark):
    rows = [("a", "g", random.Random(2).uniform(0, 1) * 0 + i / 997) for i in range(5000)]
    want = brute(rows)
    out = p.percentiles(spark.createDataFrame(rows, SCHEMA), PERCENTS, max_error=0.05).collect()
    assert all(abs(r["value"] - want["a", "g", r["p"]][1]) <= r["error"] + 1e-12 and r["error"] <= 0.05 for r in out)
    assert any(r["error"] > 0 for r in out)


def test_summaries_of_parts_combine(spark):
    df = spark.createDataFrame(sample(), SCHEMA).cache()
    parts = [p.summarise(df.filter(F.pmod(F.xxhash64("v"), F.lit(3)) == k)) for k in range(3)] + [p.summarise(df.filter("v IS NULL"))]
    whole = p.summarise(df)
    both = p.combine(parts)
    assert both.exceptAll(whole).count() == 0 and whole.exceptAll(both).count() == 0
    assert got(p.percentiles(df, PERCENTS, summary=both)) == brute(sample())


def test_cells_keep_the_order(spark):
    rng = random.Random(3)
    x = sorted([0.0, 1.0, 2.0, -1.0, 1e-310, -1e-310, float("inf"), float("-inf"), 1.9999999999999998, *(rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200) for _ in range(3000))])
    cells = [r["c"] for r in spark.createDataFrame([(v,) for v in x], "v double").coalesce(1).select(p.cell_of(F.col("v")).alias("c")).collect()]
    assert cells == sorted(cells)


def test_empty_table_and_clashing_columns(spark):
    assert p.percentiles(spark.createDataFrame([], SCHEMA), PERCENTS).count() == 0
    df = spark.createDataFrame([("a", "k", 1.0)], SCHEMA).withColumns({"cell": F.lit("x"), "n": F.lit(1), "low": F.lit(2)})
    assert got(p.percentiles(df, (0.5,))) == {("a", "k", 0.5): (1, 1.0)}
