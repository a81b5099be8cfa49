import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellforge.operators import drift as d

FILES = "file_id long, Path string, name string, columns array<string>, index array<string>, content string, written_at timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, f"/f/{s}/x", s, cols, None, content, DAY + dt.timedelta(hours=h) if h is not None else None) for i, s, h, cols, content in rows], FILES)


def changes(spark, rows):
    return sorted(tuple(r) for r in d.schema_changes(frame(spark, rows)).collect())


def test_assignment_against_brute_force():
    from itertools import permutations
    from random import Random

    rng = Random(3)
    for n in range(1, 6):
        cost = [[rng.random() for _ in range(n)] for _ in range(n)]
        got = d.assign(cost)
        assert sorted(got) == list(range(n))
        assert abs(sum(cost[i][j] for i, j in enumerate(got)) - min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))) < 1e-9


def test_edit_script_of_nested_schemas():
    old = T.StructType().add("id", "long").add("well", T.StructType().add("row", "integer").add("col", "integer")).add("area", "integer").add("note", "string")
    new = T.StructType().add("id", "long").add("Well", T.StructType().add("row", "long").add("col", "integer").add("note", "string")).add("extra", "double")
    same = lambda a, b: 0.0 if d.name_key(a.name) == d.name_key(b.name) else 3.0
    cost, script = d.edit_script(d.tree_of(old), d.tree_of(new), same)
    assert set(script) == {("rename", "well", "Well"), ("retype", "well/row", "Well/row"), ("move", "note", "Well/note"), ("delete", "area", ""), ("add", "", "extra")}
    assert d.edit_script(d.tree_of(old), d.tree_of(old), same) == (0.0, [])


def test_column_kinds():
    assert d.value_kind(["1", "NA", "+2"]) == "integer"
    assert d.value_kind(["1", "2.0"]) == "decimal" and d.value_kind(["1e3", ""]) == "decimal"
    assert d.value_kind(["1,5"]) == "text" and d.value_kind(["#3", "4"]) == "text"
    assert d.value_kind(["", "NaN", "null"]) is None and d.value_kind([]) is None


def test_added_removed_renamed_retyped(spark):
    got = changes(
        spark,
        [
            (1, "s", 0, ["Area", "FOV"], "100\t1\n120\t2"),
            (2, "s", 1, ["FOV", "area_px"], "3\t110"),  # renamed, order is no change
            (3, "s", 2, ["FOV", "area_px", "Tissue"], "NA\t130.5\tliver"),  # added; area becomes decimal; FOV missing
            (4, "s", 3, ["FOV", "area_px"], "2.0\t100.0"),  # removed; FOV against file 2
            (5, "t", 0, ["other"], "1"),  # first of its series
        ],
    )
    assert got == sorted([(2, "renamed", "Area", "area_px"), (3, "added", "", "Tissue"), (3, "retyped", "area_px", "area_px"), (4, "removed", "Tissue", ""), (4, "retyped", "FOV", "FOV")])


def test_added_again_starts_anew(spark):
    got = changes(spark, [(1, "s", 0, ["a1x", "b"], "1\t2"), (2, "s", 1, ["b"], "3"), (3, "s", 2, ["b", "a1x"], "3\tword"), (4, "s", 3, ["b", "a1x"], "3\t5")])
    assert got == [(2, "removed", "a1x", ""), (3, "added", "", "a1x"), (4, "retyped", "a1x", "a1x")]


def test_values_decide_between_unlike_names(spark):
    rows = [(1, "s", 0, ["Tissue", "depth"], "liver\t55.5\nskin\t61.25\nheart\t58.5"), (2, "s", 1, ["organ", "depth"], "liver\t60.5\nheart\t57.25"), (3, "s", 2, ["organ", "count"], "skin\t12345\nliver\t20000")]
    got = changes(spark, rows)
    assert (2, "renamed", "Tissue", "organ") in got
    assert (3, "added", "", "count") in got and (3, "removed", "depth", "") in got


def test_order_by_time_then_id_and_nulls(spark):
    rows = [(9, "s", 1, ["a", "b"], "1\t2"), (3, "s", 1, ["a"], "1"), (7, "s", None, ["a", "c"], "1\tx"), (8, None, 0, None, None)]
    assert changes(spark, rows) == [(3, "removed", "c", ""), (9, "added", "", "b")]


def test_empty_table_and_clashing_columns(spark):
    assert d.schema_changes(spark.createDataFrame([], FILES)).count() == 0
    df = frame(spark, [(1, "s", 0, ["a"], "1"), (2, "s", 1, ["a", "b"], "1\t2")]).withColumns({"series": F.lit("z"), "names": F.lit(1), "pid": F.lit(3), "kind": F.lit("k")})
    assert [tuple(r) for r in d.schema_changes(df).collect()] == [(2, "added", "", "b")]


def test_same_result_however_a_series_is_divided(spark):
    rows = []
    for i in range(120):
        cols = ["a", "b"] if i % 7 < 4 else ["a", "B", "extra"]
        value = "1" if (i // 10) % 2 else "NA" if i % 3 else "1.5"
        rows.append((i, "hot", i, cols, "\t".join([value, "5", "7"][: len(cols)])))
    results = []
    for n in ("1", "5", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        results.append(changes(spark, rows))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert results[0] == results[1] == results[2] and any(r[1] == "retyped" for r in results[0])


def test_unified_table(spark):
    df = frame(spark, [(1, "s", 0, ["Area", "FOV"], "100\t1\n120\tNA"), (2, "s", 1, ["FOV", "area"], "3\t110")]).withColumn("index", F.array(F.lit("o1"), F.lit("o2")))
    q = d.quantity_map(d.schema_changes(df), df)
    got = d.unified_table(df, q)
    assert sorted(got.columns) == ["Area", "FOV", "file_id", "label", "series"]
    assert sorted((r["file_id"], r["label"], r["Area"], r["FOV"]) for r in got.collect()) == [(1, "o1", "100", "1"), (1, "o2", "120", None), (2, "o1", "110", "3")]


def test_two_values_are_enough_for_a_name_that_is_otherwise_unlike(spark):
    rows = [(i, "s", i, ["ecc", "area"], "\n".join(f"-{5 + (i * 7 + k) % 40 / 10:.3f}\t{900 + k}" for k in range(30))) for i in range(5)]
    rows += [(9, "s", 9, ["area", "elongation", "Sample"], "950\t-5.123\tS12\n990\t-6.051\tS7")]
    assert changes(spark, rows) == [(9, "added", "", "Sample"), (9, "renamed", "ecc", "elongation")]


def test_no_value_is_lost_where_a_rename_of_one_series_joins_columns_of_another(spark):
    rows = [(1, "s", 0, ["red", "FOV"], "1\t7"), (2, "s", 1, ["blue", "FOV"], "2\t8"), (3, "t", 0, ["red", "blue", "FOV"], "3\t4\t9\n5\t6\t9")]
    df = frame(spark, rows).withColumn("index", F.array(F.lit("o1"), F.lit("o2")))
    renamed = spark.createDataFrame([(2, "renamed", "red", "blue")], d.CHANGES)
    q = d.quantity_map(renamed, df)
    got = d.unified_table(df, q).collect()
    inside = sorted(sorted(v for k, v in r.asDict().items() if k not in ("file_id", "series", "label") and v is not None) for r in got)
    assert inside == [["1", "7"], ["2", "8"], ["3", "4", "9"], ["5", "6", "9"]]
    in_s = {r["name"]: r["quantity"] for r in q.collect() if r["series"] == "s"}
    assert in_s["red"] == in_s["blue"]


def test_rename_between_columns_of_one_file_is_reported(spark):
    df = frame(spark, [(1, "s", 0, ["red"], "1"), (2, "s", 1, ["blue"], "2"), (3, "s", 2, ["blue", "red"], "3\t4")])
    q = d.quantity_map(spark.createDataFrame([(2, "renamed", "red", "blue")], d.CHANGES), df)
    assert sorted((r["name"], r["quantity"], r["apart"]) for r in q.collect()) == [("blue", "blue", True), ("red", "red", True)]


def test_names_that_differ_by_a_word_are_not_the_same_for_nothing(spark):
    model = d.NameModel({}, {}, {})
    for a, b in (("area_old", "area_new"), ("depth_raw", "depth_um"), ("intensity_au", "intensity")):
        assert model.rename_cost(d.Node(a), d.Node(b)) > 0
    assert model.rename_cost(d.Node("MeanArea"), d.Node("mean_area")) == 0


def test_columns_of_one_quantity_side_by_side_are_both_kept(spark):
    rows = [(1, "s", 0, ["area", "k"], "10\t1\n12\t2"), (2, "s", 1, ["area_old", "area_new", "k"], "11\t7.5\t1"), (3, "s", 2, ["area_new", "k"], "8.5\t2")]
    df = frame(spark, rows)
    table = d.widest_types(d.unified_table(df, d.quantity_map(d.schema_changes(df), df)))
    assert sorted(sum(v is not None for v in r[3:]) for r in table.collect()) == [2, 2, 2, 3]
    assert dict(table.dtypes)["k"] == "bigint"


def test_profiles_of_a_batch_against_one_by_one():
    import pyarrow as pa

    columns = pa.array([["a", "b"], None, [], ["c", None], ["e"]])
    content = pa.array(["1\tx1\n#2.50 mm\tNA\n3", "1\t2", "", "1e3\tword\textra\n-4,25\tword2", None])
    kinds, profiles = d.value_profiles(columns, content)
    assert kinds == ["text", "text", "text", "text", None]
    assert profiles.tolist() == [[3, 3, 6.5, 16.25, 1, 0, 0], [1, 0, 0, 0, 0, 2, 1], [2, 2, 995.75, 1000018.0625, 2, 0, 0], [2, 0, 0, 0, 0, 9, 1], [0] * 7]
