import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellforge.functions import arrays as a
from wellforge.functions import images as im
from wellforge.functions import text as tx
from wellforge.operators import objects as ob
from wellforge.operators import projections as pr
from wellforge.operators import sampling as sa
from wellforge.operators import scores as sc
from wellforge.operators import tables as tb


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], " ,".join(f"{k} {'array<double>' if isinstance(v, list) and v and isinstance(v[0], float) else 'array<int>' if isinstance(v, list) else 'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("text,days", [("B01-31-2020_D03-02-2021", 396), ("12 days", 12), ("3day", 3), ("B13-31-2020_D03-02-2021", None), ("old", None), (None, None)])
def test_ages(spark, text, days):
    assert one(spark, tx.age_days(F.col("t")), t=text) == days


@pytest.mark.parametrize("text,passes", [("12", True), ("1.5", True), ("1a2", True), ("-5", True), ("", True), ("1e10", True), ("-1.5", False), (" 1", False), ("a", True), ("ab", False)])
def test_texts_that_pass_for_numbers(spark, text, passes):
    assert one(spark, tx.is_float(F.col("t")), t=text) is passes


def test_reordering_and_wells(spark):
    assert one(spark, tx.reordered(F.col("v"), F.array(F.lit(3), F.lit(0), F.lit(1))), v=[5, 6, 7, 8]) == [7, 8, 5]
    assert one(spark, tx.padded_well(F.lit(3), F.lit(100)), t="x") is None and one(spark, tx.padded_well(F.lit(3), F.lit(7)), t="x") == 307


def test_square_of_pixels(spark):
    px = [1.0 if r < 10 and c < 10 else 0.0 for r in range(20) for c in range(20)]
    df = spark.createDataFrame([(1, px), (2, [0.0] * 400)], "id long, px array<double>")
    got = {r["id"]: r["tas"] for r in ob.adjacency_features(df, "id", "px", 20, (3,)).collect()}
    assert got[1] == [0, 0, 0, 0.04, 0, 0.32, 0, 0, 0.64] and got[2] == [0.0] * 9
    bits = [int(v) for v in px]
    assert math.isclose(one(spark, ob.roundness(F.col("b"), 20), b=bits), 4 * math.pi * 100 / 20**2)
    assert im.feature_name("Ch1", 1, 40, 2) == "Ch1_TXT_TAS_12_40" and im.feature_name("Ch1", 3, 0, 8) == "Ch1_TXT_TAS_36"


def test_exact_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.5), 10 ** rng.uniform(0, 6, 1000)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    for p in (0.0, 0.1, 0.5, 0.77, 0.9, 1.0):
        for gather in (10**6, 40):
            assert math.isclose(sa.exact_quantile(df, F.col("x"), p, gather), float(np.quantile(x, p)), rel_tol=1e-12)
    assert sa.exact_quantile(df.filter("x IS NULL"), F.col("x"), 0.5) is None
    assert sa.within_size(df.filter("x IS NULL"), "x").count() == 0


def test_cube_of_voxels(spark):
    px = [1.0 if z < 10 and r < 10 and c < 10 else 0.0 for z in range(12) for r in range(12) for c in range(12)]
    tas = ob.adjacency_features(spark.createDataFrame([(1, px)], "id long, px array<double>"), "id", "px", 12, (3,), height=12).first()["tas"]
    assert {k: round(v, 9) for k, v in enumerate(tas) if v} == {26: 0.512, 17: 0.384, 11: 0.096, 7: 0.008}
    same = ob.resized_volume(spark.createDataFrame([(1, px)], "id long, px array<double>"), "id", "px", (12, 12, 12), (12, 12, 12)).first()["px"]
    assert np.allclose(same, px)


def test_chance_of_an_f_value(spark):
    assert math.isclose(1 - sa.f_test_p(spark.range(1), 3.0, 2, 8), 0.8934, abs_tol=1e-4)


def test_adjacency_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 30))
    df = spark.createDataFrame([(1, [float(v) for v in x.ravel()])], "id long, px array<double>")
    mean = x[x > 0].mean()
    got = {(r["mode"], r["percent"]): r["tas"] for r in ob.adjacency_features(df, "id", "px", 30).collect()}
    for (mode, pct), tas in got.items():
        p = pct / 100
        b = {0: (x >= mean * (1 - p)) & (x < mean * (1 + p)), 1: x >= mean * (1 - p), 2: x >= mean * (1 + p), 3: x >= mean}[mode]
        pad = np.pad(b, 1).astype(int)
        n = sum(np.roll(np.roll(pad, i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)[1:-1, 1:-1]
        want = [float((n[b] == k).mean()) if b.any() else 0.0 for k in range(9)]
        assert np.allclose(tas, want)
    assert len(got) == 28


def test_power_rings_against_fft(spark):
    x = np.random.default_rng(3).normal(size=(8, 8))
    df = spark.createDataFrame([(1, [float(v) for v in x.ravel()])], "id long, px array<double>")
    power = np.abs(np.fft.fftshift(np.fft.fft2(x))) ** 2
    u = np.arange(-4, 4)
    k = np.floor(np.hypot(u[:, None], u[None, :]) + 0.5)
    for r in ob.power_rings(df, "id", "px", 8).collect():
        want = power[k == r["k"]].mean() * math.pi * ((r["k"] + 0.5) ** 2 - (r["k"] - 0.5) ** 2)
        assert math.isclose(r["power"], want, rel_tol=1e-9)


@pytest.mark.parametrize("metric", a.METRICS)
def test_distances_are_symmetric_and_zero_on_themselves(spark, metric):
    x, y = [1.0, 2.0, -3.0, 0.5], [0.5, 2.0, 4.0, 1.0]
    ab, ba, aa = (one(spark, a.distance(F.col("x"), F.col("y"), metric), x=p, y=q) for p, q in ((x, y), (y, x), (x, x)))
    assert math.isclose(ab, ba) and ab > 0 and abs(aa) < 1e-12


def test_query_distances_sent_or_joined(spark):
    x, df = cloud(spark, 60, 3)
    want = np.linalg.norm(x[:, None] - x[None], axis=2)
    for sent in (1000, 1):
        got = sc.query_distances(df, df.filter("id % 20 = 0"), block=2, sent_rows=sent, salts=5).collect()
        assert len(got) == 180 and all(abs(r["d"] - want[r["i"], r["j"]]) < 1e-9 for r in got)


def test_hyperbolic_distance_on_a_ray(spark):
    assert math.isclose(one(spark, a.hyperbolic_distance(F.lit(3.0), F.lit(1.0), F.lit(0.5), F.lit(1.0)), t="x"), 2.5, rel_tol=1e-9)
    with pytest.raises(ValueError):
        a.distance(F.col("x"), F.col("y"), "unknown")


def test_bins_are_disjoint_and_full(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 7).cast("string")).alias("g"))
    got = sa.bins(df, ["g"], ["id"], 20, seed=1)
    assert got.filter("g IS NULL").count() == 0 and got.count() == got.select("id").distinct().count()
    assert {r["count"] for r in got.groupBy("g", "bin").count().collect()} == {20}
    left = df.filter("g IS NOT NULL").groupBy("g").agg((F.floor(F.count("*") / 20) * 20).alias("n")).agg(F.sum("n")).first()[0]
    assert got.count() == left
    again = sa.bins(df.repartition(17), ["g"], ["id"], 20, seed=1)
    assert got.exceptAll(again).count() == 0


def test_positions_number_every_row_once(spark):
    df = spark.range(5000).select("id", F.lit("one").alias("g"))
    got = sa.positions(df, ["g"], [sa.hashed(0, F.col("id")), F.col("id")], ranges=64).select("pos").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(5000))


def test_zscore_and_thresholds(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (None, 5.0), (float("nan"), 5.0)], "x double, c double")
    z = [r for r in sa.zscored(df, ["x", "c"]).collect()]
    x = np.array([1, 2, 4.0])
    assert np.allclose([r["x"] for r in z[:3]], (x - x.mean()) / x.std()) and all(r["c"] == 0 for r in z)
    assert sa.within_size(df, "x", "values", 1.0, 4.0).count() == 1


def test_line_fit_and_otsu(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (2 + 3 * F.col("id") + F.sin("id")).alias("y"))
    r = sa.line_fit(df, "x", "y").first()
    x = np.arange(50.0)
    y = 2 + 3 * x + np.sin(x)
    m, b = np.polyfit(x, y, 1)
    sse = ((y - m * x - b) ** 2).sum()
    assert np.allclose([r["slope"], r["intercept"], r["sse"]], [m, b, sse]) and math.isclose(r["aic"], 50 * math.log(2 * math.pi * sse / 50) + 6 + 50)
    three = spark.createDataFrame([(float(v),) for v in np.concatenate([np.random.default_rng(1).normal(m, 1, 200) for m in (0, 20, 50)])], "x double")
    low, high = sa.multi_otsu(three, "x", 3)
    assert 2 < low < 17 and 22 < high < 47
    assert sa.multi_otsu(three.filter("x IS NULL"), "x") == []


def test_auc_is_the_share_of_ordered_pairs(spark):
    rng = np.random.default_rng(4)
    s, y = np.round(rng.normal(size=300), 1), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(v), int(k)) for v, k in zip(s, y)], "score double, label int")
    want = np.mean([(p > q) + 0.5 * (p == q) for p in s[y == 1] for q in s[y == 0]])
    assert math.isclose(sc.auc(df).first()["auc"], want)
    assert math.isclose(sc.auc(df.withColumn("score", F.exp("score"))).first()["auc"], want)
    perfect = spark.createDataFrame([(1.0, 0), (2.0, 0), (4.0, 1), (9.0, 1)], "score double, label int")
    assert sc.best_threshold(perfect) == 3.0 and sc.auc(perfect).first()["auc"] == 1.0
    assert sc.auc(perfect.filter("label = 1")).first()["auc"] is None


def test_segments_illumination_and_sizes(spark):
    px = [[1, 1, 0, 1], [0, 0, 0, 1], [1, 0, 1, 0]]
    df = spark.createDataFrame([(1, [float(v) for r in px for v in r]), (2, [0.0] * 12)], "id long, px array<double>")
    got = {r["id"]: list(r["labels"]) for r in ob.segment(df, "id", "px", 4, 0.5).collect()}
    assert got == {1: [1, 1, 0, 4, 0, 0, 0, 4, 9, 0, 11, 0], 2: [0] * 12}
    grown = {r["id"]: r["px"] for r in ob.resized(df, "id", "px", 4, 5, 7).collect()}
    assert grown[1][0] == 1 and grown[1][1] == 1 and grown[1][5] == 0.5 and grown[1][7] == 0.5 and grown[1][34] == 0
    flat = ob.illumination(df.filter("id = 1").select("px", F.lit("a").alias("g")), ["g"], "px").orderBy("k").collect()
    assert math.isclose(sum(r["flat"] for r in flat), 12)


def test_axis_model(spark):
    rows = [(0, s, [float(s), 0.0, 1.0]) for s in range(4)] + [(1, s, [10.0 + s, 0.0, 1.0]) for s in range(4)]
    df = spark.createDataFrame(rows, "g int, s int, v array<double>")
    m = sc.fit_axis(df, "s", "g", "v", 3, 0, 1)
    got = df.select("g", m.score(F.col("v")).alias("x"), m.orthogonal(F.col("v")).alias("o"), m.predict(F.col("v")).alias("p")).collect()
    assert all(abs(r["o"]) < 1e-9 and r["p"] == (r["g"] == 1) for r in got) and math.isclose(got[4]["x"] - got[0]["x"], 10)
    with pytest.raises(ValueError):
        sc.fit_axis(df, "s", "g", "v", 3, 0, 7)


def test_platemap_join_reports_missing_and_repeated_wells(spark):
    cells = spark.createDataFrame([(1001, 5), (1002, 6)], "WellIndex int, x int")
    ok = spark.createDataFrame([(1001, "a"), (1002, "b")], "WellIndex int, Sample string")
    assert tb.with_platemap(cells, ok).columns == ["WellIndex", "Sample", "x"]
    for bad in (ok.filter("WellIndex = 1001"), ok.union(ok.limit(1))):
        with pytest.raises(ValueError):
            tb.with_platemap(cells, bad)
    with pytest.raises(ValueError):
        tb.with_group(cells, ["nope"])


def test_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (2.0, 3.0, float("nan"))], "a double, b double, c double")
    assert tb.drop_empty_columns(df).columns == ["a", "b"] and tb.drop_empty_columns(df, "any").columns == ["a"]
    with pytest.raises(ValueError):
        tb.drop_empty_columns(df, "some")


def cloud(spark, n=400, dim=6, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim)) * 6
    x = centre[np.arange(n) % 4] + rng.normal(size=(n, dim))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def test_components_against_numpy(spark):
    x, df = cloud(spark)
    p = pr.principal_components(df, "vec", 6, 3)
    value = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(p.variance, value[:3]) and np.allclose(p.ratio, value[:3] / value.sum())
    s = np.array([r["s"] for r in df.select("id", p.apply(F.col("vec")).alias("s")).orderBy("id").collect()])
    assert np.allclose(s.mean(0), 0, atol=1e-9) and np.allclose(np.cov(s.T), np.diag(value[:3]), atol=1e-8)


def test_independent_components_unmix(spark):
    rng = np.random.default_rng(6)
    source = np.stack([np.sign(rng.normal(size=3000)) * rng.random(3000), rng.laplace(size=3000), rng.random(3000)], 1)
    x = source @ rng.normal(size=(3, 3)).T
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    p = pr.independent_components(df, "vec", 3, 3)
    got = (x - p.mean) @ p.axes.T
    match = np.abs(np.corrcoef(got.T, source.T)[:3, 3:])
    assert (match.max(1) > 0.95).all()


def test_landmark_scaling_keeps_distances(spark):
    x, df = cloud(spark, dim=2)
    placed = pr.fit_landmarks(df, "vec", 2, landmarks=60).place(df, "id", "vec").orderBy("id").collect()
    y = np.array([r["position"] for r in placed])
    assert np.allclose(np.linalg.norm(x[:50, None] - x[None, :50], axis=2), np.linalg.norm(y[:50, None] - y[None, :50], axis=2), atol=1e-6)


def test_scaling_query_uses_all_rows_where_vectors_repeat(spark, monkeypatch):
    from wellforge.plans import vectors as plans

    x = np.zeros((900, 64))
    x[:300, 0], x[300:600, 1], x[600:, :2] = 3.0, 4.0, [3.0, 4.0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, vec array<double>")
    monkeypatch.setattr(plans, "vectors", lambda spark, sf_dir: df)
    y = np.array([[r["mds1"], r["mds2"]] for r in plans.mds_positions(spark, "").orderBy("vec_id").collect()], dtype=float)
    some = list(range(0, 900, 50))
    assert np.allclose(np.linalg.norm(x[some][:, None] - x[some][None], axis=2), np.linalg.norm(y[some][:, None] - y[some][None], axis=2), atol=1e-5)


def test_group_quantiles_of_a_hot_group_against_the_exact_aggregate(spark):
    rng = np.random.default_rng(9)
    rows = [("hot", float(v)) for v in np.round(rng.normal(size=6000), 2)] + [("few", 3.0), ("one", 1.5), ("one", None), ("none", float("nan")), (None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["p"]): r["value"] for r in sa.group_quantiles(df, ["g"], "x", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    want = {r["g"]: r["q"] for r in df.filter("NOT isnan(x)").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.9, 1.0)))).alias("q")).collect()}
    assert got == {(g, p): v for g, q in want.items() for p, v in zip((0.0, 0.25, 0.5, 0.9, 1.0), q)}


def test_running_sums_are_cut_where_the_scores_are(spark):
    from wellforge.operators import scores as sc

    values = [float(i % 50) / 1000 for i in range(4000)] + [1e6, -1e6]
    scored = spark.createDataFrame([(v + i * 1e-9, i % 2) for i, v in enumerate(values)], "score double, label int")
    per = scored.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    run = sc._running(per, keep_piece=True).groupBy("_piece").agg(F.count("*").alias("n")).collect()
    sizes = sorted(r["n"] for r in run)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    last = sc._running(per).orderBy("score").first()
    assert (last["tp"], last["fp"]) == (2001, 2001)


def test_bootstrap_options(spark):
    df = spark.createDataFrame([(g, i, float(i)) for g, n in (("a", 5), ("b", 30)) for i in range(n)], "g string, id int, x double")
    own = sa.bootstrap(df, ["g"], ["id"], ["x"], "original", 3, F.count, seed=1)
    assert sorted({(r["g"], r["x"]) for r in own.collect()}) == [("a", 5), ("b", 30)]
    with pytest.raises(ValueError):
        sa.bootstrap(df, ["g"], ["id"], ["x"], 10, 3, small="raise")
    assert sa.bootstrap(df, ["g"], ["id"], ["x"], 10, 3).count() == 6


def test_plate_and_channels_that_do_not_fit_raise(spark):
    from wellforge.operators import tables as ta

    wide = spark.createDataFrame([(1, 1, 2.0), (1, 30, 3.0)], "Row int, Column int, v double")
    with pytest.raises(Exception, match="column"):
        ta.plate(wide, F.col("v")).collect()
    assert ta.plate(wide, F.col("v"), columns=(1, 30)).first()["c30"] == 3.0
    files = spark.createDataFrame([("A",), ("a",), ("b",)], "channel string")
    with pytest.raises(ValueError, match="channel"):
        ta.check_channels(files)
    ta.check_channels(files.unionByName(spark.createDataFrame([("B",)], "channel string")))


def test_curve_analysis_of_a_fit(spark):
    x = np.arange(1.0, 13.0)
    y = 2 * np.exp(0.3 * x) + 0.5 + np.sin(x)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    rows = {r["term"]: r for r in sa.curve_anova(df, sa.exponential(F.col("x"), 2.0, 0.3, 0.5), "y", 3).collect()}
    fit = 2 * np.exp(0.3 * x) + 0.5
    sse, ssr = ((fit - y) ** 2).sum(), ((fit - y.mean()) ** 2).sum()
    assert math.isclose(rows["residual"]["sum_sq"], sse, rel_tol=1e-9) and math.isclose(rows["treatment"]["f"], ssr / 2 / (sse / 9), rel_tol=1e-9)
    assert math.isclose(rows["treatment"]["p_value"], (1 + 2 * rows["treatment"]["f"] / 9) ** -4.5, rel_tol=1e-6, abs_tol=1e-12)
    assert math.isclose(rows["treatment"]["r2"], 1 - sse / (y**2).sum(), rel_tol=1e-9)


def test_folded_angles_stay_at_their_place(spark):
    from wellforge.functions.arrays import folded

    point = [2.0, 7.0, -1.0, 9.5]
    got = spark.createDataFrame([(point,)], "p array<double>").select(folded(F.col("p")).alias("f")).first()["f"]
    place = lambda v: [v[0] * math.cos(v[1]), v[0] * math.sin(v[1]) * math.cos(v[2]), v[0] * math.sin(v[1]) * math.sin(v[2]) * math.cos(v[3]), v[0] * math.sin(v[1]) * math.sin(v[2]) * math.sin(v[3])]
    assert np.allclose(place(got), place(point)) and all(0 <= a <= math.pi for a in got[1:3]) and 0 <= got[3] < 2 * math.pi


def test_one_large_plane(spark):
    rng = np.random.default_rng(2)
    px = rng.normal(size=1024 * 1024)
    df = spark.createDataFrame([(1, px.tolist()), (2, None), (3, [])], "id long, px array<double>")
    tas = {(r["id"], r["mode"], r["percent"]): sum(r["tas"]) for r in ob.adjacency_features(df, "id", "px", 1024).collect()}
    assert len(tas) == 3 * 28 and all(math.isclose(v, 1.0) for (i, _, _), v in tas.items() if i == 1) and all(v == 0 for (i, _, _), v in tas.items() if i > 1)
    assert ob.power_rings(df, "id", "px", 1024).count() == 512
    assert ob.projected_pixels(df.select(F.lit("s").alias("s"), "px"), ["s"], "px").count() == 1024 * 1024


def test_signed_distance_against_all_pairs():
    rng = np.random.default_rng(4)
    mask = rng.random((7, 9)) < 0.5
    at = np.stack(np.meshgrid(range(7), range(9), indexing="ij"), -1).reshape(-1, 2)
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    flat = mask.ravel()
    want = np.array([(1 if m else -1) * d[i][flat != m].min() for i, m in enumerate(flat)]).reshape(7, 9)
    assert np.allclose(im.signed_distance(mask), want)
    assert (im.signed_distance(np.ones((2, 3), bool)) == 5).all() and (im.signed_distance(np.zeros((2, 3), bool)) == -5).all()


def test_shapes_between_planes(spark):
    small, large = np.zeros((9, 9), int), np.zeros((9, 9), int)
    small[4, 4], large[1:8, 1:8] = 1, 1
    df = spark.createDataFrame([(1, np.stack([small, large]).ravel().tolist()), (2, None)], "id long, labels array<int>")
    got = {r["id"]: r["labels"] for r in ob.interpolated_labels(df, "id", "labels", 9, 9, (5, 9, 9)).collect()}
    sizes = np.array(got[1]).reshape(5, 81).sum(1)
    assert sizes[0] == 1 and sizes[-1] == 49 and (np.diff(sizes) >= 0).all()
