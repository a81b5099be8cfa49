import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wellforge.llm import clusters as c
from wellforge.llm import neighbours as n
from wellforge.llm.vectors import distinct_vectors, usable

SCHEMA = "id long, vec array<double>"


def points(spark, x, first=1):
    return spark.createDataFrame([(i + first, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA)


def brute(ids, x, k):
    out = {}
    for i, a in zip(ids, x):
        d = np.sqrt(((x - a) ** 2).sum(1))
        out[i] = [j for _, j in sorted((dd, j) for dd, j in zip(d, ids) if j != i)][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["distance"], r["neighbour"])):
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


def test_usable_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("inf")]), (None, [1.0, 2.0]), (7, [-0.0, 0.0])]
    df = spark.createDataFrame(rows, "cell_id long, data array<double>").withColumn("id", F.lit("x")).withColumn("vec", F.lit(3))
    assert sorted(r["id"] for r in usable(df, "cell_id", "data", 2).collect()) == [1, 7]


def test_distinct_vectors_keep_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(50, 0, -1)] + [(99, [-0.0, 2.0])], SCHEMA)
    got = {tuple(r["vec"]): r["ids"] for r in distinct_vectors(df, 3).collect()}
    assert got == {(0.0, 1.0): [1, 2, 3], (0.0, 2.0): [99]}


@pytest.mark.parametrize("shard", [40, 1000])
def test_factor_one_is_exact(spark, shard):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(120, 6)), rng.normal(size=(60, 6)) * 0.05 + 2, np.repeat(rng.normal(size=(4, 6)), 20, 0), np.zeros((30, 6))])
    got = found(n.nearest(points(spark, x), 6, 5, 1.0, shard_rows=shard, sample_rows=150))
    assert got == brute(list(range(1, len(x) + 1)), x, 5)


@pytest.mark.parametrize("wave", [1, 4])
def test_shards_one_group_after_another_are_exact(spark, wave):
    x = np.random.default_rng(14).normal(size=(400, 6))
    assert found(n.nearest(points(spark, x), 6, 5, shard_rows=10, sample_rows=400, wave=wave)) == brute(list(range(1, 401)), x, 5)


def test_more_rows_make_larger_shards_before_more_of_them():
    assert [n._shards(r, 16384) for r in (0, 16384, 16385, 97_818, 131_072, 500_000, 3_000_000)] == [1, 1, 2, 6, 8, 8, 32]
    assert n.waves({0: 5, 1: 5, 2: 1, 3: 20, 4: 2}, 11) == [[0, 1, 2], [3], [4]]


def test_repeated_vectors_visit_no_other_shard(spark, monkeypatch):
    loads = []
    monkeypatch.setattr(n, "waves", lambda load, most: loads.append(load) or [])
    x = np.random.default_rng(15).normal(size=(100, 6))
    got = found(n.nearest(points(spark, np.repeat(x, 6, 0)), 6, 5, shard_rows=20, sample_rows=100))
    assert sum(loads[0].values()) < 50  # vectors that lie on the edge of shards
    assert got == brute(list(range(1, 601)), np.repeat(x, 6, 0), 5)


def test_relaxed_search_has_a_recall_of_nine_tenths(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(20, 8)) * 3
    x = centre[rng.integers(0, 20, 600)] + rng.normal(size=(600, 8)) * 0.5
    want = brute(list(range(1, 601)), x, 5)
    got = found(n.nearest(points(spark, x), 8, 5, relax=0.7, shard_rows=80, sample_rows=300))
    assert sum(len(set(want[i]) & set(got.get(i, []))) for i in want) >= 0.9 * 5 * 600


def test_any_number_of_ties_come_by_id(spark):
    x = np.vstack([np.zeros((1, 64)), np.eye(64)])
    assert found(n.nearest(points(spark, x, first=0), 64, 5))[0] == [1, 2, 3, 4, 5]
    grid = np.array([[a, b, c] for a in range(6) for b in range(6) for c in range(6)], float)
    for relax, shard in ((1.0, 1000), (1.0, 40)):
        assert found(n.nearest(points(spark, grid), 3, 5, relax, shard_rows=shard, sample_rows=100)) == brute(list(range(1, 217)), grid, 5)
    flags = np.random.default_rng(3).integers(0, 2, (200, 8)).astype(float)
    assert found(n.nearest(points(spark, flags), 8, 5, shard_rows=60, sample_rows=150)) == brute(list(range(1, 201)), flags, 5)


@pytest.mark.parametrize("relax", [0.7, 0.4])
def test_recall_of_relaxed_search_on_cells(spark, relax):
    cells = usable(spark.read.parquet("/root/testdata/sf0.01/cells.parquet"), "cell_id", "data", 32)
    rows = sorted((r["id"], r["vec"]) for r in cells.collect())
    want = brute([i for i, _ in rows], np.array([v for _, v in rows]), 5)
    got = found(n.nearest(cells, 32, 5, relax=relax, shard_rows=100, sample_rows=800))
    assert sum(len(set(want[i]) & set(got[i])) for i in want) >= 0.98 * 5 * len(want)


def test_few_and_no_rows(spark):
    assert n.nearest(points(spark, []), 3, 5).count() == 0
    assert n.nearest(points(spark, [[1, 2, 3]]), 3, 5).count() == 0
    assert found(n.nearest(points(spark, [[1, 2, 3], [1, 2, 3], [4, 4, 4]]), 3, 5)) == {1: [2, 3], 2: [1, 3], 3: [1, 2]}


def chains(ids, x, radius):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, i in enumerate(ids):
        near = np.flatnonzero(np.sqrt(((x - x[k]) ** 2).sum(1)) <= radius)
        for j in near:
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return sorted((find(i), i) for i in ids if find(i) != i)


@pytest.mark.parametrize("leaves", [4, 64])
def test_chained_groups_against_brute_force(spark, leaves):
    rng = np.random.default_rng(7)
    line = np.cumsum(np.full((40, 4), 0.3), 0) + 10  # a long chain across many leaves
    x = np.vstack([rng.normal(size=(150, 4)) * 3, line, rng.normal(size=(80, 4)) * 0.1, np.repeat(rng.normal(size=(2, 4)), 30, 0)])
    got = c.chained_groups(points(spark, x), 4, 0.7, max_leaves=leaves)
    assert sorted((r["first_id"], r["id"]) for r in got.collect()) == chains(list(range(1, len(x) + 1)), x, 0.7)


def test_links_do_not_depend_on_the_size_of_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    unique = distinct_vectors(points(spark, x))
    placed = c.assigned(unique, c.summarise(unique, 3, 16, 0.35), 0.3)
    results = [sorted(map(tuple, c.components(c.links(placed, 0.3, 3, block_rows=b)).collect())) for b in (20, 4096)]
    assert results[0] == results[1] and results[0]


def peak_of(work):
    tracemalloc.start()
    try:
        result = work()
        return result, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_no_matrix_of_all_leaves_is_held(spark):
    rng = np.random.default_rng(12)
    x, centres = rng.normal(size=(300, 4)), rng.normal(size=(5000, 4))
    summary = c.Summary(centres, np.arange(5000) // 2)
    unique = distinct_vectors(points(spark, x))
    placed, peak = peak_of(lambda: c.assigned(unique, summary, 0.2))
    assert peak < 50
    for r in placed.collect():
        d = ((np.array(r["vec"]) - centres) ** 2).sum(1)
        home = int(d.argmin())
        gap = np.sqrt(((centres - centres[home]) ** 2).sum(1))
        assert r["leaf"] == home
        assert list(r["visits"]) == sorted(set(summary.cluster[(d - d[home] <= 0.4 * gap) & (summary.cluster > summary.cluster[home])]))


def test_a_block_of_near_rows_costs_no_list_of_pairs():
    n = 3000
    rows = pd.DataFrame({"vid": np.arange(n), "vec": list(np.random.default_rng(13).normal(size=(n, 4)) * 0.01), "home": True, "sub": 0})
    linked, peak = peak_of(lambda: c._block_links(0.7, 4)(rows))
    assert peak < 150
    assert list(linked["a"]) == list(range(1, n)) and set(linked["b"]) == {0}


def test_distance_on_the_edge_counts(spark):
    x = [[0.0, 0.0], [0.7, 0.0], [1.4001, 0.0]]
    assert [tuple(r) for r in c.chained_groups(points(spark, x), 2, 0.7).collect()] == [(1, 2)]


def test_cluster_features_add_up(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 5))
    leaves = c.leaf_features(distinct_vectors(points(spark, x)).repartition(20), 5, 32, 0.5)
    assert len(leaves) <= 32
    assert leaves["n"].sum() == 2000
    assert np.allclose(np.vstack(leaves["ls"]).sum(0), x.sum(0))
    assert np.isclose(leaves["ss"].sum(), (x * x).sum())


def test_ward_finds_separate_groups():
    rng = np.random.default_rng(10)
    centre = np.repeat(np.array([[0, 0], [10, 0], [0, 10]]), 15, 0) + rng.normal(size=(45, 2))
    label = c.ward(np.ones(45), centre, count=3)
    assert [len(set(label[i : i + 15])) for i in (0, 15, 30)] == [1, 1, 1] and len(set(label)) == 3
    assert len(set(c.ward(np.ones(45), centre, height=1e9))) == 1


def test_clusters_describe_every_row(spark):
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(3, 4)) * 10, 50, 0) + rng.normal(size=(150, 4)) * 0.2
    got = c.clusters(points(spark, np.vstack([x, x[:20]])), 4, count=3).collect()
    assert sorted(r["size"] for r in got) == [50, 50, 70]
    for r in got:
        centre = np.array(r["centre"])
        members = [i for i in range(170) if np.linalg.norm(np.vstack([x, x[:20]])[i] - centre) < 3]
        d = {i + 1: round(float(np.linalg.norm(np.vstack([x, x[:20]])[i] - centre)), 9) for i in members}
        assert list(r["typical"]) == sorted(d, key=lambda i: (d[i], i))[:3]
    assert c.clusters(points(spark, []), 4).count() == 0
    assert c.chained_groups(points(spark, []), 4).count() == 0
