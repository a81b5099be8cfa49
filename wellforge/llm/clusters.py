"""Similarity clusters: mergeable cluster-feature trees per partition, tree-reduced, Ward-agglomerated, one assignment pass.

A cluster feature (CF) of a set of vectors is (n, sum, sum of squared lengths); features add up. Each partition puts its rows into
a CF tree, groups of partitions merge the leaves of theirs into one until a single set is left, Ward's method joins those leaves on
the driver (at most `max_leaves`, whatever the input), and one pass assigns every vector to its nearest leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellforge.llm.vectors import distinct_vectors, matrix, squared
from wellforge.session import cut, stored


class Node:
    """A node of a CF tree: the features of its entries, and the node below each of them unless it is a leaf."""

    def __init__(self, dim: int):
        self.n, self.ls, self.ss = np.empty(0), np.empty((0, dim)), np.empty(0)
        self.below: list[Node] | None = None

    def extend(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        self.n, self.ls, self.ss = np.append(self.n, n), np.vstack([self.ls, ls]), np.append(self.ss, ss)

    def nearest(self, ls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = squared(ls / n[:, None], self.ls / self.n[:, None])
        to = d.argmin(1)
        return to, d[np.arange(len(to)), to]


class FeatureTree:
    """A CF tree: features go down to the nearest entry of each node; a leaf's entry within `threshold` absorbs them, or they become
    entries of their own, and a node with more than `branch` entries is split along its two farthest ones.

    When there are more than `most` leaf entries, the largest three quarters stay and the others are absorbed by the nearest.
    Raising the threshold instead would join everything at once where distances are all alike, as in many dimensions.
    """

    def __init__(self, dim: int, most: int, threshold: float, branch: int = 48):
        self.dim, self.most, self.threshold, self.branch = dim, most, threshold, branch
        self.root, self.count = Node(dim), 0

    def add(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        for s in range(0, len(n), 512):
            self._grow(n[s : s + 512], ls[s : s + 512], ss[s : s + 512], self.threshold**2)
            if self.count > self.most:
                self._condense()

    def _grow(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, reach: float) -> None:
        self._insert(self.root, n, ls, ss, reach)
        while len(self.root.n) > self.branch:
            top = Node(self.dim)
            top.below = self._split(self.root)
            for part in top.below:
                top.extend(np.array([part.n.sum()]), part.ls.sum(0)[None], np.array([part.ss.sum()]))
            self.root = top

    def _insert(self, node: Node, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, reach: float) -> None:
        if node.below is None:
            self._into_leaf(node, n, ls, ss, reach)
            return
        to, _ = node.nearest(ls, n)
        full = []
        for k in np.unique(to):
            own = to == k
            self._insert(node.below[k], n[own], ls[own], ss[own], reach)
            node.n[k] += n[own].sum()
            node.ls[k] += ls[own].sum(0)
            node.ss[k] += ss[own].sum()
            if len(node.below[k].n) > self.branch:
                full.append(k)
        if full:
            parts = [p for k in full for p in self._split(node.below[k])]
            rest = [k for k in range(len(node.n)) if k not in full]
            node.n, node.ls, node.ss, node.below = node.n[rest], node.ls[rest], node.ss[rest], [node.below[k] for k in rest] + parts
            node.extend(np.array([p.n.sum() for p in parts]), np.array([p.ls.sum(0) for p in parts]), np.array([p.ss.sum() for p in parts]))

    def _into_leaf(self, leaf: Node, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, reach: float) -> None:
        if len(leaf.n):
            to, d = leaf.nearest(ls, n)
            fits = d <= reach
            np.add.at(leaf.n, to[fits], n[fits])
            np.add.at(leaf.ls, to[fits], ls[fits])
            np.add.at(leaf.ss, to[fits], ss[fits])
            n, ls, ss = n[~fits], ls[~fits], ss[~fits]
        if not len(n):
            return
        centre = ls / n[:, None]
        between, free, made = squared(centre, centre), np.ones(len(n), bool), []
        for i in range(len(n)):
            if free[i]:
                take = free & (between[i] <= reach)
                take[i] = True
                made.append((n[take].sum(), ls[take].sum(0), ss[take].sum()))
                free &= ~take
        leaf.extend(np.array([m[0] for m in made]), np.array([m[1] for m in made]), np.array([m[2] for m in made]))
        self.count += len(made)

    def _split(self, node: Node) -> list[Node]:
        """The node's entries in nodes of at most `branch`, each entry with the nearer of the two farthest apart."""
        if len(node.n) <= self.branch:
            return [node]
        centre = node.ls / node.n[:, None]
        one = int(squared(centre, centre.mean(0)[None])[:, 0].argmax())
        to_one = squared(centre, centre[one][None])[:, 0]
        far = squared(centre, centre[int(to_one.argmax())][None])[:, 0] < to_one
        if far.all() or not far.any():  # all alike
            far = np.arange(len(far)) % 2 == 0
        out = []
        for side in (far, ~far):
            part = Node(self.dim)
            part.extend(node.n[side], node.ls[side], node.ss[side])
            if node.below is not None:
                part.below = [node.below[k] for k in np.flatnonzero(side)]
            out += self._split(part)
        return out

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The features of all leaf entries."""
        stack, out = [self.root], []
        while stack:
            node = stack.pop()
            if node.below is None:
                out.append(node)
            else:
                stack += node.below
        return np.concatenate([x.n for x in out]), np.vstack([x.ls for x in out]), np.concatenate([x.ss for x in out])

    def _condense(self) -> None:
        n, ls, ss = self.leaves()
        order = np.argsort(-n, kind="stable")
        kept, rest = order[: self.most * 3 // 4], order[self.most * 3 // 4 :]
        self.root, self.count = Node(self.dim), 0
        for part, reach in ((kept, -1.0), (rest, np.inf)):
            for s in range(0, len(part), 512):
                at = part[s : s + 512]
                self._grow(n[at], ls[at], ss[at], reach)

    def frame(self, part: int) -> pd.DataFrame:
        n, ls, ss = self.leaves()
        return pd.DataFrame({"part": part, "threshold": self.threshold, "n": n, "ls": list(ls), "ss": ss})


_CF = "part long, threshold double, n double, ls array<double>, ss double"


def leaf_features(unique: DataFrame, dim: int, max_leaves: int, threshold: float, fan_in: int = 8) -> pd.DataFrame:
    """At most `max_leaves` leaf features of all vectors (vid, vec), by a tree of merges with `fan_in` inputs each."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = FeatureTree(dim, max_leaves, threshold)
        for b in batches:
            x = matrix(b["vec"], dim)
            leaves.add(np.ones(len(x)), x, (x * x).sum(1))
        if leaves.count:
            yield leaves.frame(TaskContext.get().partitionId())

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        leaves = FeatureTree(dim, max_leaves, float(g["threshold"].max()))
        g = g.sort_values(["n", "ss"], ascending=False)
        leaves.add(g["n"].to_numpy(), matrix(g["ls"], dim), g["ss"].to_numpy())
        return leaves.frame(int(g["part"].iloc[0]) // fan_in)

    level, parts = unique.select("vec").mapInPandas(summarise, _CF), unique.rdd.getNumPartitions()
    while True:
        level = level.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(merge, _CF)
        parts = -(-parts // fan_in)
        if parts <= 1:
            return level.toPandas().sort_values(["n", "ss"], ascending=False, ignore_index=True)
        level = cut(level)


def ward(n: np.ndarray, centres: np.ndarray, height: float | None = None, count: int | None = None, most_rows: float | None = None) -> np.ndarray:
    """Cluster of every leaf: Ward's agglomeration by nearest-neighbour chains, cut below `height` or at `count` clusters, or by
    leaving out every merge that would give a cluster of more than `most_rows` rows.

    The height of a merge is sqrt(2 n m / (n + m)) times the distance of the centres.
    """
    size, c, m = n.astype(float).copy(), centres.astype(float).copy(), len(n)
    alive, merges, chain = np.ones(m, bool), [], []
    while len(merges) < m - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            cost = 2 * size * size[a] / (size + size[a]) * ((c - c[a]) ** 2).sum(1)
            cost[~alive] = np.inf
            cost[a] = np.inf
            b = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
                b = chain[-2]
                break
            chain.append(b)
        merges.append((float(np.sqrt(cost[b])), a, b))
        chain = chain[:-2]
        c[b] = (size[a] * c[a] + size[b] * c[b]) / (size[a] + size[b])
        size[b] += size[a]
        alive[a] = False
    root = np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    merges.sort(key=lambda t: t[0])
    rows = n.astype(float).copy()
    for k, (h, a, b) in enumerate(merges):
        if (height is not None and h > height) or (count is not None and m - k <= count):
            break
        a, b = find(a), find(b)
        if most_rows is None or rows[a] + rows[b] <= most_rows:
            root[a] = b
            rows[b] += rows[a]
    ids: dict[int, int] = {}
    return np.array([ids.setdefault(find(i), len(ids)) for i in range(m)])


@dataclass
class Summary:
    """What is known of all vectors: the leaves' centres and the cluster of each."""

    centres: np.ndarray
    cluster: np.ndarray


def summarise(unique: DataFrame, dim: int, max_leaves: int, threshold: float, clusters: int | None = None, most_rows: float | None = None) -> Summary:
    leaves = leaf_features(unique, dim, max_leaves, threshold)
    if not len(leaves):
        return Summary(np.zeros((1, dim)), np.zeros(1, int))
    n, centres = leaves["n"].to_numpy(), matrix(leaves["ls"], dim) / leaves["n"].to_numpy()[:, None]
    return Summary(centres, ward(n, centres, count=clusters, most_rows=most_rows))


def leaves_for(rows: int, most: int = 8192, rows_each: int = 64) -> int:
    """Leaves grow with the rows, up to the `most` that Ward's method joins on the driver (8192 x 32 numbers are 2 MB)."""
    return max(64, min(most, rows // rows_each))


def assigned(unique: DataFrame, summary: Summary, radius: float) -> DataFrame:
    """The assignment pass: (vid, vec, leaf, cluster, visits).

    `visits` are the clusters of a higher number with a leaf that a vector within `radius` of this one can be nearest to. If y is nearest to
    leaf L and x to leaf H, the plane half-way between H and L parts them; x can only be within `radius` of y if it lies within
    `radius` of that plane, which is (d(x,L)^2 - d(x,H)^2) / (2 d(H,L)) <= radius. The bound loses no pair.
    """
    centres, cluster = summary.centres, summary.cluster
    dim = centres.shape[1]
    step = max(16, 2_000_000 // len(centres))  # rows at once: some matrices of 16 MB, whatever the number of leaves

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = matrix(b["vec"], dim)
            home, visits = np.zeros(len(x), int), []
            for s in range(0, len(x), step):
                d = squared(x[s : s + step], centres)
                own = home[s : s + step] = d.argmin(1)
                d -= d[np.arange(len(own)), own][:, None]
                # distances from the few leaves that are at home here: those of all pairs would be half a GB for 8192
                at, row = np.unique(own, return_inverse=True)
                most = np.sqrt(squared(centres[at], centres)) * (2 * radius * (1 + 1e-9)) + 1e-9
                near = d <= most[row]
                near &= cluster[None, :] > cluster[own][:, None]
                visits += [np.unique(cluster[r]) for r in near]
            yield pd.DataFrame({"vid": b["vid"], "vec": b["vec"], "leaf": home, "cluster": cluster[home], "visits": visits})

    return unique.select("vid", "vec").mapInPandas(place, "vid long, vec array<double>, leaf long, cluster long, visits array<long>")


def _block_links(radius: float, dim: int):
    def link(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vid", ignore_index=True)
        x, vid, home, sub = matrix(g["vec"], dim), g["vid"].to_numpy(), g["home"].to_numpy(), g["sub"].to_numpy()
        n, limit = len(g), radius * radius
        near = np.zeros((n, n), bool)
        for s in range(0, n, 1024):
            rows = slice(s, s + 1024)
            d = squared(x[rows], x)
            ok = d <= limit
            i, j = np.nonzero(np.abs(d - limit) < 1e-9 * max(1.0, limit))
            if len(i):  # on the edge the differences themselves decide
                ok[i, j] = np.sqrt(((x[i + s] - x[j]) ** 2).sum(1)) <= radius
            near[rows] = ok
        # two visitors are compared where one of them is at home
        near &= home[:, None] | home[None, :]
        np.fill_diagonal(near, False)
        label, free = np.arange(n), near.any(1)
        for first in range(n):  # every row is reached once, so a block of equal rows costs no list of its pairs
            if not free[first]:
                continue
            free[first], at = False, np.array([first])
            while len(at):
                at = np.flatnonzero(near[at].any(0) & free)
                free[at], label[at] = False, first
        joined = label != np.arange(n)
        return pd.DataFrame({"a": vid[joined], "b": vid[label[joined]]})

    return link


def links(placed: DataFrame, radius: float, dim: int, block_rows: int = 4096) -> DataFrame:
    """(a, b), a > b: enough links between vectors at most `radius` apart to connect every chain of them.

    Every cluster of leaves is a block of its own vectors and of visitors. A block of more than `block_rows` rows is cut into pieces of half
    as many by id, and each pair of pieces is a task of its own. A task returns one link per vector, to the smallest it is connected with there, not
    all pairs.
    """
    spark = placed.sparkSession
    home = placed.select("vid", "vec", F.col("cluster").alias("block"), F.lit(True).alias("home"))
    guests = placed.select("vid", "vec", F.explode("visits").alias("block"), F.lit(False).alias("home"))
    rows = home.unionByName(guests)
    load = rows.groupBy("block").agg(F.count("*").alias("n")).collect()
    parts = spark.createDataFrame([(r["block"], 1 if r["n"] <= block_rows else -(-2 * r["n"] // block_rows)) for r in load], "block long, parts long")
    split = rows.join(F.broadcast(parts), "block").withColumn("sub", F.pmod(F.xxhash64("vid"), F.col("parts")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("sub")).alias("i"), F.greatest(j, F.col("sub")).alias("j")))
    tasks = split.withColumn("pair", F.explode(pairs)).select("block", "pair", "vid", "vec", "home", "sub")
    return tasks.groupBy("block", "pair").applyInPandas(_block_links(radius, dim), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, root being the smallest of its component.

    Alternating large and small stars: each round links every node to the smallest of its neighbours, until nothing changes.
    Minima are aggregated before the shuffle and joined back, so that no neighbourhood is gathered; each round is checkpointed.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())

    def total(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    seen = total(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        now = cut(small)
        if (after := total(now)) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = after


def chained_groups(points: DataFrame, dim: int, radius: float = 0.7, max_leaves: int | None = None, cluster_rows: int = 256, block_rows: int = 4096) -> DataFrame:
    """(first_id, id): the rows of `points` (id, vec) that chains of steps of at most `radius` join, by their smallest id.

    Rows alone have no row, nor has the smallest of a group. Equal vectors belong together and are linked once, whatever their
    number. Ward's method joins the CF leaves to clusters of up to about `cluster_rows` rows, in which each vector is compared with
    the others and with the few of neighbouring clusters that can be near: an exact check whose cost grows with the rows, as the
    clusters keep their size (beyond 64 `max_leaves` rows, with the rows in a leaf).
    """
    unique = stored(distinct_vectors(points), "unique_vectors")
    leaves = max_leaves or leaves_for(unique.count())
    placed = stored(assigned(unique, summarise(unique, dim, leaves, radius / 2, most_rows=cluster_rows), radius), "placed_vectors")
    root = components(links(placed, radius, dim, block_rows))
    firsts = unique.join(root, unique["vid"] == root["node"], "left").select("vec", F.coalesce("root", "vid").alias("first_id"))
    return points.join(firsts, "vec").filter("id != first_id").select("first_id", "id")


def clusters(points: DataFrame, dim: int, count: int = 50, typical: int = 3, max_leaves: int | None = None, threshold: float = 0.35) -> DataFrame:
    """One row per cluster: cluster, size (rows of `points`), centre, typical (the ids nearest to the centre, ties by id).

    Ward's method gives `count` clusters, or fewer if there are fewer leaves. Empty input gives no rows.
    """
    unique = stored(distinct_vectors(points, typical), "unique_vectors")
    leaves = max_leaves or leaves_for(unique.count())
    placed = assigned(unique, summarise(unique, dim, leaves, threshold, count), 0.0).select("vec", "cluster")
    rows = stored(points.join(placed, "vec").select("id", "vec", "cluster"), "clustered")
    size = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.array(*(F.avg(F.col("vec")[i]) for i in range(dim))).alias("centre"))
    d = F.sqrt(F.aggregate(F.zip_with("vec", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b))
    # as many rows as clusters: bounded by `count`
    ranked = rows.join(F.broadcast(size), "cluster").select("cluster", "size", "centre", "id", d.alias("d"))
    first = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy("d", "id"))).filter(F.col("rn") <= typical)
    return first.groupBy("cluster").agg(F.first("size").alias("size"), F.first("centre").alias("centre"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("typical"))
