"""The k most similar vectors for every vector: vantage-point trees per shard, pruned by the triangle inequality.

A routing tree, itself a vantage-point tree fitted on a bounded sample, divides all vectors into shards. Each shard builds its
own tree over all its vectors. A vector is first searched in its home shard; the k-th distance found there is the radius of a
ball, and only shards that the ball can reach are searched as well.

`relax` is the factor of the pruning rule: a branch is left out if the query lies further than relax * radius behind the branch's
boundary. Factor 1 is exact; smaller factors visit fewer branches and shards and may miss neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellforge.llm.vectors import distinct_vectors, matrix, squared
from wellforge.session import stored

VISITORS = 131_072  # of one task

SLACK = 1 + 1e-9  # distances come from matrix products; the ball is widened by far more than their rounding


def rounding(*rows: np.ndarray) -> float:
    """What a squared distance between these rows may be off by, in matrix products."""
    return 1e-13 * max([1.0, *(float((x * x).sum(1).max()) for x in rows if len(x))])


@dataclass
class VpNode:
    """A vantage point with the median distance to it; a leaf has rows instead."""

    rows: np.ndarray | None = None
    point: np.ndarray | None = None
    radius: float = 0.0
    near: VpNode | None = None
    far: VpNode | None = None
    label: int = -1


def build(data: np.ndarray, leaf: int, rng: np.random.Generator) -> VpNode:
    """A balanced tree: the rows nearest to the vantage point go near, the other half far, ties by position."""

    def grow(rows: np.ndarray) -> VpNode:
        if len(rows) <= leaf:
            return VpNode(rows=rows)
        picks = rng.choice(rows, min(8, len(rows)), replace=False)
        probe = rng.choice(rows, min(128, len(rows)), replace=False)
        spread = np.sqrt(squared(data[picks], data[probe])).std(1)
        point = data[picks[int(spread.argmax())]]
        d = np.sqrt(squared(point[None], data[rows])[0])
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        radius = float(d[order[half - 1]])
        return VpNode(point=point, radius=radius, near=grow(rows[order[:half]]), far=grow(rows[order[half:]]))

    return grow(np.arange(len(data)))


def _label(tree: VpNode) -> int:
    """Number the leaves from the left; returns how many there are."""
    stack, n = [tree], 0
    while stack:
        node = stack.pop()
        if node.rows is not None:
            node.label, node.rows, n = n, np.empty(0, int), n + 1
        else:
            stack += [node.far, node.near]
    return n


def route(tree: VpNode, q: np.ndarray) -> np.ndarray:
    """The leaf of every row of `q`."""
    out = np.zeros(len(q), int)

    def go(node: VpNode, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.rows is not None:
            out[at] = node.label
            return
        inside = np.sqrt(squared(node.point[None], q[at])[0]) <= node.radius
        go(node.near, at[inside])
        go(node.far, at[~inside])

    go(tree, np.arange(len(q)))
    return out


def reach(tree: VpNode, q: np.ndarray, ball: np.ndarray, relax: float) -> list[np.ndarray]:
    """The leaves that each row's ball can reach."""
    rows, leaves = [], []
    off = np.sqrt(rounding(q))

    def go(node: VpNode, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.rows is not None:
            rows.append(at)
            leaves.append(np.full(len(at), node.label))
            return
        gap = np.sqrt(squared(node.point[None], q[at])[0]) - node.radius
        b = ball[at] * relax * SLACK + off
        go(node.near, at[gap <= b])
        go(node.far, at[-gap <= b])

    go(tree, np.arange(len(q)))
    if not rows:
        return [np.empty(0, int)] * len(q)
    r, v = np.concatenate(rows), np.concatenate(leaves)
    order = np.lexsort((v, r))
    return np.split(v[order], np.searchsorted(r[order], np.arange(1, len(q))))


class Best:
    """The `keep` nearest rows so far of each query."""

    def __init__(self, n: int, keep: int, k: int, ball: np.ndarray | None, off: float):
        self.d = np.full((n, keep), np.inf)
        self.i = np.full((n, keep), -1)
        self.k, self.off = k, off
        self.cap = np.full(n, np.inf) if ball is None else ball**2 * SLACK + off

    def radius2(self, at: np.ndarray) -> np.ndarray:
        return np.minimum(self.d[at, self.k - 1], self.cap[at])

    def offer(self, at: np.ndarray, d: np.ndarray, rows: np.ndarray) -> None:
        keep = self.d.shape[1]
        closer = d.min(1) <= self.radius2(at) * SLACK + self.off
        if not closer.all():
            at, d = at[closer], d[closer]
        if not len(at):
            return
        d = np.maximum(d, 0)
        if d.shape[1] > keep:
            part = np.argpartition(d, keep - 1, axis=1)[:, :keep]
            d, cand = np.take_along_axis(d, part, 1), rows[part]
        else:
            cand = np.broadcast_to(rows, d.shape)
        d = np.concatenate([self.d[at], d], 1)
        cand = np.concatenate([self.i[at], cand], 1)
        order = np.argsort(d, axis=1, kind="stable")[:, :keep]
        self.d[at], self.i[at] = np.take_along_axis(d, order, 1), np.take_along_axis(cand, order, 1)


def search(tree: VpNode, data: np.ndarray, q: np.ndarray, k: int, keep: int, relax: float, ball: np.ndarray | None) -> Best:
    """The `keep` nearest rows of `data` for each row of `q`; branches beyond the k-th distance, or the ball, are pruned."""
    best = Best(len(q), keep, k, ball, rounding(data, q))
    off = np.sqrt(best.off)
    # |q|^2 - 2 q.x + |x|^2 as one product
    left = np.hstack([-2 * q, np.ones((len(q), 1)), (q * q).sum(1)[:, None]])
    right = np.hstack([data, (data * data).sum(1)[:, None], np.ones((len(data), 1))])

    def go(node: VpNode, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.rows is not None:
            points = right[node.rows].T
            for s in range(0, len(at), 512):
                part = at[s : s + 512]
                best.offer(part, left[part] @ points, node.rows)
            return
        gap = np.sqrt(squared(node.point[None], q[at])[0]) - node.radius
        for first, second, sign in ((node.near, node.far, -1.0), (node.far, node.near, 1.0)):
            mine = (gap <= 0) if sign < 0 else (gap > 0)
            own, g = at[mine], sign * gap[mine]
            if ball is not None:
                own_first = own[-g <= np.sqrt(best.radius2(own)) * relax * SLACK + off]
            else:
                own_first = own
            go(first, own_first)
            go(second, own[g <= np.sqrt(best.radius2(own)) * relax * SLACK + off])

    go(tree, np.arange(len(q)))
    return best


def within(tree: VpNode, data: np.ndarray, q: np.ndarray, radius2: float) -> np.ndarray:
    """The rows of `data` within the squared radius of one vector, however many there are."""
    out, stack, radius = [], [tree], float(np.sqrt(radius2)) * SLACK + np.sqrt(rounding(data))
    while stack:
        node = stack.pop()
        if node.rows is not None:
            d = ((data[node.rows] - q) ** 2).sum(1)
            out.append(node.rows[d <= radius2])
            continue
        gap = float(np.sqrt(((node.point - q) ** 2).sum())) - node.radius
        if gap <= radius:
            stack.append(node.near)
        if -gap <= radius:
            stack.append(node.far)
    return np.concatenate(out) if out else np.empty(0, int)


def ranked(tree: VpNode, data: np.ndarray, ids: list[np.ndarray], q: np.ndarray, best: Best, take: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distances and ids of the `take` nearest rows of each query, by recomputed distance and id.

    Where the rows kept end within rounding of the k-th distance, more may lie at it: those queries look again for all rows there.
    """
    d = np.sqrt(((q[:, None, :] - data[best.i]) ** 2).sum(2))
    d[~np.isfinite(best.d)] = np.inf
    edge = np.minimum(best.d[:, best.k - 1], best.cap) * SLACK + best.off
    tied = np.isfinite(best.d[:, -1]) & (best.d[:, -1] <= edge)
    single = all(len(x) == 1 for x in ids)
    distances, neighbours = [], []
    if single:
        flat = np.array([x[0] for x in ids], dtype=np.int64)
        names = flat[best.i]
        order = np.lexsort((names, d), axis=1)[:, :take]
        d_first, names_first = np.take_along_axis(d, order, 1), np.take_along_axis(names, order, 1)
    for i in range(len(q)):
        if single and not tied[i]:
            few = np.isfinite(d_first[i])
            distances.append(d_first[i][few])
            neighbours.append(names_first[i][few])
            continue
        rows = within(tree, data, q[i], float(edge[i])) if tied[i] else best.i[i][np.isfinite(best.d[i])]
        own = np.sqrt(((q[i] - data[rows]) ** 2).sum(1))
        each = np.concatenate([ids[r] for r in rows]) if len(rows) else np.empty(0, np.int64)
        spread = np.repeat(own, [len(ids[r]) for r in rows])
        order = np.lexsort((each, spread))[:take]
        distances.append(spread[order])
        neighbours.append(each[order])
    return distances, neighbours


def _shards(rows: int, shard_rows: int) -> int:
    """How many shards: one for `shard_rows` rows, beyond eight of them a power of two with at least four times as many rows each."""
    want = max(1, -(-rows // shard_rows))
    return want if want <= 8 else max(8, 1 << (max(1, rows // (4 * shard_rows)).bit_length() - 1))


def waves(load: dict[int, int], most: int) -> list[list[int]]:
    """The shards in groups with at most `most` visitors in all, or of one shard."""
    out, inside = [], 0
    for shard, visitors in sorted(load.items()):
        if not out or inside + visitors > most:
            out.append([])
            inside = 0
        out[-1].append(shard)
        inside += visitors
    return out


def nearest(points: DataFrame, dim: int, k: int = 5, relax: float = 1.0, shard_rows: int = 16384, sample_rows: int = 20_000, seed: int = 7, wave: int = 4) -> DataFrame:
    """(id, neighbour, distance): for each row of `points` (id, vec) its k nearest other rows, equal distances by id.

    Equal vectors are searched once: a vector comes with its k+1 smallest ids, which are all that can be among anyone's k
    nearest. However many rows lie at the k-th distance, the smallest ids come out. Fewer than k+1 rows in all give fewer neighbours; no rows give none.
    `sample_rows` bounds the rows on which the routing tree is fitted; every row is indexed and searched. Rows far from all others
    reach most shards, so each is sent as many times as there are shards: beyond eight of them, shards grow to at least four and less than eight
    times `shard_rows` before there are more. A shard that many balls reach is searched by several tasks, each with about
    `VISITORS` visitors; beyond `wave` visitors for each vector the shards are searched one group after another, and the
    shuffled rows of a group are dropped when its neighbours are stored.
    """
    spark = points.sparkSession
    unique = stored(distinct_vectors(points, k + 1), "vectors")
    n = unique.count()
    want = _shards(n, shard_rows)
    fraction = min(1.0, 1.3 * sample_rows / max(n, 1))
    sample = unique.select("vec").sample(fraction, seed).limit(sample_rows).toPandas() if want > 1 else None
    fitted = matrix(sample["vec"], dim) if sample is not None else np.empty((0, dim))
    tree = build(fitted, max(1, -(-len(fitted) // want)), np.random.default_rng(seed)) if want > 1 and len(fitted) > 1 else VpNode(rows=np.empty(0, int))
    shards = _label(tree)
    keep = k + 4  # itself, k others, and some within rounding; where more are tied, `ranked` looks again

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(shard=route(tree, matrix(b["vec"], dim)))

    placed = unique.mapInPandas(homes, "vid long, vec array<double>, ids array<long>, shard long")
    found_type = "vid long, near_d array<double>, near_id array<long>"

    def at_home(g: pd.DataFrame) -> pd.DataFrame:
        data, ids = matrix(g["vec"], dim), [np.asarray(x) for x in g["ids"]]
        own = build(data, 1024, np.random.default_rng(seed))
        best = search(own, data, data, min(k + 1, keep), keep, relax, None)
        near_d, near_id = ranked(own, data, ids, data, best, k + 1)
        # the ball holds k + 1 ids, its own and those of equal vectors counted; with fewer in the shard it is unbounded
        ball = np.array([d[k] if len(d) > k else 1e18 for d in near_d])
        visits = reach(tree, data, ball, relax)
        home = int(g["shard"].iloc[0])
        return pd.DataFrame({"vid": g["vid"], "vec": g["vec"], "ids": g["ids"], "shard": home, "ball": ball, "visits": [v[v != home] for v in visits], "near_d": near_d, "near_id": near_id})

    first = stored(placed.groupBy("shard").applyInPandas(at_home, "vid long, vec array<double>, ids array<long>, shard long, ball double, visits array<long>, near_d array<double>, near_id array<long>"), "home_neighbours")
    found = first.select("vid", "near_d", "near_id")
    if shards > 1:
        visitors = first.select(F.col("vid").alias("guest"), F.col("vec").alias("q"), "ball", F.explode("visits").alias("shard"))
        load = {r["shard"]: r["n"] for r in visitors.groupBy("shard").agg(F.count("*").alias("n")).collect()}

        def abroad(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(m) or not len(v):
                return pd.DataFrame({"vid": pd.Series([], dtype="int64"), "near_d": pd.Series([], dtype=object), "near_id": pd.Series([], dtype=object)})
            data, q, ids = matrix(m["vec"], dim), matrix(v["q"], dim), [np.asarray(x) for x in m["ids"]]
            own = build(data, 1024, np.random.default_rng(seed))
            best = search(own, data, q, k, keep, relax, v["ball"].to_numpy())
            best.d[best.d > best.cap[:, None]] = np.inf
            some = np.isfinite(best.d[:, 0])
            best.d, best.i, best.cap = best.d[some], best.i[some], best.cap[some]
            near_d, near_id = ranked(own, data, ids, q[some], best, k + 1)
            return pd.DataFrame({"vid": v["guest"].to_numpy()[some], "near_d": near_d, "near_id": near_id})

        keys = ["shard", "part"]
        for group in waves(load, wave * n):
            parts = spark.createDataFrame([(s, -(-load[s] // VISITORS)) for s in group], "shard long, parts long")
            guests = visitors.join(F.broadcast(parts), "shard").withColumn("part", F.pmod("guest", "parts"))
            members = first.select(F.col("shard").alias("shard"), F.col("vec").alias("vec"), F.col("ids").alias("ids")).join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            searched = members.select(*keys, "vec", "ids").groupBy(*keys).cogroup(guests.select(*keys, "guest", "q", "ball").groupBy(*keys)).applyInPandas(abroad, found_type)
            found = found.unionByName(stored(searched, "visited_neighbours"))
    # at most k + 1 entries a shard visited
    lists = found.select("vid", F.arrays_zip(F.col("near_d").alias("d"), F.col("near_id").alias("id")).alias("near"))
    merged = lists.groupBy("vid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    per_vector = unique.select("vid", "vec").join(merged, "vid")
    per_row = points.join(per_vector, "vec").select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return per_row.select("id", F.explode("near").alias("x")).select("id", F.col("x.id").alias("neighbour"), F.col("x.d").alias("distance"))
