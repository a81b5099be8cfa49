"""Distances between rows, distance scores along the axis of two groups, and how well scores part two classes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellforge.functions.arrays import distance, dot, minus, norm


def query_distances(rows: DataFrame, queries: DataFrame, metric: str = "euclidean", id_col: str = "id", vec_col: str = "vec", block: int = 1024, sent_rows: int = 16_384, salts: int = 64) -> DataFrame:
    """(i, j, d): the distance of every query i to every row j, itself included.

    The queries are a stated set, packed into blocks of about `block`. Up to `sent_rows` queries are counted and sent to all tasks,
    and the rows are not shuffled. More queries are joined by block and salt: each row meets each block once, and a block's rows
    are spread over `salts` keys. The result has queries x rows rows by its nature.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    q = queries.select(F.col(id_col).alias("i"), F.col(vec_col).alias("_q")).withColumn("_b", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    packed = q.groupBy("_b").agg(F.collect_list(F.struct("i", "_q")).alias("_qs"))
    r = rows.select(F.col(id_col).alias("j"), F.col(vec_col).alias("_r"))
    if n <= sent_rows:
        met = r.crossJoin(F.broadcast(packed))
    else:
        spread = packed.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        met = r.withColumn("_s", F.pmod(F.xxhash64("j"), F.lit(salts))).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(spread, ["_b", "_s"])
    pairs = met.select("j", "_r", F.explode("_qs").alias("_x"))
    return pairs.select(F.col("_x.i").alias("i"), "j", distance(F.col("_x._q"), F.col("_r"), metric).alias("d"))


def mean_distance_to(pairs: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    """(j, name): the mean distance of every row j to the reference rows (i), a row's distance 0 to itself included."""
    return pairs.join(reference.select("i").distinct(), "i", "left_semi").groupBy("j").agg(F.avg("d").alias(name))


def group_axes(pairs: DataFrame, members: DataFrame, a: str, b: str) -> DataFrame:
    """(j, group, distance, orthogonal): rows in the plane of their mean distances to groups `a` and `b`.

    The plane is moved so that the centre of `a` is the origin and turned so that the centre of `b` lies on the first axis.
    `members` (i, group) names the reference rows; groups are also the rows' own, by j.
    """
    ref = members.select("i", "group")
    x = mean_distance_to(pairs, ref.filter(F.col("group") == a), "x")
    y = mean_distance_to(pairs, ref.filter(F.col("group") == b), "y")
    flat = x.join(y, "j").join(ref.select(F.col("i").alias("j"), "group"), "j")
    means = [F.avg(F.when(F.col("group") == g, F.col(c))).alias(f"{c}{g_}") for g, g_ in ((a, "a"), (b, "b")) for c in ("x", "y")]
    one = flat.agg(*means).select("xa", "ya", (F.col("xb") - F.col("xa")).alias("dx"), (F.col("yb") - F.col("ya")).alias("dy"))
    unit = one.withColumn("len", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).select("xa", "ya", F.try_divide("dx", "len").alias("bx"), F.try_divide("dy", "len").alias("by"))
    t = flat.crossJoin(F.broadcast(unit))
    u, v = F.col("x") - F.col("xa"), F.col("y") - F.col("ya")
    return t.select("j", "group", (F.col("bx") * u + F.col("by") * v).alias("distance"), (F.col("bx") * v - F.col("by") * u).alias("orthogonal"))


def mean_vector(vec: str, dim: int) -> Column:
    """Element-wise mean as an aggregate."""
    return F.array(*(F.avg(F.col(vec)[k]) for k in range(dim)))


@dataclass(frozen=True)
class AxisModel:
    """The axis from the centre of group A to that of group B. Its size is twice the number of features."""

    a: list[float]
    b: list[float]
    group_b: str
    threshold: float | None = None

    def _ends(self) -> tuple[Column, Column]:
        return F.array(*(F.lit(x) for x in self.a)), F.array(*(F.lit(x) for x in self.b))

    def score(self, vec: Column) -> Column:
        """Length along the axis, 0 at the centre of A."""
        a, b = self._ends()
        return F.try_divide(dot(minus(vec, a), minus(b, a)), norm(minus(b, a)))

    def projection(self, vec: Column) -> Column:
        """The part of vec - A along the axis."""
        a, b = self._ends()
        axis = minus(b, a)
        share = F.try_divide(dot(minus(vec, a), axis), dot(axis, axis))
        return F.transform(axis, lambda x: x * share)

    def residual(self, vec: Column) -> Column:
        """The part of vec - A across the axis."""
        a, _ = self._ends()
        return minus(minus(vec, a), self.projection(vec))

    def orthogonal(self, vec: Column) -> Column:
        return norm(self.residual(vec))

    def predict(self, vec: Column) -> Column:
        """Whether the score exceeds the threshold: `vec` looks like group B."""
        return self.score(vec) > F.lit(self.threshold)


def fit_axis(df: DataFrame, sample: str, group: str, vec: str, dim: int, group_a, group_b) -> AxisModel:
    """Means of the samples' means of both groups, and the threshold nearest to the ideal corner of the ROC curve.

    Two rows of `dim` numbers and one threshold come to the driver. A group without rows raises ValueError.
    """
    two = df.filter(F.col(group).isin(group_a, group_b))
    # sums of whole vectors leave the tasks as one row a sample and element
    parts = two.select(group, sample, F.posexplode(vec).alias("k", "v")).groupBy(group, sample, "k").agg(F.avg("v").alias("v"))
    ends: dict = {}
    for r in parts.groupBy(group, "k").agg(F.avg("v").alias("c")).collect():
        ends.setdefault(r[group], [None] * dim)[r["k"]] = r["c"]
    if group_a not in ends or group_b not in ends:
        raise ValueError("a group has no rows")
    model = AxisModel(ends[group_a], ends[group_b], str(group_b))
    scored = two.select(model.score(F.col(vec)).alias("score"), (F.col(group) == group_b).cast("int").alias("label"))
    return AxisModel(model.a, model.b, model.group_b, best_threshold(scored))


def roc(scored: DataFrame) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr): a point for every different score (score, label 0/1), counting scores from it upwards.

    Equal scores are counted together before anything is ordered. The running sums go over ranges of scores: partial sums per
    range, then rows inside a range, so that no task sees all scores.
    """
    per = scored.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    return _running(per).select(F.col("score").alias("threshold"), "tp", "fp", F.try_divide("tp", "all_p").alias("tpr"), F.try_divide("fp", "all_q").alias("fpr"))


def _running(per: DataFrame, pieces: int = 64, keep_piece: bool = False) -> DataFrame:
    """Adds tp, fp (sums of p, q over scores from this one upwards), all_p and all_q.

    Scores are cut at approximate quantiles of themselves, so that a piece holds about as many as any other however they lie.
    """
    ends = per.agg(F.percentile_approx("score", F.array(*(F.lit(i / pieces) for i in range(1, pieces))), 50 * pieces).alias("cuts"), F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    rows = per.crossJoin(F.broadcast(ends)).withColumn("_piece", F.size(F.filter("cuts", lambda x: x < F.col("score")))).drop("cuts")
    down = Window.orderBy(F.desc("_piece"))  # at most `pieces` rows
    sums = rows.groupBy("_piece").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    before = sums.select("_piece", (F.sum("sp").over(down) - F.col("sp")).alias("_bp"), (F.sum("sq").over(down) - F.col("sq")).alias("_bq"))
    inside = Window.partitionBy("_piece").orderBy(F.desc("score"))
    out = rows.join(F.broadcast(before), "_piece").withColumn("tp", F.sum("p").over(inside) + F.col("_bp")).withColumn("fp", F.sum("q").over(inside) + F.col("_bq"))
    return out if keep_piece else out.drop("_piece")


def auc(scored: DataFrame) -> DataFrame:
    """One row (auc, positives, negatives): the share of pairs that the scores order rightly, ties counting half."""
    per = scored.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    r = _running(per)
    # negatives below this score, and half of those at it
    below = F.col("all_q") - F.col("fp") + F.col("q") / 2
    return r.agg(F.try_divide(F.sum(F.col("p") * below), F.max("all_p") * F.max("all_q")).alias("auc"), F.max("all_p").alias("positives"), F.max("all_q").alias("negatives"))


def best_threshold(scored: DataFrame) -> float | None:
    """The score whose point lies nearest to the ideal corner, the higher of equals; with perfect scores the middle of the gap."""
    perfect = scored.agg(F.min(F.when(F.col("label") == 1, F.col("score"))).alias("p"), F.max(F.when(F.col("label") == 0, F.col("score"))).alias("q")).first()
    if perfect["p"] is not None and perfect["q"] is not None and perfect["p"] > perfect["q"]:
        return (perfect["p"] + perfect["q"]) / 2
    gap = F.round((1 - F.col("tpr")) ** 2 + F.col("fpr") ** 2, 12)
    row = roc(scored).agg(F.min_by("threshold", F.struct(gap, -F.col("threshold"))).alias("t")).first()
    return row["t"]


def confusion(predicted: DataFrame) -> DataFrame:
    """One row (tn, fp, fn, tp, accuracy) of (label 0/1, predicted true/false)."""
    n = lambda y, p: F.count_if((F.col("label") == y) & (F.col("predicted") == p))
    one = predicted.agg(n(0, False).alias("tn"), n(0, True).alias("fp"), n(1, False).alias("fn"), n(1, True).alias("tp"))
    return one.withColumn("accuracy", F.try_divide(F.col("tn") + F.col("tp"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")))


def trustworthiness(high: DataFrame, low: DataFrame, k: int, rows: int) -> DataFrame:
    """One row: how far the k nearest in an embedding are near in the original too, over the queries in both (i, j, d) tables.

    Ranks are taken per query, ties by id. `rows` is the number of rows; k must be less than half of it.
    """
    if k >= rows / 2:
        raise ValueError("k must be less than half of the rows")
    order = Window.partitionBy("i").orderBy("d", "j")
    a = high.filter("i != j").withColumn("rank", F.row_number().over(order)).select("i", "j", "rank")
    b = low.filter("i != j").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select("i", "j")
    far = b.join(a, ["i", "j"]).agg(F.sum(F.greatest(F.col("rank") - k, F.lit(0))).alias("s"), F.countDistinct("i").alias("q"))
    return far.select((1 - 2.0 / (F.col("q") * k * (2.0 * rows - 3.0 * k - 1)) * F.col("s")).alias("trustworthiness"))
