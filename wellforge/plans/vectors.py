"""Queries on feature vectors: distances, group axes, scores, components. Vectors are the rows of `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellforge.functions.arrays import METRICS, doubles, folded, hyperbolic_distance, polar, wrapped
from wellforge.operators import projections as proj
from wellforge.operators import scores as ops
from wellforge.session import cut, table

DIM = 64


def r6(c) -> F.Column:
    return F.round(c, 6)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 5).alias("sample"), doubles(F.col("embedding")).alias("vec"))


def model(spark: SparkSession, sf_dir: str) -> ops.AxisModel:
    return ops.fit_axis(vectors(spark, sf_dir), "sample", "label", "vec", DIM, 0, 1)


def axis_model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    return vectors(spark, sf_dir).select("vec_id", "label", r6(m.score(F.col("vec"))).alias("score"), r6(m.orthogonal(F.col("vec"))).alias("orthogonal"))


def axis_model_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    return vectors(spark, sf_dir).select("vec_id", m.predict(F.col("vec")).alias("prob_b"))


def axis_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    two = vectors(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(m.projection(F.col("vec")).alias("along"), m.residual(F.col("vec")).alias("across"))).alias("k", "x"))
    return two.select("vec_id", "k", r6("x.along").alias("along"), r6("x.across").alias("across"))


def centroid_vector_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores along the line between the plain centres of two groups."""
    v = vectors(spark, sf_dir)
    ends = {r["label"]: list(r["c"]) for r in v.filter(F.col("label").isin(2, 3)).groupBy("label").agg(ops.mean_vector("vec", DIM).alias("c")).collect()}
    m = ops.AxisModel(ends[2], ends[3], "3")
    return v.select("vec_id", r6(m.score(F.col("vec"))).alias("distance"), r6(m.orthogonal(F.col("vec"))).alias("orthogonal"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    return vectors(spark, sf_dir).filter(F.col("label").isin(0, 1)).select(r6(m.score(F.col("vec"))).alias("score"), F.col("label"))


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.roc(_scored(spark, sf_dir)).select("threshold", "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.auc(_scored(spark, sf_dir)).select(r6("auc").alias("auc"), "positives", "negatives")


def event_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the value of an event tells purchases from the rest: many ties, all rows."""
    e = table(spark, sf_dir, "events").select(F.round("value", 0).alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    return ops.auc(e).select(r6("auc").alias("auc"), "positives", "negatives")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    p = vectors(spark, sf_dir).filter(F.col("label").isin(0, 1)).select("label", m.predict(F.col("vec")).alias("predicted"))
    return ops.confusion(p).withColumn("accuracy", r6("accuracy"))


def _pairs(spark: SparkSession, sf_dir: str, metric: str = "euclidean") -> DataFrame:
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "vec")
    return ops.query_distances(v, v.filter("id % 20 = 0"), metric)


def _pdist(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir, metric).select("i", "j", r6("d").alias("d"))

    return query


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("i"), F.col("label").alias("group"))


def miel_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = _groups(spark, sf_dir).filter("group < 5 AND i % 20 = 0")
    return ops.mean_distance_to(_pairs(spark, sf_dir), reference, "mean_distance").select("j", r6("mean_distance").alias("mean_distance"))


def miel_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the plane of their mean distances to two halves of the labels, turned to the axis of the halves."""
    halves = _groups(spark, sf_dir).select("i", F.when(F.col("group") < 5, "low").otherwise("high").alias("group"))
    pairs = cut(_pairs(spark, sf_dir))
    out = ops.group_axes(pairs, halves, "low", "high")
    return out.select("j", "group", r6("distance").alias("distance"), r6("orthogonal").alias("orthogonal"))


def trustworthiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the first eight dimensions keep the neighbours of the query vectors."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "vec")
    low = v.select("id", F.slice("vec", 1, 8).alias("vec"))
    high, flat = (ops.query_distances(x, x.filter("id % 20 = 0")).withColumn("d", F.round("d", 9)) for x in (v, low))
    return ops.trustworthiness(high, flat, 5, v.count()).select(r6("trustworthiness").alias("trustworthiness"))


def hyperbolic_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next by id in the hyperbolic plane, its first two elements being radius and angle."""
    v = vectors(spark, sf_dir).select("vec_id", (F.abs(F.col("vec")[0]) * 10).alias("r"), (F.col("vec")[1] * 6).alias("a"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("r").alias("r2"), F.col("a").alias("a2"))
    return v.join(nxt, "vec_id").select("vec_id", r6(hyperbolic_distance(F.col("r"), F.col("a"), F.col("r2"), F.col("a2"))).alias("d"))


def polar_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius (k = 0) and angles of every vector."""
    p = vectors(spark, sf_dir).select("vec_id", F.posexplode(polar(F.col("vec"))).alias("k", "v"))
    return p.select("vec_id", "k", r6("v").alias("v"))


def wrapped_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element as an angle, moved by whole periods into [-3, 3)."""
    w = vectors(spark, sf_dir).select("vec_id", F.posexplode(F.transform("vec", lambda x: wrapped(x * 40, -3.0, 3.0))).alias("k", "angle"))
    return w.select("vec_id", "k", r6("angle").alias("angle"))


def folded_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a point in spherical coordinates, its angles folded."""
    w = vectors(spark, sf_dir).select("vec_id", F.posexplode(folded(F.transform("vec", lambda x: x * 40))).alias("k", "angle"))
    return w.select("vec_id", "k", r6("angle").alias("angle"))


def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    p = proj.principal_components(v, "vec", DIM, 4)
    return v.select("vec_id", p.apply(F.col("vec")).alias("s")).select("vec_id", *(r6(F.col("s")[i]).alias(f"pc{i + 1}") for i in range(4)))


def pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each block of eight features in each component's loadings, with the variance explained."""
    p = proj.principal_components(vectors(spark, sf_dir), "vec", DIM, 4)
    rows = [(i + 1, k // 8, float(a), float(p.ratio[i])) for i, axis in enumerate(p.axes) for k, a in enumerate(axis)]
    long = spark.createDataFrame(rows, "component int, channel int, loading double, ratio double")
    part = long.groupBy("component", "channel").agg(F.sqrt(F.sum(F.col("loading") ** 2)).alias("share"), F.first("ratio").alias("ratio"))
    return part.select("component", "channel", r6("share").alias("share"), r6("ratio").alias("ratio"))


def ica_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    p = proj.independent_components(v, "vec", DIM, 3, rounds=15)
    return v.select("vec_id", p.apply(F.col("vec")).alias("s")).select("vec_id", *(r6(F.col("s")[i]).alias(f"ic{i + 1}") for i in range(3)))


def mds_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    placed = v.select("vec_id", proj.classical_scaling(v, "vec", DIM, 2).apply(F.col("vec")).alias("position"))
    return placed.select("vec_id", *(r6(F.col("position")[i]).alias(f"mds{i + 1}") for i in range(2)))


def mds_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "vec")
    placed = cut(v.select("id", proj.classical_scaling(v, "vec", DIM, 8).apply(F.col("vec")).alias("vec")))
    q = ops.query_distances(placed, placed.filter("id % 20 = 0"))
    return proj.stress(_pairs(spark, sf_dir), q).select(r6("raw_stress").alias("raw_stress"), r6("stress1").alias("stress1"))


def logistic_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    scored, _ = proj.logistic_scores(v.filter("label < 2"), v, "vec_id", "vec", "label", c=10.0)
    return scored.select("vec_id", r6("probability").alias("probability"), "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        axis_model_score, axis_model_predict, axis_projection, centroid_vector_distance, roc_curve, roc_auc, event_auc, confusion, miel_1d, miel_2d, trustworthiness,
        hyperbolic_distances, polar_coordinates, wrapped_angles, folded_angles, pca_scores, pca_loadings, ica_scores, mds_positions, mds_stress, logistic_l1,
    )
} | {f"pdist_{m}": _pdist(m) for m in METRICS}

_E = "e AS (SELECT vec_id, label, vec_id % 5 AS sample, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)"
_AXIS = f"""{_E}, m AS (SELECT label, sample, k, avg(v) AS v FROM e WHERE label IN (0, 1) GROUP BY ALL),
c AS (SELECT k, avg(v) FILTER (WHERE label = 0) AS a, avg(v) FILTER (WHERE label = 1) AS b FROM m GROUP BY 1),
n AS (SELECT sqrt(sum((b - a) ** 2)) AS n FROM c),
s AS (SELECT vec_id, any_value(label) AS label, sum((v - a) * (b - a)) / any_value(n) AS s, sum((v - a) ** 2) AS q FROM e JOIN c USING (k), n GROUP BY 1)"""
_ROC = f"""{_AXIS}, t AS (SELECT round(s, 6) AS score, label FROM s WHERE label IN (0, 1)),
g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM t GROUP BY 1),
r AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS ap, sum(q) OVER () AS aq, p, q FROM g WINDOW w AS (ORDER BY score DESC))"""
_BEST = f"""{_AXIS}, t AS (SELECT s AS score, label FROM s WHERE label IN (0, 1)),
g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM t GROUP BY 1),
r AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS ap, sum(q) OVER () AS aq FROM g WINDOW w AS (ORDER BY score DESC)),
z AS (SELECT min(score) FILTER (WHERE label = 1) AS lo, max(score) FILTER (WHERE label = 0) AS hi FROM t),
b AS (SELECT CASE WHEN lo > hi THEN (lo + hi) / 2 ELSE (SELECT score FROM r ORDER BY round((1 - tp / ap) ** 2 + (fp / aq) ** 2, 12), score DESC LIMIT 1) END AS cut FROM z)"""
_Q = "q AS (SELECT a.vec_id AS i, b.vec_id AS j, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"
_L = f"{_Q}, l AS (SELECT i, j, unnest(x) AS x, unnest(y) AS y, generate_subscripts(x, 1) AS k FROM q)"
_D = {
    "euclidean": "sqrt(sum((x - y) ** 2))",
    "sqeuclidean": "sum((x - y) ** 2)",
    "cityblock": "sum(abs(x - y))",
    "chebyshev": "max(abs(x - y))",
    "minkowski": "sum(abs(x - y) ** 3) ** (1.0 / 3)",
    "cosine": "1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y))",
    "hamming": "avg((x <> y)::INT::DOUBLE)",
    "canberra": "sum(CASE WHEN abs(x) + abs(y) = 0 THEN 0 ELSE abs(x - y) / (abs(x) + abs(y)) END)",
    "braycurtis": "sum(abs(x - y)) / sum(abs(x + y))",
    "correlation": "1 - corr(x, y)",
}
_P = f"{_L}, d AS (SELECT i, j, {_D['euclidean']} AS d FROM l GROUP BY 1, 2)"


def _auc(t: str) -> str:
    return f"""{t} SELECT round(sum(p * (aq - fp + q / 2.0)) / (max(ap) * max(aq)), 6) AS auc, max(ap)::BIGINT AS positives, max(aq)::BIGINT AS negatives FROM r"""


ORACLES = {
    "axis_model_score": f"WITH {_AXIS} SELECT vec_id, label, round(s, 6) AS score, round(sqrt(greatest(q - s * s, 0)), 6) AS orthogonal FROM s",
    "axis_model_predict": f"WITH {_BEST} SELECT vec_id, s > cut AS prob_b FROM s, b",
    "axis_projection": f"WITH {_AXIS} SELECT vec_id, (k - 1)::INT AS k, round(s * (b - a) / n, 6) AS along, round(v - a - s * (b - a) / n, 6) AS across FROM e JOIN c USING (k) JOIN s USING (vec_id), n",
    "centroid_vector_distance": f"""WITH {_E}, c AS (SELECT k, avg(v) FILTER (WHERE label = 2) AS a, avg(v) FILTER (WHERE label = 3) AS b FROM e GROUP BY 1), n AS (SELECT sqrt(sum((b - a) ** 2)) AS n FROM c),
s AS (SELECT vec_id, sum((v - a) * (b - a)) / any_value(n) AS s, sum((v - a) ** 2) AS q FROM e JOIN c USING (k), n GROUP BY 1)
SELECT vec_id, round(s, 6) AS distance, round(sqrt(greatest(q - s * s, 0)), 6) AS orthogonal FROM s""",
    "roc_curve": f"WITH {_ROC} SELECT score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / ap, 6) AS tpr, round(fp / aq, 6) AS fpr FROM r",
    "roc_auc": _auc(f"WITH {_ROC}"),
    "event_auc": _auc("""WITH t AS (SELECT round(value, 0) AS score, (event_type = 'purchase')::INT AS label FROM events), g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM t GROUP BY 1),
r AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS ap, sum(q) OVER () AS aq, p, q FROM g WINDOW w AS (ORDER BY score DESC))"""),
    "confusion": f"""WITH {_BEST}, p AS (SELECT label, s > cut AS y FROM s, b WHERE label IN (0, 1)), o AS (SELECT count(*) FILTER (WHERE label = 0 AND NOT y) AS tn, count(*) FILTER (WHERE label = 0 AND y) AS fp,
count(*) FILTER (WHERE label = 1 AND NOT y) AS fn, count(*) FILTER (WHERE label = 1 AND y) AS tp FROM p) SELECT *, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy FROM o""",
    "miel_1d": f"WITH {_P} SELECT j, round(avg(d), 6) AS mean_distance FROM d JOIN embeddings e ON e.vec_id = d.i AND e.label < 5 GROUP BY 1",
    "miel_2d": f"""WITH {_P}, g AS (SELECT vec_id, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS g FROM embeddings),
m AS (SELECT j, avg(d) FILTER (WHERE g.g = 'low') AS x, avg(d) FILTER (WHERE g.g = 'high') AS y FROM d JOIN g ON g.vec_id = d.i GROUP BY 1),
f AS (SELECT j, x, y, g.g AS grp FROM m JOIN g ON g.vec_id = m.j),
c AS (SELECT avg(x) FILTER (WHERE grp = 'low') AS xa, avg(y) FILTER (WHERE grp = 'low') AS ya, avg(x) FILTER (WHERE grp = 'high') AS xb, avg(y) FILTER (WHERE grp = 'high') AS yb FROM f),
u AS (SELECT xa, ya, (xb - xa) / sqrt((xb - xa) ** 2 + (yb - ya) ** 2) AS bx, (yb - ya) / sqrt((xb - xa) ** 2 + (yb - ya) ** 2) AS by_ FROM c)
SELECT j, grp AS "group", round(bx * (x - xa) + by_ * (y - ya), 6) AS distance, round(bx * (y - ya) - by_ * (x - xa), 6) AS orthogonal FROM f, u""",
    "trustworthiness": f"""WITH {_L}, d AS (SELECT i, j, round(sqrt(sum((x - y) ** 2)), 9) AS d, round(sqrt(sum((x - y) ** 2) FILTER (WHERE k <= 8)), 9) AS f FROM l WHERE i <> j GROUP BY 1, 2),
r AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rd, row_number() OVER (PARTITION BY i ORDER BY f, j) AS rf FROM d), n AS (SELECT count(*) AS n FROM embeddings)
SELECT round(1 - 2.0 / (count(DISTINCT i) * 5 * (2.0 * any_value(n) - 16)) * sum(greatest(rd - 5, 0)), 6) AS trustworthiness FROM r, n WHERE rf <= 5""",
    "hyperbolic_distances": """WITH v AS (SELECT vec_id, abs(embedding[1]::DOUBLE) * 10 AS r, embedding[2]::DOUBLE * 6 AS a FROM embeddings)
SELECT v.vec_id, round(acosh(greatest(cosh(v.r) * cosh(w.r) - sinh(v.r) * sinh(w.r) * cos(v.a - w.a), 1)), 6) AS d FROM v JOIN v w ON w.vec_id = v.vec_id + 1""",
    "polar_coordinates": """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
t AS (SELECT vec_id, k, v, lag(v) OVER (PARTITION BY vec_id ORDER BY k) AS u, sqrt(sum(v * v) OVER (PARTITION BY vec_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS r FROM e)
SELECT vec_id, 0 AS k, round(r, 6) AS v FROM t WHERE k = 1 UNION ALL SELECT vec_id, k::INT, round(CASE WHEN r > 0 THEN acos(v / r) ELSE 0 END, 6) FROM t WHERE k < 63
UNION ALL SELECT vec_id, 63, round(atan2(v, u), 6) FROM t WHERE k = 64""",
    "wrapped_angles": "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE * 40 AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) SELECT vec_id, k::INT AS k, round(x - floor((x + 3) / 6) * 6, 6) AS angle FROM v",
    "folded_angles": """WITH RECURSIVE f AS (SELECT vec_id, embedding AS e, 1 AS k, embedding[1]::DOUBLE * 40 AS angle, 0.0::DOUBLE AS turn FROM embeddings
  UNION ALL SELECT vec_id, e, k + 1, CASE WHEN k < 63 AND a > pi() THEN 2 * pi() - a ELSE a END, CASE WHEN k < 63 AND a > pi() THEN pi() ELSE 0 END
  FROM (SELECT *, x - floor(x / (2 * pi())) * 2 * pi() AS a FROM (SELECT *, e[k + 1]::DOUBLE * 40 + turn AS x FROM f WHERE k < 64)))
SELECT vec_id, (k - 1)::INT AS k, round(angle, 6) AS angle FROM f""",
} | {f"pdist_{m}": f"WITH {_L} SELECT i, j, round({sql}, 6) AS d FROM l GROUP BY 1, 2" for m, sql in _D.items()}
