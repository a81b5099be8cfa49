"""Queries on thresholds, scaling, bins, bootstraps and statistics of cells and of distance scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellforge.operators import sampling as ops
from wellforge.operators.tables import with_group, without_nan
from wellforge.plans.tables import CELL_VALUES, _CELLS
from wellforge.session import table
from wellforge.streaming.arrivals import hourly_scores as hourly

def r8(c) -> F.Column:
    """Means of few decimals have finite expansions; at eight places they are not cut at a tie."""
    return F.round(c, 8)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r8(F.col(c)) for c in columns})


SIZE = "MOR_object_pixel_count"
SCORES = ["miel_distance", "miel_orthogonal"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_nan(table(spark, sf_dir, "cells").select("cell_id", "WellIndex", *CELL_VALUES))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance scores that are numbers."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in SCORES]
    return table(spark, sf_dir, "df_distance").select("dist_id", "Group", "Sample", *SCORES).filter(finite[0] & finite[1])


def _size(metric: str, low: float, high: float, diameter: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ops.within_size(cells(spark, sf_dir), SIZE, metric, low, high, diameter).select("cell_id", r8(SIZE).alias(SIZE))

    return query


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.zscored(cells(spark, sf_dir), CELL_VALUES), *CELL_VALUES)


def bin_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bins(scores(spark, sf_dir).drop("Sample"), ["Group"], ["dist_id"], 50, seed=3).select("dist_id", "Group", "bin")


def bin_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = ops.bins(scores(spark, sf_dir), ["Group"], ["dist_id"], 50, seed=3)
    return binned.groupBy("Group", "bin").agg(*(r8(F.avg(c)).alias(c) for c in SCORES))


def _bootstrap(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = ops.bootstrap(scores(spark, sf_dir).filter("Sample IS NOT NULL"), ["Group"], ["dist_id"], SCORES, 100, 20, metric, seed=5)
        return rounded(out, *SCORES)

    return query


def sample_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.centroids(scores(spark, sf_dir), ["Group", "Sample"], SCORES)
    return rounded(out, *SCORES, *(f"{c}_SEM" for c in SCORES))


def group_centroids_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = ops.centroids(scores(spark, sf_dir), ["Group", "Sample"], SCORES)
    return rounded(ops.group_centroids(samples, ["Group"], SCORES), *SCORES, *(f"{c}_SEM" for c in SCORES))


def cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).groupBy("Group").agg(*(r8(ops.variation(c)).alias(c) for c in SCORES))


def anova_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.anova(cells(spark, sf_dir), "WellIndex", "Ch1_TXT_TAS_1_10")
    return rounded(out, "sum_sq", "mean_sq", "f", "eta_sq", "omega_sq")


def anova_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.anova_with_p(cells(spark, sf_dir), "WellIndex", "Ch1_object_average_intensity").select("term", "df", r8("f").alias("f"), r8("p_value").alias("p_value"))


def anova_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.line_fit(cells(spark, sf_dir), "MOR_object_pixel_count", "Ch1_TXT_TAS_1_10")
    return out.select("n", *(F.round(c, 4).alias(c) for c in ("intercept", "sse", "ss_total", "r2", "f", "aic", "bic")), F.round(F.col("slope") * 1e6, 4).alias("slope_per_million"))


def fitted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("Ch1_TXT_TAS_1_10")
    return cells(spark, sf_dir).select("cell_id", r8(ops.exponential(x, 2.0, 3.0, 0.5)).alias("exponential"), r8(ops.inverse(x, 2.0, -1.0, 0.5)).alias("inverse"), r8(ops.linear(x, 1.0, 4.0)).alias("linear"), r8(ops.power_law(x, 1.5, 2.0, 0.1)).alias("power_law"))


def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.box_statistics(scores(spark, sf_dir), "Group", "miel_distance"), "mean", "std", "q1", "q2", "q3", "low", "high")


def category_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.category_statistics(scores(spark, sf_dir), ["Group", "Sample"], "miel_distance"), "mean", "std")


def curve_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a given exponential curve of the texture describes the intensity."""
    out = ops.curve_anova(cells(spark, sf_dir), ops.exponential(F.col("Ch1_TXT_TAS_1_10"), 100.0, 2.0, 50.0), "Ch1_object_average_intensity", 3)
    return out.select("term", "df", *(F.round(c, 4).alias(c) for c in ("sum_sq", "mean_sq", "f", "aic", "bic")), *(r8(c).alias(c) for c in ("p_value", "r2", "adjusted_r2")))


def hourly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregation, run as a batch."""
    h = hourly(table(spark, sf_dir, "df_distance"))
    return h.select("hour", "Group", "n", r8("total").alias("total"), F.round("squares", 4).alias("squares"))


def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells per size class of 100 pixels, with the diameters at its ends."""
    h = ops.histogram(cells(spark, sf_dir), SIZE, 100)
    return h.select("low", "n", r8(ops.pixel_diameter(F.col("low"))).alias("from_diameter"), r8(ops.pixel_diameter(F.col("low") + 100)).alias("to_diameter"))


def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number for every combination of group and sample, and a flag for averages."""
    pairs = with_group(table(spark, sf_dir, "df_distance").select("Group", "Sample"), ["Group", "Sample"], "label").groupBy("label").agg(F.count("*").alias("n"))
    return pairs.withColumn("centroid", F.col("label").contains("ave"))


def otsu_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = ops.multi_otsu(cells(spark, sf_dir), SIZE, 3)
    counted = cells(spark, sf_dir).filter(F.col(SIZE).isNotNull()).select(sum((F.when(F.col(SIZE) > c, 1).otherwise(0) for c in cuts), F.lit(0)).alias("class"), SIZE)
    return counted.groupBy("class").agg(F.count("*").alias("n"), r8(F.min(SIZE)).alias("low"), r8(F.max(SIZE)).alias("high"))


QUERIES = {
    "size_threshold_median": _size("median", 0.5, 1.5),
    "size_threshold_mean": _size("mean", 0.5, 1.5),
    "size_threshold_quantile": _size("quantile", 0.1, 0.9),
    "size_threshold_values": _size("values", 1000.0, 3000.0),
    "size_threshold_diameter": _size("median", 0.8, 1.2, True),
    "bootstrap_mean": _bootstrap("mean"),
    "bootstrap_std": _bootstrap("std"),
} | {f.__name__: f for f in (zscore, bin_cells, bin_means, sample_centroids, group_centroids_sem, cv, anova_oneway, anova_p_value, anova_regression, fitted_curves, box_statistics, category_statistics, curve_anova, hourly_scores, size_histogram, group_labels, otsu_thresholds)}

_S = """s AS (SELECT dist_id, "Group", "Sample", miel_distance, miel_orthogonal FROM df_distance
  WHERE CAST(miel_distance AS VARCHAR) NOT IN ('nan', 'inf', '-inf') AND CAST(miel_orthogonal AS VARCHAR) NOT IN ('nan', 'inf', '-inf'))"""
_C = f"c AS ({_CELLS})"


def _sized(lo: str, hi: str, x: str = f'"{SIZE}"') -> str:
    return f'WITH {_C}, t AS (SELECT {lo} AS lo, {hi} AS hi FROM c) SELECT cell_id, round("{SIZE}", 8) AS "{SIZE}" FROM c, t WHERE {x} > lo AND {x} < hi'


_D = f'sqrt(4 * "{SIZE}" / pi())'
_BINNED = f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY "Group" ORDER BY md5('3|' || dist_id), dist_id) - 1 AS pos, count(*) OVER (PARTITION BY "Group") AS size FROM s WHERE "Group" IS NOT NULL),
b AS (SELECT *, pos // 50 + 1 AS bin FROM r WHERE pos // 50 + 1 <= size // 50)"""


def _boot(f: str) -> str:
    return f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY "Group" ORDER BY md5('5|' || dist_id), dist_id) - 1 AS pos, count(*) OVER (PARTITION BY "Group") AS size
  FROM s WHERE "Group" IS NOT NULL AND "Sample" IS NOT NULL),
g AS (SELECT "Group", max(size) AS size FROM r GROUP BY 1),
d AS (SELECT "Group", b AS bootstrap, ('0x' || substr(md5('5|' || "Group" || '|' || b || '|' || j), 1, 8))::BIGINT % size AS pos FROM g, range(1, 21) x(b), range(1, 101) y(j))
SELECT "Group", bootstrap::INT AS bootstrap, round({f}(miel_distance), 8) AS miel_distance, round({f}(miel_orthogonal), 8) AS miel_orthogonal FROM d JOIN r USING ("Group", pos) GROUP BY 1, 2"""


_CENT = f"""WITH {_S}, m AS (SELECT "Group", "Sample", avg(miel_distance) AS d, avg(miel_orthogonal) AS o, stddev_samp(miel_distance) / sqrt(200) AS ds, stddev_samp(miel_orthogonal) / sqrt(200) AS os FROM s GROUP BY 1, 2)"""

ORACLES = {
    "size_threshold_median": _sized(f'0.5 * median("{SIZE}")', f'1.5 * median("{SIZE}")'),
    "size_threshold_mean": _sized(f'0.5 * avg("{SIZE}")', f'1.5 * avg("{SIZE}")'),
    "size_threshold_quantile": _sized(f'quantile_cont("{SIZE}", 0.1)', f'quantile_cont("{SIZE}", 0.9)'),
    "size_threshold_values": _sized("any_value(1000.0)", "any_value(3000.0)"),
    "size_threshold_diameter": _sized(f"0.8 * median({_D})", f"1.2 * median({_D})", _D),
    "zscore": f'WITH {_C} SELECT cell_id, "WellIndex", ' + ", ".join(f'round(("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER (), 8) AS "{c}"' for c in CELL_VALUES) + " FROM c",
    "bin_cells": f'{_BINNED} SELECT dist_id, "Group", bin FROM b',
    "bin_means": f'{_BINNED} SELECT "Group", bin, round(avg(miel_distance), 8) AS miel_distance, round(avg(miel_orthogonal), 8) AS miel_orthogonal FROM b GROUP BY 1, 2',
    "bootstrap_mean": _boot("avg"),
    "bootstrap_std": _boot("stddev_samp"),
    "sample_centroids": f'{_CENT} SELECT "Group", "Sample", round(d, 8) AS miel_distance, round(o, 8) AS miel_orthogonal, round(ds, 8) AS "miel_distance_SEM", round(os, 8) AS "miel_orthogonal_SEM" FROM m',
    "group_centroids_sem": f'{_CENT} SELECT "Group", round(avg(d), 8) AS miel_distance, round(avg(o), 8) AS miel_orthogonal, round(sqrt(sum(ds * ds)), 8) AS "miel_distance_SEM", round(sqrt(sum(os * os)), 8) AS "miel_orthogonal_SEM" FROM m GROUP BY 1',
    "cv": f'WITH {_S} SELECT "Group", ' + ", ".join(f"round(stddev_pop({c}) / CASE WHEN avg({c}) = 0 THEN 1e-15 ELSE avg({c}) END, 8) AS {c}" for c in SCORES) + " FROM s GROUP BY 1",
    "anova_oneway": f"""WITH {_C}, v AS (SELECT "WellIndex" AS g, "Ch1_TXT_TAS_1_10" AS x FROM c WHERE "WellIndex" IS NOT NULL AND "Ch1_TXT_TAS_1_10" IS NOT NULL),
p AS (SELECT g, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM v GROUP BY 1), a AS (SELECT avg(x) AS m FROM v),
o AS (SELECT sum(n * (p.m - a.m) ** 2) AS b, sum(n * v) AS w, count(*) - 1 AS db, sum(n)::BIGINT - count(*) AS dw FROM p, a)
SELECT 'group' AS term, round(b, 8) AS sum_sq, db AS df, round(b / db, 8) AS mean_sq, round((b / db) / (w / dw), 8) AS f, round(b / (b + w), 8) AS eta_sq, round((b - db * w / dw) / (b + w + w / dw), 8) AS omega_sq FROM o
UNION ALL SELECT 'residual', round(w, 8), dw, round(w / dw, 8), NULL, NULL, NULL FROM o""",
    "anova_regression": f"""WITH {_C}, v AS (SELECT "MOR_object_pixel_count" AS x, "Ch1_TXT_TAS_1_10" AS y FROM c WHERE "MOR_object_pixel_count" IS NOT NULL AND "Ch1_TXT_TAS_1_10" IS NOT NULL),
o AS (SELECT count(*) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_syy(y, x) AS t, regr_r2(y, x) AS r FROM v), e AS (SELECT *, t * (1 - r) AS sse FROM o)
SELECT n, round(i, 4) AS intercept, round(sse, 4) AS sse, round(t, 4) AS ss_total, round(r, 4) AS r2, round(r * (n - 2) / (1 - r), 4) AS f,
round(n * ln(2 * pi() * sse / n) + 6 + n, 4) AS aic, round(n * ln(2 * pi() * sse / n) + ln(n) * 3 + n, 4) AS bic, round(s * 1e6, 4) AS slope_per_million FROM e""",
    "fitted_curves": f"""WITH {_C}, v AS (SELECT cell_id, "Ch1_TXT_TAS_1_10" AS x FROM c) SELECT cell_id, round(2 * exp(3 * x) + 0.5, 8) AS exponential, round(2 / (x + 1) + 0.5, 8) AS inverse, round(4 * x + 1, 8) AS linear, round(2 * x ** 1.5 + 0.1, 8) AS power_law FROM v""",
    "box_statistics": f"""WITH {_S}, q AS (SELECT "Group", count(*) AS n, avg(miel_distance) AS mean, stddev_samp(miel_distance) AS std, quantile_cont(miel_distance, 0.25) AS q1, quantile_cont(miel_distance, 0.5) AS q2, quantile_cont(miel_distance, 0.75) AS q3 FROM s WHERE "Group" IS NOT NULL GROUP BY 1)
SELECT q."Group", any_value(n) AS n, round(any_value(mean), 8) AS mean, round(any_value(std), 8) AS std, round(any_value(q1), 8) AS q1, round(any_value(q2), 8) AS q2, round(any_value(q3), 8) AS q3, round(min(miel_distance), 8) AS low, round(max(miel_distance), 8) AS high
FROM q JOIN s ON s."Group" = q."Group" AND miel_distance BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1""",
    "otsu_thresholds": f"""WITH {_C}, v AS (SELECT "{SIZE}" AS x FROM c WHERE "{SIZE}" IS NOT NULL), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 256 AS width FROM v),
h AS (SELECT least(floor((x - lo) / width), 255)::INT AS b, count(*) AS n FROM v, e GROUP BY 1), a AS (SELECT k, coalesce(n, 0) AS n, coalesce(n, 0) * (lo + (k + 0.5) * width) AS m FROM range(256) r(k) CROSS JOIN e LEFT JOIN h ON h.b = k),
p AS (SELECT k + 1 AS j, sum(n) OVER (ORDER BY k) AS w, sum(m) OVER (ORDER BY k) AS m FROM a), t AS (SELECT w, m FROM p WHERE j = 256),
g AS (SELECT p.j AS one, q.j AS two, p.m ** 2 / p.w + coalesce((q.m - p.m) ** 2 / nullif(q.w - p.w, 0), 0) + coalesce((t.m - q.m) ** 2 / nullif(t.w - q.w, 0), 0) AS gain FROM p JOIN p q ON q.j > p.j, t WHERE q.j < 256),
b AS (SELECT one, two FROM g, (SELECT max(gain) AS most FROM g) WHERE gain >= most * (1 - 1e-11) ORDER BY two, one LIMIT 1),
l AS (SELECT x, (x > lo + (one - 0.5) * width)::INT + (x > lo + (two - 0.5) * width)::INT AS class FROM v, e, b)
SELECT class, count(*) AS n, round(min(x), 8) AS low, round(max(x), 8) AS high FROM l GROUP BY 1""",
    "curve_anova": f"""WITH {_C}, v AS (SELECT "Ch1_object_average_intensity" AS y, 100 * exp(2 * "Ch1_TXT_TAS_1_10") + 50 AS f FROM c WHERE "Ch1_object_average_intensity" IS NOT NULL AND "Ch1_TXT_TAS_1_10" IS NOT NULL),
m AS (SELECT avg(y) AS m FROM v), o AS (SELECT count(*) AS n, sum(y * y) AS ss, sum(f * f) AS model, sum((y - m) ** 2) AS sst, sum((f - y) ** 2) AS sse, sum((f - m) ** 2) AS ssr FROM v, m),
t AS (SELECT *, ssr / 2 / (sse / (n - 3)) AS f, 1 - sse / ss AS r2 FROM o),
r AS (SELECT 'model' AS term, 3 AS df, model AS sum_sq, model / 3 AS mean_sq FROM t UNION ALL SELECT 'treatment', 2, ssr, ssr / 2 FROM t UNION ALL SELECT 'residual', n - 3, sse, sse / (n - 3) FROM t
  UNION ALL SELECT 'uncorrected total', n, ss, NULL FROM t UNION ALL SELECT 'corrected total', n - 1, sst, NULL FROM t)
SELECT term, df::BIGINT AS df, round(sum_sq, 4) AS sum_sq, round(mean_sq, 4) AS mean_sq, CASE WHEN term = 'treatment' THEN round(f, 4) END AS f, CASE WHEN term = 'treatment' THEN round(n * ln(2 * pi() * sse / n) + 8 + n, 4) END AS aic,
CASE WHEN term = 'treatment' THEN round(n * ln(2 * pi() * sse / n) + ln(n) * 4 + n, 4) END AS bic, CASE WHEN term = 'treatment' THEN round((1 + 2 * f / (n - 3)) ** (-(n - 3) / 2.0), 8) END AS p_value,
CASE WHEN term = 'treatment' THEN round(r2, 8) END AS r2, CASE WHEN term = 'treatment' THEN round(1 - (1 - r2) * n / (n - 3), 8) END AS adjusted_r2 FROM r, t""",
    "category_statistics": f'WITH {_S} SELECT "Group", "Sample", count(*) AS n, round(avg(miel_distance), 8) AS mean, round(stddev_samp(miel_distance), 8) AS std FROM s WHERE "Group" IS NOT NULL AND "Sample" IS NOT NULL GROUP BY 1, 2',
    "hourly_scores": """SELECT date_trunc('hour', measured_at)::TIMESTAMP AS hour, "Group", count(*) AS n, round(sum(miel_distance), 8) AS total, round(sum(miel_distance ** 2), 4) AS squares FROM df_distance
  WHERE measured_at IS NOT NULL AND CAST(miel_distance AS VARCHAR) NOT IN ('nan', 'inf', '-inf') GROUP BY 1, 2""",
    "size_histogram": f"""WITH {_C}, h AS (SELECT (floor("{SIZE}" / 100) * 100)::BIGINT AS low, count(*) AS n FROM c WHERE "{SIZE}" IS NOT NULL GROUP BY 1)
SELECT low, n, round(sqrt(4 * low / pi()), 8) AS from_diameter, round(sqrt(4 * (low + 100) / pi()), 8) AS to_diameter FROM h""",
    "group_labels": """SELECT coalesce("Group", 'nan') || '_' || coalesce("Sample", 'nan') AS label, count(*) AS n, contains(coalesce("Group", 'nan') || '_' || coalesce("Sample", 'nan'), 'ave') AS centroid FROM df_distance GROUP BY 1""",
}

