"""Queries on images: the 64 elements of each row of `embeddings` as an image of eight by eight, foreground above 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellforge.functions.arrays import doubles
from wellforge.functions.images import PERCENTS, clipped, feature_name, rescaled
from wellforge.operators import objects as ops
from wellforge.session import table

WIDTH = 8


def r6(c) -> F.Column:
    return F.round(c, 6)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("px"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with the label of their quadrant, 1 to 4."""
    p = ops.pixels(images(spark, sf_dir), "vec_id", "px", WIDTH)
    return p.withColumn("object", 1 + 2 * F.floor(F.col("r") / 4).cast("int") + F.floor(F.col("c") / 4).cast("int"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).filter("v > 0")


def max_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stack of all images of a label, projected to its largest pixels."""
    return ops.projected_pixels(images(spark, sf_dir), ["label"], "px").select("label", "k", r6("v").alias("v"))


def gray_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = images(spark, sf_dir).select("vec_id", F.posexplode(rescaled(F.col("px"), -0.1, 0.2)).alias("k", "v"))
    return p.select("vec_id", "k", r6("v").alias("v"))


def clip_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = images(spark, sf_dir).select("vec_id", F.posexplode(clipped(F.col("px"), 0.1)).alias("k", "v"))
    return p.select("vec_id", "k", r6("v").alias("v"))


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ops.image_statistics(images(spark, sf_dir), "vec_id", "px")
    return q.select(F.col("id").alias("vec_id"), r6("percent_max").alias("percent_max"), r6("percent_median2sd").alias("percent_median2sd"))


def image_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all images of a label have one size."""
    return images(spark, sf_dir).groupBy("label").agg(F.min(F.size("px")).alias("least"), (F.min(F.size("px")) == F.max(F.size("px"))).alias("equal"))


def power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.power_rings(images(spark, sf_dir), "vec_id", "px", WIDTH).select(F.col("id").alias("vec_id"), "k", r6("power").alias("power"))


def power_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.power_slope(ops.power_rings(images(spark, sf_dir), "vec_id", "px", WIDTH)).select(F.col("id").alias("vec_id"), r6("slope").alias("slope"))


def _tas(modes: tuple[int, ...], percents: tuple[int, ...]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = ops.adjacency_features(images(spark, sf_dir), "vec_id", "px", WIDTH, modes, percents)
        one = t.select(F.col("id").alias("vec_id"), "mode", "percent", F.posexplode("tas").alias("n", "share"))
        return one.select("vec_id", "mode", "percent", "n", r6("share").alias("share"))

    return query


def tas_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named texture features of all modes as one wide row per image."""
    t = ops.texture_features(images(spark, sf_dir), "vec_id", "px", WIDTH, "Ch1")
    return t.select(F.col("id").alias("vec_id"), *(r6(c).alias(c) for c in t.columns[1:]))


def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bounding_boxes(_objects(spark, sf_dir), ["id", "object"], margin=1)


def object_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.crops(_objects(spark, sf_dir), ["id", "object"]).select("id", "object", "y", "x", r6("v").alias("v"))


def object_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ops.object_features(_objects(spark, sf_dir), ["id", "object"])
    return f.withColumn("average_intensity", r6("average_intensity")).withColumn("eccentricity", r6("eccentricity"))


def sized_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a size strictly between 4 and 12 pixels, and the others."""
    f = ops.object_features(_objects(spark, sf_dir), ["id", "object"])
    return f.select("id", "object", ((F.col("pixel_count") > 4) & (F.col("pixel_count") < 12)).alias("inside"))


def mask_roundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform("px", lambda x: F.when(x > 0, 1).otherwise(0))
    return images(spark, sf_dir).select("vec_id", bits.alias("bits")).select("vec_id", r6(ops.roundness(F.col("bits"), WIDTH)).alias("roundness"))


def illumination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat and dark field of the images of each label."""
    f = ops.illumination(images(spark, sf_dir), ["label"], "px")
    return f.select("label", "k", r6("flat").alias("flat"), r6("dark").alias("dark"))


def resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image at half its size, by linear interpolation between pixels."""
    p = ops.resized(images(spark, sf_dir), "vec_id", "px", WIDTH, 5, 5)
    return p.select(F.col("id").alias("vec_id"), F.posexplode("px").alias("k", "v")).select("vec_id", "k", r6("v").alias("v"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight images with running ids as the planes of a stack."""
    planes = images(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("stack"), (F.col("vec_id") % 8).alias("z"), "px")
    whole = planes.groupBy("stack").agg(F.array_sort(F.collect_list(F.struct("z", "px"))).alias("p"))
    return whole.select("stack", F.flatten(F.transform("p", lambda x: x["px"])).alias("px"))


def tas_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency statistics of stacks, 26 neighbours a voxel."""
    t = ops.adjacency_features(volumes(spark, sf_dir), "stack", "px", WIDTH, (1, 3), (30,), height=WIDTH)
    return t.select(F.col("id").alias("stack"), "mode", "percent", F.posexplode("tas").alias("n", "share")).withColumn("share", r6("share"))


def resized_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.resized_volume(volumes(spark, sf_dir), "stack", "px", (None, 8, 8), (4, 5, 6))
    return p.select(F.col("id").alias("stack"), F.posexplode("px").alias("k", "v")).select("stack", "k", r6("v").alias("v"))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each image: pixels above 0.05 that touch along rows or columns, named by their first pixel."""
    s = ops.segment(images(spark, sf_dir), "vec_id", "px", WIDTH, 0.05)
    one = s.select(F.col("id").alias("vec_id"), F.posexplode("labels").alias("k", "object")).filter("object > 0")
    return one.groupBy("vec_id", "object").agg(F.count("*").alias("pixel_count"), F.max("k").alias("last"))


def segmented_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each stack: voxels above 0.15 that touch along an axis, named by their first voxel."""
    s = ops.segment(volumes(spark, sf_dir), "stack", "px", WIDTH, 0.15, height=WIDTH)
    one = s.select(F.col("id").alias("stack"), F.posexplode("labels").alias("k", "object")).filter("object > 0")
    return one.groupBy("stack", "object").agg(F.count("*").alias("voxel_count"), F.max("k").alias("last"))


def _labelled_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks with the voxels above 0.1 as object 1 in the left half and object 2 in the right."""
    label = lambda x, i: F.when(x > 0.1, F.when(i % WIDTH < WIDTH // 2, 1).otherwise(2)).otherwise(0)
    return volumes(spark, sf_dir).select("stack", F.transform("px", label).alias("labels"))


def interpolated_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two objects of each stack, their shapes interpolated to 15 planes: voxels of each plane and object."""
    p = ops.interpolated_labels(_labelled_volumes(spark, sf_dir), "stack", "labels", WIDTH, WIDTH, (15, WIDTH, WIDTH))
    one = p.select(F.col("id").alias("stack"), F.posexplode("labels").alias("k", "object")).filter("object > 0")
    return one.groupBy("stack", F.floor(F.col("k") / 64).cast("int").alias("plane"), "object").agg(F.count("*").alias("n"), F.sum("k").alias("places"))


def resized_label_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same objects at 4 x 16 x 4 voxels, each with the nearest label."""
    p = ops.resized_labels(_labelled_volumes(spark, sf_dir), "stack", "labels", WIDTH, WIDTH, (4, 16, 4))
    return p.select(F.col("id").alias("stack"), F.posexplode("labels").alias("k", "object"))


QUERIES = {
    f.__name__: f
    for f in (
        illumination, resized, segmented, segmented_volume, interpolated_volume, resized_label_volume, tas_volume, resized_volume,
        max_projection, gray_rescale, clip_above, image_quality, image_shapes, power_spectrum, power_slope, tas_features, bounding_boxes, object_crops, object_measures, sized_objects, mask_roundness,
    )
} | {"tas_mode0": _tas((0,), PERCENTS), "tas_mode1": _tas((1,), PERCENTS), "tas_mode2": _tas((2,), PERCENTS), "tas_mode3": _tas((3,), ())}

_PX = "p AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INT AS k FROM embeddings), g AS (SELECT *, k // 8 AS r, k % 8 AS c, (1 + 2 * (k // 32) + (k % 8) // 4)::INT AS object FROM p)"
_OBJ = f"{_PX}, o AS (SELECT * FROM g WHERE v > 0)"


_VOX = """v AS (SELECT vec_id // 8 AS stack, vec_id % 8 AS z, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k, count(*) OVER (PARTITION BY vec_id // 8) AS whole FROM embeddings),
x AS (SELECT stack, z, k // 8 AS r, k % 8 AS c, v, whole AS n FROM v)"""


def _tas_sql(mode: int) -> str:
    test = {0: "v >= m * (1 - percent / 100.0) AND v < m * (1 + percent / 100.0)", 1: "v >= m * (1 - percent / 100.0)", 2: "v >= m * (1 + percent / 100.0)", 3: "v >= m"}[mode]
    percents = "[0]" if mode == 3 else "[10, 20, 30, 40, 50, 60, 70, 80, 90]"
    return f"""{_PX}, m AS (SELECT id, avg(v) FILTER (WHERE v > 0) AS m FROM g GROUP BY 1), q AS (SELECT unnest({percents}) AS percent),
w AS (SELECT g.id, percent, r, c FROM g JOIN m USING (id), q WHERE {test}),
a AS (SELECT w.id, w.percent, w.r, w.c, count(x.id) AS n FROM w LEFT JOIN w x ON x.id = w.id AND x.percent = w.percent AND abs(x.r - w.r) <= 1 AND abs(x.c - w.c) <= 1 AND NOT (x.r = w.r AND x.c = w.c) GROUP BY 1, 2, 3, 4),
h AS (SELECT id, percent, n, count(*) AS k FROM a GROUP BY 1, 2, 3), t AS (SELECT id, percent, sum(k) AS t FROM h GROUP BY 1, 2)
SELECT e.vec_id, {mode} AS mode, q.percent, z.n::INT AS n, round(coalesce(h.k / t.t, 0), 6) AS share FROM embeddings e, q, range(9) z(n) LEFT JOIN h ON h.id = e.vec_id AND h.percent = q.percent AND h.n = z.n
LEFT JOIN t ON t.id = e.vec_id AND t.percent = q.percent"""


_RINGS = f"""{_PX}, u AS (SELECT u, w, floor(sqrt(u * u + w * w) + 0.5)::INT AS k FROM range(-4, 4) a(u), range(-4, 4) b(w)),
f AS (SELECT id, u, w, any_value(u.k) AS k, sum(v * cos(2 * pi() * (u * r + w * c) / 8)) AS re, sum(v * sin(2 * pi() * (u * r + w * c) / 8)) AS im FROM g, u WHERE u.k BETWEEN 1 AND 4 GROUP BY 1, 2, 3),
s AS (SELECT id, k, avg(re * re + im * im) * pi() * ((k + 0.5) ** 2 - (k - 0.5) ** 2) AS power FROM f GROUP BY 1, 2)"""

ORACLES = {
    "illumination": f"""WITH {_PX}, q AS (SELECT label, k, median(v) AS m, quantile_cont(v, 0.05) AS dark FROM g GROUP BY 1, 2)
SELECT label, k, round(m / avg(m) OVER (PARTITION BY label), 6) AS flat, round(dark, 6) AS dark FROM q""",
    "resized": f"""WITH {_PX}, t AS (SELECT i * 7 / 4.0::DOUBLE AS y, j * 7 / 4.0::DOUBLE AS x, (i * 5 + j)::INT AS k FROM range(5) a(i), range(5) b(j)),
w AS (SELECT k, y, x, least(floor(y), 6)::INT AS y0, least(floor(x), 6)::INT AS x0 FROM t)
SELECT g.id AS vec_id, w.k, round(sum(v * (1 - abs(g.r - y)) * (1 - abs(g.c - x))), 6) AS v FROM w JOIN g ON g.r BETWEEN y0 AND y0 + 1 AND g.c BETWEEN x0 AND x0 + 1 GROUP BY 1, 2""",
    "tas_volume": f"""WITH {_VOX}, m AS (SELECT stack, avg(v) FILTER (WHERE v > 0) AS m FROM x GROUP BY 1), q AS (SELECT * FROM (VALUES (1, 30), (3, 0)) q(mode, percent)),
w AS (SELECT x.stack, mode, percent, z, r, c FROM x JOIN m USING (stack), q WHERE v >= m * (1 - percent / 100.0)),
a AS (SELECT w.stack, w.mode, w.percent, w.z, w.r, w.c, count(y.stack) AS n FROM w LEFT JOIN w y ON y.stack = w.stack AND y.mode = w.mode AND abs(y.z - w.z) <= 1 AND abs(y.r - w.r) <= 1 AND abs(y.c - w.c) <= 1
  AND NOT (y.z = w.z AND y.r = w.r AND y.c = w.c) GROUP BY ALL),
h AS (SELECT stack, mode, percent, n, count(*) AS k, sum(count(*)) OVER (PARTITION BY stack, mode) AS t FROM a GROUP BY 1, 2, 3, 4)
SELECT s.stack, q.mode, q.percent, z.n::INT AS n, round(coalesce(h.k / h.t, 0), 6) AS share FROM (SELECT DISTINCT stack FROM x) s, q, range(27) z(n) LEFT JOIN h ON h.stack = s.stack AND h.mode = q.mode AND h.n = z.n""",
    "resized_volume": f"""WITH {_VOX}, t AS (SELECT ((i * 5 + j) * 6 + l)::INT AS k, i, j * 7 / 4.0::DOUBLE AS ty, l * 7 / 5.0::DOUBLE AS tx FROM range(4) a(i), range(5) b(j), range(6) d(l)),
s AS (SELECT DISTINCT stack, n FROM x),
w AS (SELECT s.stack, t.*, i * (n - 1) / 3.0::DOUBLE AS tz, greatest(least(floor(i * (n - 1) / 3.0::DOUBLE), n - 2), 0)::INT AS z0, least(floor(ty), 6)::INT AS y0, least(floor(tx), 6)::INT AS x0 FROM t, s)
SELECT x.stack, w.k, round(sum(v * (1 - abs(z - tz)) * (1 - abs(r - ty)) * (1 - abs(c - tx))), 6) AS v FROM w JOIN x ON x.stack = w.stack AND x.z BETWEEN z0 AND z0 + 1 AND x.r BETWEEN y0 AND y0 + 1 AND x.c BETWEEN x0 AND x0 + 1 GROUP BY 1, 2""",
    "segmented": """WITH RECURSIVE p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INT AS k FROM embeddings), o AS (SELECT vec_id, k, k // 8 AS r, k % 8 AS c FROM p WHERE v > 0.05),
w AS (SELECT vec_id, k, k AS root FROM o UNION SELECT b.vec_id, b.k, w.root FROM w JOIN o a ON a.vec_id = w.vec_id AND a.k = w.k JOIN o b ON b.vec_id = a.vec_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE w.root < b.k),
m AS (SELECT vec_id, k, min(root) + 1 AS object FROM w GROUP BY 1, 2)
SELECT vec_id, object, count(*) AS pixel_count, max(k) AS last FROM m GROUP BY 1, 2""",
    "segmented_volume": f"""WITH RECURSIVE {_VOX}, o AS (SELECT stack, z, r, c, z * 64 + r * 8 + c AS k FROM x WHERE v > 0.15),
w AS (SELECT stack, z, r, c, k, k AS root FROM o UNION SELECT b.stack, b.z, b.r, b.c, b.k, w.root FROM w JOIN o b ON b.stack = w.stack AND abs(w.z - b.z) + abs(w.r - b.r) + abs(w.c - b.c) = 1 WHERE w.root < b.k),
m AS (SELECT stack, k, min(root) + 1 AS object FROM w GROUP BY 1, 2)
SELECT stack, object, count(*) AS voxel_count, max(k) AS last FROM m GROUP BY 1, 2""",
    "interpolated_volume": f"""WITH {_VOX}, l AS (SELECT stack, n, z, r, c, CASE WHEN v > 0.1 THEN CASE WHEN c < 4 THEN 1 ELSE 2 END ELSE 0 END AS o FROM x), q AS (SELECT unnest([1, 2]) AS object),
s AS (SELECT a.stack, object, a.n, a.z, a.r, a.c, CASE WHEN a.o = object THEN 1 ELSE -1 END * least(coalesce(min(sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) FILTER (WHERE (a.o = object) <> (b.o = object)), 16), 16) AS d
  FROM q, l a JOIN l b ON b.stack = a.stack AND b.z = a.z GROUP BY a.stack, object, a.n, a.z, a.r, a.c, a.o),
h AS (SELECT DISTINCT stack, object FROM l JOIN q ON l.o = q.object),
t AS (SELECT i, s.*, i * (n - 1) / 14.0::DOUBLE AS tz, greatest(least(floor(i * (n - 1) / 14.0::DOUBLE), n - 2), 0)::INT AS z0 FROM s JOIN h USING (stack, object), range(15) a(i)),
g AS (SELECT stack, object, i, r, c, sum(d * (1 - abs(z - tz))) AS d FROM t WHERE z BETWEEN z0 AND z0 + 1 GROUP BY ALL),
m AS (SELECT stack, i, r, c, max(object) AS object FROM g WHERE d > 0 GROUP BY ALL)
SELECT stack, i::INT AS plane, object, count(*) AS n, sum(i * 64 + r * 8 + c)::BIGINT AS places FROM m GROUP BY ALL""",
    "resized_label_volume": f"""WITH {_VOX}, l AS (SELECT stack, n, z, r, c, CASE WHEN v > 0.1 THEN CASE WHEN c < 4 THEN 1 ELSE 2 END ELSE 0 END AS object FROM x),
t AS (SELECT ((i * 16 + j) * 4 + m)::INT AS k, i, floor((j + 0.5) * 8 / 16)::INT AS r, floor((m + 0.5) * 8 / 4)::INT AS c FROM range(4) a(i), range(16) b(j), range(4) d(m))
SELECT l.stack, t.k, l.object FROM l JOIN t ON t.r = l.r AND t.c = l.c AND l.z = least(floor((t.i + 0.5) * l.n / 4), l.n - 1)""",
    "max_projection": f"WITH {_PX} SELECT label, k, round(max(v), 6) AS v FROM g GROUP BY 1, 2",
    "gray_rescale": f"WITH {_PX} SELECT id AS vec_id, k, round((least(greatest(v, -0.1), 0.2) + 0.1) / (0.2::DOUBLE - -0.1::DOUBLE) * 255, 6) AS v FROM g",
    "clip_above": f"WITH {_PX} SELECT id AS vec_id, k, round(least(v, 0.1), 6) AS v FROM g",
    "image_quality": f"""WITH {_PX}, m AS (SELECT id, max(v) AS x, median(v) + 2 * stddev_pop(v) AS t FROM g GROUP BY 1)
SELECT id AS vec_id, round(100.0 * count(*) FILTER (WHERE v = x) / count(*), 6) AS percent_max, round(100.0 * count(*) FILTER (WHERE v > t) / count(*), 6) AS percent_median2sd FROM g JOIN m USING (id) GROUP BY 1""",
    "image_shapes": "SELECT label, min(len(embedding))::INT AS least, min(len(embedding)) = max(len(embedding)) AS equal FROM embeddings GROUP BY 1",
    "power_spectrum": f"WITH {_RINGS} SELECT id AS vec_id, k, round(power, 6) AS power FROM s",
    "power_slope": f"WITH {_RINGS} SELECT id AS vec_id, round(regr_slope(log10(power), log10(k)), 6) AS slope FROM s GROUP BY 1",
    "tas_features": "WITH x AS (" + " UNION ALL ".join(f"(WITH {_tas_sql(m)})" for m in range(4)) + ") SELECT vec_id, " + ", ".join(
        f'max(share) FILTER (WHERE mode = {m} AND percent = {p} AND n = {k}) AS "{feature_name("Ch1", m, p, k)}"' for m in range(4) for p in (PERCENTS if m < 3 else (0,)) for k in range(9)) + " FROM x GROUP BY 1",
    "bounding_boxes": f"WITH {_OBJ} SELECT id, object, min(r) - 1 AS r0, max(r) + 2 AS r1, min(c) - 1 AS c0, max(c) + 2 AS c1 FROM o GROUP BY 1, 2",
    "object_crops": f"WITH {_OBJ} SELECT id, object, r - min(r) OVER w + 1 AS y, c - min(c) OVER w + 1 AS x, round(v, 6) AS v FROM o WINDOW w AS (PARTITION BY id, object)",
    "object_measures": f"""WITH {_OBJ}, f AS (SELECT id, object, count(*) AS pixel_count, round(avg(v), 6) AS average_intensity, count(*)::DOUBLE AS m00, sum(c)::DOUBLE AS m10, sum(r)::DOUBLE AS m01,
sum(c * c)::DOUBLE AS m20, sum(r * r)::DOUBLE AS m02, sum(c * r)::DOUBLE AS m11 FROM o GROUP BY 1, 2), q AS (SELECT *, m20 + m02 AS b, m20 - m02 AS a, sqrt((m20 - m02) ** 2 + 4 * m11 ** 2) AS root FROM f)
SELECT * EXCLUDE (a, b, root), CASE WHEN b - root > 0 AND m11 <> 0 THEN round(sqrt(1 - a * a / (b * b)) * m00 / m11 * sqrt((b + root) / (b - root)), 6) END AS eccentricity FROM q""",
    "sized_objects": f"WITH {_OBJ} SELECT id, object, count(*) > 4 AND count(*) < 12 AS inside FROM o GROUP BY 1, 2",
    "mask_roundness": f"""WITH {_PX}, e AS (SELECT a.id, count(*) AS e FROM g a JOIN g b ON b.id = a.id AND ((b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1)) WHERE (a.v > 0) <> (b.v > 0) GROUP BY 1),
s AS (SELECT id, count(*) FILTER (WHERE v > 0) AS s FROM g GROUP BY 1) SELECT id AS vec_id, round(4 * pi() * s / (e::DOUBLE * e), 6) AS roundness FROM s JOIN e USING (id)""",
} | {f"tas_mode{m}": f"WITH {_tas_sql(m)}" for m in range(4)}
