"""Measures of images and of the objects in them, from flat pixel arrays or pixel tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellforge.functions.images import PERCENTS, adjacency_shares, components, feature_name, linear, masks_of, signed_distance


def pixels(images: DataFrame, id_col: str, px: str, width: int) -> DataFrame:
    """(id, r, c, v): one row per pixel, in the row-major order of the array."""
    flat = images.select(F.col(id_col).alias("id"), F.posexplode(px).alias("k", "v"))
    return flat.select("id", F.floor(F.col("k") / width).cast("int").alias("r"), (F.col("k") % width).cast("int").alias("c"), F.col("v").cast("double").alias("v"))


def projected_pixels(planes: DataFrame, by: Sequence[str], px: str) -> DataFrame:
    """(by.., k, v): the largest value of every pixel over the planes of a stack, whatever their size and number.

    Pixels are folded in the tasks before the shuffle, so a stack of any depth is spread over all of them.
    """
    return planes.select(*by, F.posexplode(px).alias("k", "v")).groupBy(*by, "k").agg(F.max("v").alias("v"))


def projection(planes: DataFrame, by: Sequence[str], px: str) -> DataFrame:
    """(by.., px): the projection of every stack as one flat image."""
    rows = projected_pixels(planes, by, px).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("_p"))
    return rows.select(*by, F.transform("_p", lambda x: x["v"]).alias(px))


def _stacks(batch: pd.DataFrame, plane: int, most_pixels: int = 1 << 22) -> Iterator[tuple[list, np.ndarray]]:
    """The images of a batch with equal numbers of pixels, together: (their ids, array of image and pixel); nulls as empty ones."""
    size = batch["px"].map(lambda x: 0 if x is None else len(x) // plane * plane)
    for n, own in batch.groupby(size):
        step = max(1, most_pixels // max(n, 1))
        for at in range(0, len(own), step):
            part = own.iloc[at : at + step]
            flat = [np.asarray(x[:n], dtype=float) if n else np.empty(0) for x in part["px"]]
            yield part["id"].tolist(), np.stack(flat)


def percent_at_maximum(px: Column) -> Column:
    return 100.0 * F.size(F.filter(px, lambda x: x == F.array_max(px))) / F.size(px)


def image_statistics(images: DataFrame, id_col: str, px: str) -> DataFrame:
    """(id, percent_max, percent_median2sd): pixels at the maximum, and pixels above the median plus two standard deviations."""
    s1 = images.select(F.col(id_col).alias("id"), F.transform(px, lambda x: x.cast("double")).alias("px"))
    s2 = s1.select("id", "px", F.array_sort("px").alias("o"), F.size("px").alias("n"), (F.aggregate("px", F.lit(0.0), lambda s, x: s + x) / F.size("px")).alias("mean"))
    spread = F.sqrt(F.aggregate("px", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / F.col("n"))
    middle = (F.get("o", F.floor((F.col("n") - 1) / 2).cast("int")) + F.get("o", F.floor(F.col("n") / 2).cast("int"))) / 2
    s3 = s2.withColumn("limit", middle + 2 * spread)
    return s3.select("id", percent_at_maximum(F.col("px")).alias("percent_max"), (100.0 * F.size(F.filter("px", lambda x: x > F.col("limit"))) / F.col("n")).alias("percent_median2sd"))


def bounding_boxes(labelled: DataFrame, by: Sequence[str], margin: int = 0) -> DataFrame:
    """(by.., r0, r1, c0, c1): rows and columns that each label spans, the ends exclusive, widened by `margin` on each side."""
    return labelled.groupBy(*by).agg((F.min("r") - margin).alias("r0"), (F.max("r") + 1 + margin).alias("r1"), (F.min("c") - margin).alias("c0"), (F.max("c") + 1 + margin).alias("c1"))


def crops(labelled: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each object's pixels in the coordinates of its own box with a border of one: (by.., y, x, v)."""
    boxes = bounding_boxes(labelled, by, margin=1)
    return labelled.join(boxes, list(by)).select(*by, (F.col("r") - F.col("r0")).alias("y"), (F.col("c") - F.col("c0")).alias("x"), "v")


def object_features(labelled: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., pixel_count, average_intensity, m00, m10, m01, m20, m02, m11, eccentricity): size, mean and raw moments of each object."""
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    return labelled.groupBy(*by).agg(
        F.count("*").alias("pixel_count"), F.avg("v").alias("average_intensity"), F.count("*").cast("double").alias("m00"), F.sum(c).alias("m10"), F.sum(r).alias("m01"),
        F.sum(c * c).alias("m20"), F.sum(r * r).alias("m02"), F.sum(c * r).alias("m11"),
    ).withColumn("eccentricity", eccentricity(*map(F.col, ("m00", "m20", "m02", "m11"))))


def eccentricity(m00: Column, m20: Column, m02: Column, m11: Column) -> Column:
    """The eccentricity of a mask from its raw moments; null where it is not defined, as for objects along an axis or in one line."""
    both, apart = m20 + m02, m20 - m02
    root = F.sqrt(apart * apart + 4 * m11 * m11)
    shape = F.sqrt(F.when(both > 0, 1 - apart * apart / (both * both)))
    return F.when(both - root > 0, shape * F.try_divide(m00, m11) * F.sqrt((both + root) / (both - root)))


def roundness(bits: Column, width: int) -> Column:
    """4 pi area / perimeter squared; the perimeter counts changes between neighbouring pixels along rows and columns."""
    last = F.size(bits) - 1
    along = F.filter(F.sequence(F.lit(0), last - 1), lambda i: ((i + 1) % width != 0) & (F.get(bits, i) != F.get(bits, i + 1)))
    down = F.filter(F.sequence(F.lit(0), last - width), lambda i: F.get(bits, i) != F.get(bits, i + width))
    edge = (F.size(along) + F.size(down)).cast("double")
    area = F.aggregate(bits, F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(4 * F.pi() * area, edge * edge)


def adjacency_features(images: DataFrame, id_col: str, px: str, width: int, modes: Sequence[int] = (0, 1, 2, 3), percents: Sequence[int] = PERCENTS, height: int | None = None) -> DataFrame:
    """(id, mode, percent, tas): threshold adjacency statistics, nine shares for each mode and percent (mode 3 has percent 0).

    With a height the images are stacks of planes of that height, and there are 27 shares. Null and empty images have zeros.
    All images of an Arrow batch with one size are done together, mask after mask, and leave the task as their shares: no pixel
    table, no shuffle, and of a large image no more than one mask at a time.
    """
    wanted = [(m, p) for m in modes if m < 3 for p in percents] + ([(3, 0)] if 3 in modes else [])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, flat in _stacks(b, width * (height or 1)):
                x = flat.reshape(len(ids), -1, height, width) if height else flat.reshape(len(ids), 1, -1, width)
                inside = x > 0
                mean = np.where(inside, x, 0).sum((1, 2, 3)) / np.where((n := inside.sum((1, 2, 3))) > 0, n, np.nan)
                for mode, percent in wanted:
                    yield pd.DataFrame({"id": ids, "mode": mode, "percent": percent, "tas": list(adjacency_shares(masks_of(x, mean, mode, percent), height is not None))})

    one = images.select(F.col(id_col).cast("long").alias("id"), F.transform(px, lambda x: x.cast("double")).alias("px"))
    return one.mapInPandas(measure, "id long, mode int, percent int, tas array<double>")


def texture_features(images: DataFrame, id_col: str, px: str, width: int, channel: str) -> DataFrame:
    """One row per image with all named texture features of a channel: 252 of them, nine for each of 28 masks."""
    wanted = [(m, p) for m in range(3) for p in PERCENTS] + [(3, 0)]
    rows = adjacency_features(images, id_col, px, width)
    wide = rows.groupBy("id").agg(*(F.max(F.when((F.col("mode") == m) & (F.col("percent") == p), F.col("tas"))).alias(f"_{m}_{p}") for m, p in wanted))
    return wide.select("id", *(F.col(f"_{m}_{p}")[k].alias(feature_name(channel, m, p, k)) for m, p in wanted for k in range(9)))


def power_rings(images: DataFrame, id_col: str, px: str, width: int) -> DataFrame:
    """(id, k, power): mean squared Fourier amplitude in each ring of whole wave numbers, times the ring's area.

    Images are cropped to a square from the top left. Images of one size are transformed together in their Arrow batch.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, flat in _stacks(b, width):
                x = flat.reshape(len(ids), -1, width)
                n = min(x.shape[1:])
                if n < 2:
                    continue
                power = np.abs(np.fft.fft2(x[:, :n, :n])) ** 2
                wave = np.fft.fftfreq(n) * n
                ring = np.floor(np.hypot(wave[:, None], wave[None, :]) + 0.5).astype(int).ravel()
                k = np.arange(1, n // 2 + 1)
                mean = np.stack([np.bincount(ring, p.ravel())[k] for p in power]) / np.bincount(ring)[k]
                area = np.pi * ((k + 0.5) ** 2 - (k - 0.5) ** 2)
                yield pd.DataFrame({"id": np.repeat(ids, len(k)), "k": np.tile(k, len(ids)), "power": (mean * area).ravel()})

    one = images.select(F.col(id_col).cast("long").alias("id"), F.transform(px, lambda x: x.cast("double")).alias("px"))
    return one.mapInPandas(measure, "id long, k int, power double")


def power_slope(rings: DataFrame) -> DataFrame:
    """(id, slope): slope of log10 power over log10 wave number."""
    return rings.groupBy("id").agg(F.regr_slope(F.log10("power"), F.log10("k")).alias("slope"))


def illumination(images: DataFrame, by: Sequence[str], px: str) -> DataFrame:
    """(by.., k, flat, dark): per pixel the median over the images relative to its mean over pixels, and the 5 % quantile.

    A robust stand-in for a fitted shading model: medians ignore what single images show.
    """
    pixel = images.select(*by, F.posexplode(px).alias("k", "v"))
    per = pixel.groupBy(*by, "k").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.05)).alias("dark"))
    whole = per.groupBy(*by).agg(F.avg("m").alias("_mean"))
    return per.join(whole, list(by)).select(*by, "k", F.try_divide("m", "_mean").alias("flat"), "dark")


def resized(images: DataFrame, id_col: str, px: str, width: int, rows: int, columns: int) -> DataFrame:
    """(id, px): images of `rows` x `columns` whose corners are those of the originals, linear in between. No shuffle."""

    def grow(x: Column, k: Column) -> Column:
        height = F.size(x) / F.lit(width)
        y = F.floor(k / columns) * ((height - 1) / max(rows - 1, 1))
        c = (k % columns) * ((width - 1) / max(columns - 1, 1))
        y0, c0 = F.least(F.floor(y), height.cast("int") - 2), F.least(F.floor(c), F.lit(width - 2))
        at = lambda i, j: F.get(x, ((y0 + i) * width + c0 + j).cast("int"))
        u, v = y - y0, c - c0
        return at(0, 0) * (1 - u) * (1 - v) + at(0, 1) * (1 - u) * v + at(1, 0) * u * (1 - v) + at(1, 1) * u * v

    grid = F.sequence(F.lit(0), F.lit(rows * columns - 1))
    return images.select(F.col(id_col).alias("id"), F.col(px).alias("_x")).select("id", F.transform(grid, lambda k: grow(F.col("_x"), k)).alias("px"))


def resized_volume(volumes: DataFrame, id_col: str, px: str, shape: tuple[int | None, int, int], to: tuple[int, int, int]) -> DataFrame:
    """(id, px): stacks of `shape` (depth, rows, columns) at the size `to`, corners kept, linear in between. No shuffle.

    A depth of None takes each stack's own number of planes.
    """
    (depth, h, w), (nd, nh, nw) = shape, to

    def along(k: Column, n: int, size: Column | int) -> tuple[Column, Column]:
        size = size if isinstance(size, Column) else F.lit(size)
        at = k * ((size - 1) / max(n - 1, 1))
        low = F.least(F.floor(at), F.greatest(size - 2, F.lit(0)))
        return low, at - low

    def grow(x: Column, k: Column) -> Column:
        d = F.floor(F.size(x) / (h * w)).cast("int") if depth is None else depth
        (z, a), (r, b), (c, e) = along(F.floor(k / (nh * nw)), nd, d), along(F.floor(k / nw) % nh, nh, h), along(k % nw, nw, w)
        corner = lambda i, j, l: F.coalesce(F.get(x, (((z + i) * h + r + j) * w + c + l).cast("int")), F.lit(0.0))
        side = lambda t, i: t if i else 1 - t
        return sum((corner(i, j, l) * side(a, i) * side(b, j) * side(e, l) for i in (0, 1) for j in (0, 1) for l in (0, 1)), F.lit(0.0))

    grid = F.sequence(F.lit(0), F.lit(nd * nh * nw - 1))
    return volumes.select(F.col(id_col).alias("id"), F.col(px).alias("_x")).select("id", F.transform(grid, lambda k: grow(F.col("_x"), k)).alias("px"))


def segment(images: DataFrame, id_col: str, px: str, width: int, threshold: float, height: int | None = None) -> DataFrame:
    """(id, labels): 0 for background; pixels above `threshold` that touch along rows or columns share 1 + their first position.

    With a height the images are stacks of planes of that height, and voxels touch along the third axis too. A classical substitute
    for a trained segmenter. All images of a batch with one size are labelled together: each pass takes the smallest label among
    neighbours, until none changes. Null images have no labels.
    """

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, flat in _stacks(b, width * (height or 1)):
                x = flat.reshape(len(ids), -1, height, width) if height else flat.reshape(len(ids), 1, -1, width)
                yield pd.DataFrame({"id": ids, "labels": list(components(x > threshold).reshape(len(ids), -1).astype("int32"))})

    one = images.select(F.col(id_col).cast("long").alias("id"), F.transform(px, lambda x: x.cast("double")).alias("px"))
    return one.mapInPandas(label, "id long, labels array<int>")


def interpolated_labels(volumes: DataFrame, id_col: str, labels: str, height: int, width: int, to: tuple[int, int, int]) -> DataFrame:
    """(id, labels): labelled stacks of planes at the size `to` (depth, rows, columns), each object's shape interpolated.

    An object is the signed distance from its outline in each plane; the distances are linear between planes, rows and columns, and
    where they are above zero is the object. Where objects overlap the higher label stays. Volumes are worked on one by one.
    """

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, flat in _stacks(b, width * height):
                made = []
                for one in flat.reshape(len(ids), -1, height, width).astype("int32"):
                    out = np.zeros(to, "int32")
                    for k in np.unique(one[one > 0]):
                        out[linear(np.stack([signed_distance(p == k) for p in one]), to) > 0] = k
                    made.append(out.ravel())
                yield pd.DataFrame({"id": ids, "labels": made})

    one = volumes.select(F.col(id_col).cast("long").alias("id"), F.transform(labels, lambda x: x.cast("double")).alias("px"))
    return one.mapInPandas(grow, "id long, labels array<int>")


def resized_labels(volumes: DataFrame, id_col: str, labels: str, height: int, width: int, to: tuple[int, int, int]) -> DataFrame:
    """(id, labels): labelled stacks of planes at the size `to`, each voxel with the label of the nearest of the originals."""
    (nd, nh, nw) = to
    place = lambda k, n, size: F.least(F.floor((k + 0.5) * size / n), size - 1)

    def grow(x: Column) -> Column:
        depth = F.floor(F.size(x) / (height * width)).cast("int")
        at = lambda k: (place(F.floor(k / (nh * nw)), nd, depth) * height + place(F.floor(k / nw) % nh, nh, F.lit(height))) * width + place(k % nw, nw, F.lit(width))
        return F.transform(F.sequence(F.lit(0), F.lit(nd * nh * nw - 1)), lambda k: F.get(x, at(k).cast("int")))

    return volumes.select(F.col(id_col).alias("id"), grow(F.col(labels)).alias("labels"))
