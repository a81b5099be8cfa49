"""Column functions on small images held as flat, row-major arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PERCENTS = (10, 20, 30, 40, 50, 60, 70, 80, 90)


def rescaled(px: Column, low: float, high: float, to_low: float = 0.0, to_high: float = 255.0) -> Column:
    """Values clipped to [low, high] and mapped linearly to [to_low, to_high]."""
    return F.transform(px, lambda x: (F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) / (high - low) * (to_high - to_low) + to_low)


def clipped(px: Column, threshold: float) -> Column:
    return F.transform(px, lambda x: F.least(x, F.lit(threshold)))


def masks_of(images: np.ndarray, mean: np.ndarray, mode: int, percent: int) -> np.ndarray:
    """Which pixels pass the mode's threshold against the mean of their image; `mean` is NaN for images without foreground.

    Mode 0: within +-percent of the mean; 1: at least mean less percent; 2: at least mean plus percent; 3: at least the mean.
    """
    m, p = mean.reshape(-1, *[1] * (images.ndim - 1)), percent / 100
    if mode == 0:
        return (images >= m * (1 - p)) & (images < m * (1 + p))
    return images >= m * {1: 1 - p, 2: 1 + p, 3: 1}[mode]


def adjacency_shares(masks: np.ndarray, deep: bool) -> np.ndarray:
    """For each mask of a stack (image, plane, row, column) the share of its white pixels with 0, 1 .. white neighbours.

    Eight neighbours in the plane, or with `deep` the 26 of three planes; pixels outside count as black. Zeros without white ones.
    """
    n, d, h, w = masks.shape
    padded = np.pad(masks.astype(np.int8), ((0, 0), (int(deep), int(deep)), (1, 1), (1, 1)))
    around = sum(padded[:, z : z + d, r : r + h, c : c + w] for z in range(3 if deep else 1) for r in range(3) for c in range(3)) - masks
    classes = 27 if deep else 9
    image = np.broadcast_to(np.arange(n).reshape(-1, 1, 1, 1), masks.shape)
    counts = np.bincount(image[masks] * classes + around[masks], minlength=n * classes).reshape(n, classes)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def components(inside: np.ndarray) -> np.ndarray:
    """Labels of a stack of masks (image, plane, row, column): pixels that touch along an axis share 1 + their first position."""
    n, d, h, w = inside.shape
    big = d * h * w + 1
    own = np.pad(np.arange(1, big).reshape(1, d, h, w), ((0, 0), (1, 1), (1, 1), (1, 1)))
    white = np.pad(inside, ((0, 0), (1, 1), (1, 1), (1, 1)))
    now = np.where(white, own, big)
    while True:
        new = now.copy()
        for axis in (1, 2, 3):
            for by in (-1, 1):
                new = np.minimum(new, np.roll(now, by, axis))
        new = np.where(white, new, big)
        if (new == now).all():
            return np.where(white, now, 0)[:, 1:-1, 1:-1, 1:-1]
        now = new


def signed_distance(mask: np.ndarray) -> np.ndarray:
    """For each pixel of a plane the distance to the nearest pixel of the other kind, negative outside of the mask.

    Without any pixel of the other kind, rows plus columns. First along the columns, then exact over each row.
    """
    h, w = mask.shape

    def nearest(other: np.ndarray) -> np.ndarray:
        far = float(h + w)
        along = np.where(other, 0.0, far)
        for r in range(1, h):
            along[r] = np.minimum(along[r], along[r - 1] + 1)
        for r in range(h - 2, -1, -1):
            along[r] = np.minimum(along[r], along[r + 1] + 1)
        apart = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
        return np.minimum(np.sqrt(np.stack([(apart + along[r][None, :] ** 2).min(1) for r in range(h)])), far)

    return np.where(mask, nearest(~mask), -nearest(mask))


def linear(volume: np.ndarray, to: tuple[int, int, int]) -> np.ndarray:
    """A volume at the size `to`, corners kept, linear in between."""
    for axis, n in enumerate(to):
        size = volume.shape[axis]
        at = np.arange(n) * ((size - 1) / max(n - 1, 1))
        low = np.clip(np.floor(at).astype(int), 0, max(size - 2, 0))
        share = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        volume = np.take(volume, low, axis) * (1 - share) + np.take(volume, np.minimum(low + 1, size - 1), axis) * share
    return volume


def feature_name(channel: str, mode: int, percent: int, neighbours: int) -> str:
    """Name of a texture feature: modes 0-2 count through 27 per percent, mode 3 has numbers from 28 and no percent."""
    return f"{channel}_TXT_TAS_{neighbours + 28}" if mode == 3 else f"{channel}_TXT_TAS_{neighbours + 9 * mode + 1}_{percent}"
