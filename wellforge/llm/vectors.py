"""What the vector operators share: usable rows, distinct vectors, and arrays inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec) of the rows whose vector has `dim` elements, none null, NaN or infinite; null ids are left out."""
    v = F.col(vec_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) == dim) & good)
    # adding zero turns -0.0 into 0.0, so that equal vectors are equal keys
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))


def distinct_vectors(points: DataFrame, keep: int = 1) -> DataFrame:
    """(vid, vec, ids): every different vector once, with its `keep` smallest ids; vid is the smallest.

    Spark's group limit drops all but `keep` rows of a vector in each task before the shuffle, so a vector that fills a third
    of all rows costs no more than any other.
    """
    w = Window.partitionBy("vec").orderBy("id")
    few = points.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep)
    ids = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return ids.select(F.col("ids")[0].alias("vid"), "vec", "ids")


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float, copy=False) if len(column) else np.empty((0, dim))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of two matrices."""
    out = a @ b.T
    out *= -2
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)[None, :]
    return np.maximum(out, 0, out=out)
