"""Linear embeddings fitted by distributed sums: principal and independent components, landmark scaling, logistic scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellforge.functions.arrays import dot


def _stack(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def moments(df: DataFrame, vec: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and covariance (sample) of a vector column; each task sends one matrix of dim x dim."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if len(b):
                x = _stack(b[vec])
                n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})

    parts = df.filter(F.size(vec) == dim).select(vec).mapInPandas(partial, "n long, s array<double>, g array<double>")
    long = parts.select("n", F.concat("s", "g").alias("v")).select("n", F.posexplode("v").alias("k", "x"))
    total = np.zeros(dim + dim * dim)
    for r in long.groupBy("k").agg(F.sum("x").alias("x")).collect():
        total[r["k"]] = r["x"]
    n = parts.agg(F.sum("n")).first()[0] or 0
    mean = total[:dim] / max(n, 1)
    return n, mean, (total[dim:].reshape(dim, dim) - n * np.outer(mean, mean)) / max(n - 1, 1)


@dataclass(frozen=True)
class Projection:
    """A linear map with a centre: rows of `axes` are the components."""

    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray

    def names(self, prefix: str = "PC") -> list[str]:
        return [f"{prefix}{i + 1}({100 * r:.1f}%)" for i, r in enumerate(self.ratio)]

    def apply(self, vec: Column) -> Column:
        """The scores as an array: centred by the mean of the fit, all in the JVM."""
        centred = F.zip_with(vec, F.array(*(F.lit(float(m)) for m in self.mean)), lambda x, m: x - m)
        return F.array(*(dot(centred, F.array(*(F.lit(float(a)) for a in axis))) for axis in self.axes))


def _signed(axes: np.ndarray) -> np.ndarray:
    """Each axis with its largest loading positive."""
    top = np.abs(axes).argmax(1)
    return axes * np.sign(axes[np.arange(len(axes)), top])[:, None]


def principal_components(df: DataFrame, vec: str, dim: int, k: int) -> Projection:
    _, mean, cov = moments(df, vec, dim)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)[:k]
    return Projection(mean, _signed(vector[:, order].T), value[order], value[order] / value.sum())


def classical_scaling(df: DataFrame, vec: str, dim: int, k: int) -> Projection:
    """Classical scaling of the Euclidean distances of all rows: its positions are the scores of the principal components."""
    return principal_components(df, vec, dim, k)


def independent_components(df: DataFrame, vec: str, dim: int, k: int, rounds: int = 50, tolerance: float = 1e-4, seed: int = 0) -> Projection:
    """Fixed-point iteration with the log-cosh contrast on whitened rows; each round is one aggregation of k x k sums."""
    pca = principal_components(df, vec, dim, k)
    white = pca.axes / np.sqrt(pca.variance)[:, None]
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    rows = df.filter(F.size(vec) == dim).select(vec)
    for _ in range(rounds):
        current = w.copy()

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, slope, n = np.zeros((k, k)), np.zeros(k), 0
            for b in batches:
                if len(b):
                    z = (_stack(b[vec]) - pca.mean) @ white.T
                    t = np.tanh(z @ current.T)  # noqa: B023
                    total, slope, n = total + t.T @ z, slope + (1 - t * t).sum(0), n + len(z)
            yield pd.DataFrame({"v": [np.concatenate([total.ravel(), slope, [n]])]})

        sums = rows.mapInPandas(partial, "v array<double>").select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
        v = np.zeros(k * k + k + 1)
        for r in sums:
            v[r["k"]] = r["x"]
        step = v[: k * k].reshape(k, k) / v[-1] - (v[k * k : -1] / v[-1])[:, None] * w
        u, _, t = np.linalg.svd(step)
        w = u @ t
        if np.abs(np.abs((w * current).sum(1)) - 1).max() < tolerance:
            break
    return Projection(pca.mean, _signed(w @ white), np.ones(k), np.full(k, 1 / k))


@dataclass(frozen=True)
class Landmarks:
    """Classical scaling of a bounded set of landmark rows; other rows are placed by their distances to them."""

    points: np.ndarray
    pseudo: np.ndarray
    mean_square: np.ndarray

    def place(self, df: DataFrame, id_col: str, vec: str) -> DataFrame:
        """(id, position): every row, placed on its own in its task."""
        points, pseudo, mean_square = self.points, self.pseudo, self.mean_square

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = _stack(b["vec"])
                    d2 = ((x * x).sum(1)[:, None] - 2 * x @ points.T + (points * points).sum(1)[None, :]).clip(0)
                    yield pd.DataFrame({"id": b["id"], "position": list(-0.5 * (d2 - mean_square) @ pseudo.T)})

        return df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec")).mapInPandas(go, "id long, position array<double>")


def fit_landmarks(df: DataFrame, vec: str, k: int = 2, landmarks: int = 256, seed: int = 0) -> Landmarks:
    """Scaling to `k` dimensions fitted on at most `landmarks` rows (a documented bound), in the order of a seeded hash."""
    few = df.select(vec).orderBy(F.xxhash64(F.lit(seed), vec)).limit(landmarks).toPandas()
    x = _stack(few[vec])
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    n = len(x)
    centre = np.eye(n) - 1 / n
    value, vector = np.linalg.eigh(-0.5 * centre @ d2 @ centre)
    order = np.argsort(-value)[:k]
    return Landmarks(x, _signed(vector[:, order].T) / np.sqrt(value[order])[:, None], d2.mean(0))


def stress(original: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row (raw_stress, stress1) over the pairs (i, j, d) that both tables hold."""
    both = original.select("i", "j", F.col("d").alias("a")).join(embedded.select("i", "j", F.col("d").alias("b")), ["i", "j"])
    return both.agg(F.sum((F.col("a") - F.col("b")) ** 2).alias("raw_stress"), F.sqrt(F.sum((F.col("a") - F.col("b")) ** 2) / F.sum(F.col("a") ** 2)).alias("stress1"))


def logistic_scores(fit: DataFrame, rows: DataFrame, id_col: str, vec: str, label: str, c: float = 1.0) -> tuple[DataFrame, list[float]]:
    """L1 logistic regression: (id, probability, predicted) of `rows`, and the coefficients.

    The penalty per row is 1 / (c n), the usual inverse strength; the intercept is not penalised.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = fit.count()
    model = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=1 / (c * max(n, 1)), elasticNetParam=1.0, standardization=False).fit(fit.select(array_to_vector(vec).alias("_f"), F.col(label).cast("double").alias("_y")))
    scored = model.transform(rows.select(id_col, array_to_vector(vec).alias("_f")))
    return scored.select(id_col, vector_to_array("probability")[1].alias("probability"), F.col("prediction").cast("int").alias("predicted")), list(model.coefficients.toArray())
