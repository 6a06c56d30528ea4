"""Feature helpers: standardisation and random Fourier features.

Random Fourier features (Rahimi & Recht 2007) approximate an RBF kernel
exp(-gamma ||x - x'||^2) by z(x) = sqrt(2/D) cos(W x + b) with
W ~ N(0, 2 gamma), b ~ U(0, 2 pi).  The projection runs in
an Arrow-batched pandas UDF (one numpy matrix product per batch).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.functions.columns import TMP


@dataclass
class Standardizer:
    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, features: str = "features") -> "Standardizer":
        arr = vector_to_array(F.col(features))
        p = len(df.select(features).first()[0])
        r = df.select(arr.alias(TMP + "a")).agg(
            *[F.avg(F.col(TMP + "a")[i]).alias(f"m{i}") for i in range(p)],
            *[F.stddev_pop(F.col(TMP + "a")[i]).alias(f"s{i}") for i in range(p)]).first()
        m = np.array([r[f"m{i}"] for i in range(p)], dtype=float)
        s = np.array([r[f"s{i}"] for i in range(p)], dtype=float)
        s[~np.isfinite(s) | (s == 0)] = 1.0
        return cls(m, s)

    def columns(self, features: str = "features") -> list:
        a = vector_to_array(F.col(features))
        return [(a[i] - F.lit(float(self.mean[i]))) / F.lit(float(self.std[i])) for i in range(len(self.mean))]


@dataclass
class RandomFourier:
    W: np.ndarray      # D x p
    b: np.ndarray      # D

    @classmethod
    def make(cls, p: int, gamma: float, n_components: int = 100, seed: int = 42) -> "RandomFourier":
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n_components, p)),
                   rng.uniform(0.0, 2 * np.pi, size=n_components))


def with_rff(df: DataFrame, std: Standardizer, rff: RandomFourier, features: str = "features",
             out: str = "features") -> DataFrame:
    """Replace the feature vector by its random Fourier features (computed on
    standardised inputs).  The projection is a dense D x p product per row, so
    it runs as an Arrow-batched pandas UDF doing one matrix multiply per batch
    (as Column expressions it would exceed the JVM method size for D ~ 100+)."""
    mu, sd, W, b = std.mean, std.std, rff.W, rff.b
    scale = float(np.sqrt(2.0 / W.shape[0]))

    @F.pandas_udf("array<double>")
    def project(s: pd.Series) -> pd.Series:
        if len(s) == 0:
            return pd.Series([], dtype=object)
        X = (np.stack(s.to_numpy()) - mu) / sd
        return pd.Series(list(np.cos(X @ W.T + b) * scale))

    return df.withColumn(out, array_to_vector(project(vector_to_array(F.col(features)))))
