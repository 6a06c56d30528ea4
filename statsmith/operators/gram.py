"""The Gram pass: n, means and the population covariance matrix of complete
rows, in one distributed aggregate.  Everything downstream (correlation,
Bartlett, KMO, PCA, factor analysis) is p x p driver arithmetic.

* p <= ``WIDE``: plain ``covar_pop`` aggregates (JVM, partial aggregation).
* wider: a pilot ``avg`` pass, then ``mapInArrow`` computes centred X^T X per
  Arrow batch with numpy; per-partition partials are summed by a
  ``groupBy(cell)`` (p^2 rows per partition at most) - never one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsmith.functions.columns import dbl, require_numeric

WIDE = 40


@dataclass
class Gram:
    cols: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray          # population (ddof 0) covariance

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    @property
    def corr(self) -> np.ndarray:
        s = self.std
        with np.errstate(invalid="ignore", divide="ignore"):
            r = self.cov / np.outer(s, s)
        np.fill_diagonal(r, 1.0)
        return r


def gram(df: DataFrame, cols: list[str]) -> Gram:
    require_numeric(df, cols)
    clean = df.select([dbl(c).alias(f"x{i}") for i, c in enumerate(cols)]).na.drop()
    p = len(cols)
    if p <= WIDE:
        aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]
        aggs += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
        r = clean.agg(*aggs).first()
        cov = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] if r[f"c{i}_{j}"] is not None else np.nan
        return Gram(cols, r["n"], np.array([r[f"m{i}"] for i in range(p)], dtype=float), cov)
    return _gram_wide(clean, cols)


def _gram_wide(clean: DataFrame, cols: list[str]) -> Gram:
    p = len(cols)
    pilot = clean.agg(*[F.avg(f"x{i}") for i in range(p)]).first()
    mu = np.array([v if v is not None else 0.0 for v in pilot], dtype=float)

    def partial(batches):
        n, s, c = 0, np.zeros(p), np.zeros((p, p))
        for b in batches:
            if b.num_rows == 0:
                continue
            X = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)]) - mu
            n += X.shape[0]
            s += X.sum(axis=0)
            c += X.T @ X
        ii, jj = np.triu_indices(p)
        # rows: (-1, -1) = n; (-1, k) = sum of centred x_k; (i, j) = cross-product
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1], np.full(p, -1), ii]), pa.int32()),
             pa.array(np.concatenate([[-1], np.arange(p), jj]), pa.int32()),
             pa.array(np.concatenate([[float(n)], s, c[ii, jj]]))],
            names=["i", "j", "v"])

    parts = clean.mapInArrow(partial, "i int, j int, v double")
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()   # bounded by p(p+3)/2 + 1
    n = int(next(r["v"] for r in cells if r["i"] == -1 and r["j"] == -1))
    d = np.zeros(p)
    C = np.zeros((p, p))
    for r in cells:
        if r["i"] == -1 and r["j"] >= 0:
            d[r["j"]] = r["v"] / n
        elif r["i"] >= 0:
            C[r["i"], r["j"]] = C[r["j"], r["i"]] = r["v"] / n
    cov = C - np.outer(d, d)
    return Gram(cols, n, mu + d, cov)
