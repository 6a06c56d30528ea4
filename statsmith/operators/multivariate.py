"""Sampling-adequacy tests (G11, G12) from the Gram pass."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from statsmith.functions import dist
from statsmith.operators.gram import gram
from statsmith.operators.tests_parametric import ALPHA


def bartlett_sphericity(df: DataFrame, cols: list[str]) -> DataFrame:
    """chi2 = -((n - 1) - (2p + 5) / 6) ln det R, df = p (p - 1) / 2.
    With a constant variable R does not exist: chi2, p and significant are
    NULL and the verdict says so."""
    if len(cols) < 2:
        raise ValueError("Bartlett's test needs at least 2 variables")
    g = gram(df, cols)
    p, n = len(cols), g.n
    sign, logdet = np.linalg.slogdet(g.corr)
    if np.isfinite(g.corr).all() and (sign <= 0 or np.linalg.matrix_rank(g.corr) < p):
        chi2 = float("inf")                       # collinear variables: det R is 0, so ln det R has no bound
    else:
        chi2 = -((n - 1) - (2 * p + 5) / 6.0) * logdet if sign > 0 else float("nan")
    dof = p * (p - 1) / 2.0
    pv = 0.0 if math.isinf(chi2) else dist.chi2_sf(chi2, dof) if not math.isnan(chi2) else float("nan")
    sig = (pv < ALPHA) if not math.isnan(pv) else None
    verdict = ("correlations differ from identity: factor analysis is appropriate" if sig
               else "correlations do not differ from identity: factor analysis may not be appropriate")
    if math.isnan(chi2):
        chi2 = pv = None
        verdict = "undefined: " + (", ".join(_constant(g)) + " does not vary" if _constant(g) else "too few complete rows")
    return df.sparkSession.createDataFrame(
        [(int(n), p, chi2 if chi2 is None else float(chi2), float(dof), pv if pv is None else float(pv),
          None if sig is None else bool(sig), verdict)],
        "n long, n_vars long, chi2 double, df double, p_value double, significant boolean, verdict string")


def _constant(g) -> list[str]:
    return [c for c, s in zip(g.cols, g.std, strict=True) if not s > 0]


# Kaiser's interpretation bands for the KMO measure.
KMO_BANDS = [(0.9, "Marvelous"), (0.8, "Meritorious"), (0.7, "Middling"), (0.6, "Mediocre"),
             (0.5, "Miserable")]


def kmo_band(v: float) -> str:
    for lo, name in KMO_BANDS:
        if v is not None and not math.isnan(v) and v >= lo:
            return name
    return "Unacceptable"


def kmo_values(R: np.ndarray) -> tuple[np.ndarray, float]:
    inv = np.linalg.inv(R)
    d = np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    q = -inv / d
    r2, q2 = R ** 2, q ** 2
    np.fill_diagonal(r2, 0.0)
    np.fill_diagonal(q2, 0.0)
    per = r2.sum(axis=0) / (r2.sum(axis=0) + q2.sum(axis=0))
    overall = r2.sum() / (r2.sum() + q2.sum())
    return per, float(overall)


def kmo(df: DataFrame, cols: list[str]) -> DataFrame:
    """Kaiser-Meyer-Olkin measure per variable and overall
    (``variable = '__overall__'``), with interpretation bands.  A constant
    variable has no correlations: its measure is NULL ("undefined"), and the
    others are measured without it; fewer than two that vary leave all of them
    undefined.  Of collinear variables the inverse does not exist: undefined."""
    if len(cols) < 2:
        raise ValueError("KMO needs at least 2 variables")
    g = gram(df, cols)
    flat = set(_constant(g))
    at = [i for i, c in enumerate(cols) if c not in flat]
    R = g.corr[np.ix_(at, at)]
    per, overall = {}, None
    if len(at) > 1 and np.isfinite(R).all() and np.linalg.matrix_rank(R) == len(at):
        values, overall = kmo_values(R)
        per = {cols[i]: float(v) for i, v in zip(at, values, strict=True)}
    rows = [(c, per.get(c), kmo_band(per[c]) if c in per else "undefined") for c in cols]
    rows.append(("__overall__", overall, "undefined" if overall is None else kmo_band(overall)))
    return df.sparkSession.createDataFrame(rows, "variable string, msa double, interpretation string")
