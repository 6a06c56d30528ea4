"""Dimensionality reduction (H1-H7).

The correlation matrix is a sufficient statistic for both PCA of
standardised data and maximum-likelihood factor analysis, so the data is read
once by the Gram pass; eigen-decompositions and EM iterations run on p x p
matrices on the driver; scores are appended as linear Column expressions
(no join, NULL on incomplete rows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statsmith.functions.columns import dbl, require_numeric
from statsmith.operators.clean import append_derived
from statsmith.operators.gram import Gram, gram


@dataclass
class Reduction:
    method: str
    loadings: DataFrame        # variable, <component columns>
    variance: DataFrame        # component, eigenvalue/variance, pct, cumulative pct
    scores: DataFrame          # input frame with PC*/Factor* columns appended
    loadings_matrix: np.ndarray
    values: np.ndarray
    correlation: np.ndarray | None = None      # of the factors; None when they are uncorrelated
    structure: np.ndarray | None = None        # correlations of variables and factors
    uniqueness: np.ndarray | None = None


def _check(df: DataFrame, cols: list[str], k: int) -> None:
    require_numeric(df, cols)
    if len(cols) < 2:
        raise ValueError("need at least 2 numeric variables")
    if not 1 <= k <= len(cols):
        raise ValueError("number of components must be between 1 and the number of variables")


def _fix_signs(L: np.ndarray) -> np.ndarray:
    """Make the largest-magnitude loading of every column positive; among
    loadings equal in magnitude up to rounding (1e-12) the first one wins, so
    the rule does not depend on floating-point noise."""
    A = np.abs(L)
    near = A >= A.max(axis=0) - 1e-12
    idx = np.argmax(near, axis=0)
    s = np.sign(L[idx, np.arange(L.shape[1])])
    s[s == 0] = 1.0
    return L * s


def _score_exprs(g: Gram, A: np.ndarray, names: list[str]) -> dict[str, Column]:
    """z_j = sum_i A_ij (x_i - mean_i) / std_i, as Column expressions."""
    out = {}
    sd = np.where(g.std > 0, g.std, 1.0)
    for j, name in enumerate(names):
        e = F.lit(0.0)
        for i, c in enumerate(g.cols):
            e = e + (dbl(c) - F.lit(float(g.mean[i]))) * F.lit(float(A[i, j] / sd[i]))
        out[name] = e
    return out


def _loadings_frame(df: DataFrame, cols, L: np.ndarray, names) -> DataFrame:
    rows = [(c, *[float(v) for v in L[i]]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, ["variable", *names])


def pca(df: DataFrame, cols: list[str], k: int = 2) -> Reduction:
    """H1: PCA of standardised (ddof 0) complete rows.  Eigenvalues use the
    n - 1 divisor (n/(n-1) eig(R)); Variance % = eigenvalue / sum of all
    eigenvalues; loadings are unit eigenvectors; scores PC1..PCk."""
    _check(df, cols, k)
    g = gram(df, cols)
    n, p = g.n, len(cols)
    corr = g.corr
    flat = g.std == 0
    corr[flat, :] = corr[:, flat] = 0.0               # a constant column scales to zeros
    evals, evecs = np.linalg.eigh(corr)
    order = np.argsort(evals)[::-1]
    evals, evecs = evals[order], evecs[:, order]
    lam = evals * n / (n - 1)
    L = _fix_signs(evecs[:, :k])
    names = [f"PC{j + 1}" for j in range(k)]
    pct = lam / lam.sum() * 100.0
    var = df.sparkSession.createDataFrame(
        [(names[j], float(lam[j]), float(pct[j]), float(pct[:j + 1].sum())) for j in range(k)],
        "component string, eigenvalue double, variance_pct double, cumulative_pct double")
    scores = append_derived(df, _score_exprs(g, L, names), cols)
    return Reduction("pca", _loadings_frame(df, cols, L, names), var, scores, L, lam[:k])


def _varimax_like(L: np.ndarray, gamma: float, tol: float = 1e-6, max_iter: int = 100) -> np.ndarray:
    p, k = L.shape
    T = np.eye(k)
    crit = 0.0
    for _ in range(max_iter):
        B = L @ T
        target = B ** 3 - (B * ((B ** 2).sum(axis=0) / p) if gamma else 0.0)
        u, s, vt = np.linalg.svd(L.T @ target)
        T = u @ vt
        new = s.sum()
        if crit != 0 and new < crit * (1 + tol):
            break
        crit = new
    return L @ T


def varimax(L: np.ndarray) -> np.ndarray:
    """H3: orthogonal varimax rotation (<= 100 iterations, tol 1e-6)."""
    return _varimax_like(L, 1.0)


def quartimax(L: np.ndarray) -> np.ndarray:
    """H4: orthogonal quartimax rotation."""
    return _varimax_like(L, 0.0)


def promax(L: np.ndarray, power: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """H5: oblique promax (Hendrickson & White 1964): varimax, then a least
    squares fit to the powered target.  Returns the pattern P = V T and the
    correlation of the factors Phi = (T'T)^-1, so P Phi P' = L L'; T is scaled
    to factors of variance 1."""
    V = varimax(L)
    Q = np.sign(V) * np.abs(V) ** power
    M = np.linalg.lstsq(V, Q, rcond=None)[0]
    T = M * np.sqrt(np.diag(np.linalg.inv(M.T @ M)))
    return V @ T, np.linalg.inv(T.T @ T)


def _plain(rotate):
    return lambda L: (rotate(L), np.eye(L.shape[1]))


ROTATIONS = {"varimax": _plain(varimax), "quartimax": _plain(quartimax), "promax": promax, None: _plain(lambda L: L),
             "none": _plain(lambda L: L)}


def fa_fit(R: np.ndarray, n: int, k: int, tol: float = 1e-2, max_iter: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood factor analysis on a correlation matrix (the SVD
    form of the EM updates on standardised data).  Returns (W k x p, psi)."""
    p = R.shape[0]
    psi = np.ones(p)
    old = -np.inf
    const = p * np.log(2 * np.pi) + k
    W = np.zeros((k, p))
    for _ in range(max_iter):
        s = np.sqrt(psi) + 1e-12
        ev, vec = np.linalg.eigh(R / np.outer(s, s))
        order = np.argsort(ev)[::-1]
        ev, vec = ev[order], vec[:, order]
        top = ev[:k]
        W = (np.sqrt(np.maximum(top - 1.0, 0.0))[:, None] * vec[:, :k].T) * s
        ll = -n / 2.0 * (const + np.log(top).sum() + ev[k:].sum() + np.log(psi).sum())
        if ll - old < tol:
            break
        old = ll
        psi = np.maximum(1.0 - (W ** 2).sum(axis=0), 1e-12)
    return W, psi


def factor_analysis(df: DataFrame, cols: list[str], k: int = 2, rotation: str | None = "varimax") -> Reduction:
    """H2: ML factor analysis of standardised complete rows, optional rotation
    (varimax, quartimax, promax).  Variance of each factor = population
    variance of its scores = diag(A^T R A); ratio = variance / p (the
    reference's definition: share of the total standardised variance).  Scores
    are posterior means, A = Psi^-1 P (Phi^-1 + P' Psi^-1 P)^-1, where Phi is
    the correlation of oblique factors and the identity for the others.  A
    constant variable has loadings 0 and takes no part in the fit."""
    _check(df, cols, k)
    if rotation not in ROTATIONS:
        raise ValueError(f"rotation must be one of {list(ROTATIONS)}")
    g = gram(df, cols)
    at = np.flatnonzero(g.std > 0)
    if len(at) < max(2, k):
        raise ValueError(f"{k} factors need {max(2, k)} variables that vary; {len(at)} do")
    R = g.corr[np.ix_(at, at)]
    W, psi = fa_fit(R, g.n, k)
    P, phi = ROTATIONS[rotation](W.T)
    signed = _fix_signs(P)
    flip = np.where((signed * P).sum(axis=0) < 0, -1.0, 1.0)
    P, phi = signed, phi * np.outer(flip, flip)
    weighted = P / psi[:, None]
    weights = weighted @ np.linalg.inv(np.linalg.inv(phi) + P.T @ weighted)
    v = np.diag(weights.T @ R @ weights)
    L, A, uniqueness = np.zeros((len(cols), k)), np.zeros((len(cols), k)), np.ones(len(cols))
    L[at], A[at], uniqueness[at] = P, weights, psi
    p = len(cols)
    names = [f"Factor{j + 1}" for j in range(k)]
    ratio = v / p * 100.0
    var = df.sparkSession.createDataFrame(
        [(names[j], float(v[j]), float(ratio[j]), float(ratio[:j + 1].sum())) for j in range(k)],
        "component string, variance double, variance_pct double, cumulative_pct double")
    scores = append_derived(df, _score_exprs(g, A, names), cols)
    return Reduction("fa", _loadings_frame(df, cols, L, names), var, scores, L, v,
                     correlation=phi if rotation == "promax" else None, structure=L @ phi, uniqueness=uniqueness)
