"""Distributed sufficient statistics for linear models.

``fold_grams`` makes one pass over the rows: every partition forms, per fold,
the Gram matrix of ``[1, z_1 .. z_p, y]`` (z = standardised features) with
NumPy, emits it as ``(fold, cell, value)`` rows, and a grouped sum (combined
map-side) adds the partitions up. The driver receives folds x (p + 2)^2
numbers, whatever the row count; any OLS fit on any feature subset and any
union of folds is then a small solve with no further scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations (1 for a constant column), one aggregate."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    m = np.array([row[f"m_{i}"] or 0.0 for i in range(len(cols))], dtype=float)
    s = np.array([row[f"s_{i}"] or 0.0 for i in range(len(cols))], dtype=float)
    s[~(s > 1e-12)] = 1.0
    return m, s


def fold_grams(df: DataFrame, features: list[str], label: str, fold_col: str,
               mean: np.ndarray, scale: np.ndarray, folds: int) -> np.ndarray:
    """Gram matrices per fold, shape ``(folds, p + 2, p + 2)``; index 0 is the
    intercept column, index p + 1 the label."""
    p = len(features)
    d = p + 2
    cols = list(features) + [label, fold_col]

    def part(it):
        acc = np.zeros((folds, d, d))
        seen = False
        for pdf in it:
            if pdf.empty:
                continue
            seen = True
            z = (pdf[features].to_numpy(dtype=float) - mean) / scale
            y = pdf[label].to_numpy(dtype=float)
            f = pdf[fold_col].to_numpy()
            m = np.column_stack([np.ones(len(pdf)), z, y])
            for k in range(folds):
                sel = m[f == k]
                if len(sel):
                    acc[k] += sel.T @ sel
        if seen:
            kk, ii = np.meshgrid(np.arange(folds), np.arange(d * d), indexing="ij")
            yield pd.DataFrame({"fold": kk.ravel().astype("int32"),
                                "cell": ii.ravel().astype("int32"),
                                "value": acc.reshape(-1)})

    sums = (df.select(*cols).mapInPandas(part, "fold int, cell int, value double")
            .groupBy("fold", "cell").agg(F.sum("value").alias("value")).collect())
    g = np.zeros((folds, d * d))
    for r in sums:
        g[r["fold"], r["cell"]] = r["value"]
    return g.reshape(folds, d, d)


def ols_from_gram(g: np.ndarray, cols: list[int], ridge: float = 0.0):
    """Coefficients on the columns ``cols`` (0 = intercept) from a Gram matrix;
    None when the system is singular."""
    y = g.shape[0] - 1
    a = g[np.ix_(cols, cols)]
    b = g[cols, y]
    if ridge:
        a = a + ridge * np.eye(len(cols))
    try:
        # reject near-singular systems (collinear dummies and flags)
        if np.linalg.cond(a) > 1e12:
            return None
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None


def sse_from_gram(g: np.ndarray, cols: list[int], beta: np.ndarray) -> float:
    y = g.shape[0] - 1
    a = g[np.ix_(cols, cols)]
    b = g[cols, y]
    return float(g[y, y] - 2 * beta @ b + beta @ a @ beta)


def cv_rmse(grams: np.ndarray, cols: list[int]) -> list[float] | None:
    """Per-fold held-out RMSE of OLS on ``cols`` fitted on the other folds."""
    total = grams.sum(axis=0)
    out = []
    for k in range(grams.shape[0]):
        beta = ols_from_gram(total - grams[k], cols)
        if beta is None:
            return None
        n = grams[k][0, 0]
        out.append(float(np.sqrt(max(sse_from_gram(grams[k], cols, beta), 0.0) / n)))
    return out
