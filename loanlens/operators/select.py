"""Feature selection: SEL1 importance threshold, SEL2 stepwise forward
selection (no floating), SEL3 refit on a selected list.

Stepwise selection scores every candidate with 5-fold CV at each step (up
to p x 10 x 5 fits). Both variants are batched so that the number of
passes over the data does not grow with candidates x folds:

* OLS: one Gram pass per fold (``linear.fold_grams``); every candidate fit
  and held-out error is then a small solve on the driver.
* Logistic: all candidate x fold models of one step are fitted together by
  Newton's method; each iteration is one ``mapInPandas`` pass summing
  gradients and Hessians of the models that still move, added up by a grouped
  sum. One more pass counts the held-out scores of every model in fixed bins,
  which bound its AUC from below and above. Only candidates whose upper bound
  reaches the best lower bound have their scores dealt by score range, sorted inside
  each range and compared exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig
from ..session import stored
from .linear import cv_rmse, fold_grams, moments
from .models import FittedModel, fit

#: Bins of a model's held-out scores; more bins give closer bounds and more rows to add up.
SCORE_BINS = 512
#: Rows of a step of a Newton pass.
ROWS = 256

TRACE_SCHEMA = ("step int, features array<string>, added string, avg_score double, "
                "std_score double")


# ------------------------------------------------------------------ SEL1

def select_by_importance(model: FittedModel, thresh: float) -> list[str]:
    """Features whose importance exceeds ``thresh`` (strict), in input order."""
    imp = model.estimator.featureImportances.toArray()
    return [f for f, v in zip(model.features, imp) if v > thresh]


def importance_features(train: DataFrame, features: list[str], label: str, kind: str, task: str,
                        cfg: RunConfig, thresh: float) -> tuple[list[str], FittedModel]:
    model = fit(train, features, label, kind, task, cfg)
    return select_by_importance(model, thresh), model


# ------------------------------------------------------------------ SEL2 (OLS)

def stepwise_ols(train: DataFrame, features: list[str], label: str, fold_col: str = "fold",
                 folds: int = 5, max_features: int = 10):
    """Forward selection scored by mean held-out negative RMSE.

    Returns ``(selected, trace)``; ``trace`` rows are ``(step, features,
    added, avg_score, std_score)`` and ``selected`` is the best step's set
    (the first on ties).
    """
    mean, scale = moments(train, features)
    grams = fold_grams(train, features, label, fold_col, mean, scale, folds)
    chosen: list[int] = []
    trace = []
    for step in range(1, min(max_features, len(features)) + 1):
        best = None
        for j in range(len(features)):
            if j in chosen:
                continue
            cols = [0] + [c + 1 for c in chosen + [j]]
            r = cv_rmse(grams, cols)
            if r is None:
                continue
            score = -float(np.mean(r))
            if best is None or score > best[0]:
                best = (score, j, float(np.std(r)))
        if best is None:
            break
        chosen.append(best[1])
        trace.append((step, [features[c] for c in chosen], features[best[1]], best[0], best[2]))
    top = max(range(len(trace)), key=lambda i: (trace[i][3], -i))
    return list(trace[top][1]), trace


# ------------------------------------------------------------------ SEL2 (logistic)

def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _packed(train: DataFrame, features, label, fold_col, mean, scale) -> DataFrame:
    """Blocks of standardised rows, written once: z, y, f (raw bytes). All passes of a selection read them as they are."""
    def part(it):
        for z, y, f in _unpacked(it, features, label, fold_col, mean, scale):
            yield pd.DataFrame({"z": [z.tobytes()], "y": [y.astype("int8").tobytes()], "f": [f.tobytes()]})

    return stored(train.select(*features, label, fold_col).mapInPandas(part, "z binary, y binary, f binary"), "standardised")


def _columns(df: DataFrame, features, label, fold_col) -> DataFrame:
    return df if df.columns == ["z", "y", "f"] else df.select(*features, label, fold_col)


def _unpacked(it, features, label, fold_col, mean, scale):
    """Standardised features, labels and folds of each batch of rows, or of each packed block."""
    for pdf in it:
        if list(pdf.columns) == ["z", "y", "f"]:
            for z, y, f in zip(pdf["z"], pdf["y"], pdf["f"]):
                yield np.frombuffer(z).reshape(-1, len(features)), np.frombuffer(y, "int8").astype("int64"), np.frombuffer(f, "int32")
        elif not pdf.empty:
            yield ((pdf[features].to_numpy(dtype=float) - mean) / scale, pdf[label].to_numpy().astype("int64"),
                   pdf[fold_col].to_numpy().astype("int32"))


def _newton_pass(df: DataFrame, features, label, fold_col, mean, scale, base, cands, weights,
                 folds):
    """One pass: gradient and Hessian of every (candidate, fold) model on the
    rows outside its fold. ``weights[c]`` is ``(folds, k + 2)``."""
    base, cands = list(base), list(cands)
    k, m, models = len(base) + 1, len(cands), len(cands) * folds
    d = k + 1
    one, two = np.triu_indices(k)

    def sums(z, y, f, flat):
        """Gradient and Hessian parts of a few rows: candidates share the columns chosen before, so one
        matrix product serves all models."""
        x = np.column_stack([np.ones(len(z)), z[:, base]])
        c = z[:, cands][:, :, None]
        eta = (x @ flat[:, :k].T).reshape(-1, m, folds) + c * flat[:, k].reshape(m, folds)
        p = _sigmoid(eta)
        mask = (f[:, None] != np.arange(folds)[None, :])[:, None, :]
        r, s = (p - y[:, None, None]) * mask, p * (1 - p) * mask
        rc, sc = r * c, s * c
        r, s, by = (a.reshape(-1, models).T for a in (r, s, sc))
        return np.hstack([r @ x, rc.sum(axis=0).reshape(-1, 1), s @ (x[:, one] * x[:, two]), by @ x,
                          (sc * c).sum(axis=0).reshape(-1, 1)])

    def part(it):
        flat, acc = weights.reshape(models, d), None
        for z, y, f in _unpacked(it, features, label, fold_col, mean, scale):
            for at in range(0, len(z), ROWS):       # a few rows' models stay in the processor's cache
                some = slice(at, at + ROWS)
                got = sums(z[some], y[some], f[some], flat)
                acc = got if acc is None else acc + got
        if acc is None:
            return
        h = np.empty((models, d, d))
        h[:, one, two] = h[:, two, one] = acc[:, d:d + len(one)]
        h[:, :k, k] = h[:, k, :k] = acc[:, d + len(one):-1]
        h[:, k, k] = acc[:, -1]
        cells = np.hstack([acc[:, :d], h.reshape(models, -1)])
        model = np.repeat(np.arange(models, dtype="int32"), cells.shape[1])
        yield pd.DataFrame({"cand": model // folds, "fold": model % folds,
                            "cell": np.tile(np.arange(cells.shape[1], dtype="int32"), models), "value": cells.ravel()})

    out = (_columns(df, features, label, fold_col).mapInPandas(part, "cand int, fold int, cell int, value double")
           .groupBy("cand", "fold", "cell").agg(F.sum("value").alias("value")).collect())
    grads = np.zeros((len(cands), folds, d))
    hess = np.zeros((len(cands), folds, d, d))
    for r in out:
        c, k, i, v = r["cand"], r["fold"], r["cell"], r["value"]
        if i < d:
            grads[c, k, i] = v
        else:
            hess[c, k].flat[i - d] = v
    return grads, hess


def _heldout_scores(df, features, label, fold_col, mean, scale, base, cands, weights, folds):
    base = list(base)

    def part(it):
        for z, y, f in _unpacked(it, features, label, fold_col, mean, scale):
            xb = np.column_stack([np.ones(len(z)), z[:, base]])
            for ci, c in enumerate(cands):
                x = np.column_stack([xb, z[:, c]])
                eta = np.einsum("ni,ni->n", x, weights[ci][f])
                yield pd.DataFrame({"cand": np.full(len(z), ci, dtype="int32"), "fold": f,
                                    "y": y.astype("int32"), "score": eta})

    return _columns(df, features, label, fold_col).mapInPandas(part, "cand int, fold int, y int, score double")


def _newton(train: DataFrame, features, label, fold_col, mean, scale, chosen, cands, weights, folds, c_inv, max_iter, tol, what):
    """Newton's method for all candidates and folds together, from ``weights``; a
    candidate whose weights no longer move in any fold leaves the passes."""
    d = len(chosen) + 2
    # penalty on raw coefficients: w_raw = w_z / s, so diag(1 / s^2) in z space
    pen = np.zeros((len(cands), d))
    for ci, c in enumerate(cands):
        pen[ci, 1:] = c_inv / scale[[*chosen, c]] ** 2
    weights, moving = weights.copy(), np.arange(len(cands))
    for _ in range(max_iter):
        w, q = weights[moving], pen[moving]
        g, h = _newton_pass(train, features, label, fold_col, mean, scale, chosen, [cands[i] for i in moving], w, folds)
        g = g + q[:, None, :] * w
        h = h + q[:, None, :, None] * np.eye(d)[None, None, :, :]
        step_w = np.linalg.solve(h, g[..., None])[..., 0]
        weights[moving] = w - step_w
        moving = moving[np.abs(step_w).max(axis=(1, 2)) >= tol]
        if not len(moving):
            return weights
    raise RuntimeError(f"Newton's method did not converge in {max_iter} iterations ({what})")


def _score_bins(df, features, label, fold_col, mean, scale, base, cands, weights, folds, bins) -> DataFrame:
    """cand, fold, bin, p, n, lo, hi: positives, negatives, smallest and largest held-out score of
    each bin. Bins are of equal width on a logistic curve about the mean log odds (the intercept, as
    features are standardised), scaled by the spread that independent features would give. The curve
    decides how close the bounds are, never whether they hold."""
    base = list(base)

    def part(it):
        acc = {}
        for z, y, f in _unpacked(it, features, label, fold_col, mean, scale):
            xb = np.column_stack([np.ones(len(z)), z[:, base]])
            for ci, c in enumerate(cands):
                w = weights[ci]
                eta = np.einsum("ni,ni->n", np.column_stack([xb, z[:, c]]), w[f])
                spread = np.maximum(np.sqrt((w[:, 1:] ** 2).sum(axis=1)), 1e-12)
                place = _sigmoid(1.7 * (eta - w[f, 0]) / spread[f])
                cell = f * bins + np.minimum((place * bins).astype("int64"), bins - 1)
                if ci not in acc:
                    acc[ci] = [np.zeros(folds * bins), np.zeros(folds * bins),
                               np.full(folds * bins, np.inf), np.full(folds * bins, -np.inf)]
                p, n, lo, hi = acc[ci]
                p += np.bincount(cell, y, folds * bins)
                n += np.bincount(cell, 1 - y, folds * bins)
                np.minimum.at(lo, cell, eta)
                np.maximum.at(hi, cell, eta)
        for ci, (p, n, lo, hi) in acc.items():
            at = np.flatnonzero(p + n)
            yield pd.DataFrame({"cand": np.full(len(at), ci, dtype="int32"), "fold": (at // bins).astype("int32"),
                                "bin": (at % bins).astype("int32"), "p": p[at].astype("int64"),
                                "n": n[at].astype("int64"), "lo": lo[at], "hi": hi[at]})

    long = _columns(df, features, label, fold_col).mapInPandas(part, "cand int, fold int, bin int, p long, n long, lo double, hi double")
    return long.groupBy("cand", "fold", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"),
                                                   F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def auc_bounds(binned: DataFrame) -> DataFrame:
    """cand, fold, lower, upper: bounds of the AUC from score bins. Pairs of different bins
    are in known order; pairs of one bin count nothing or all, and half where the bin holds one
    score. Null where a fold holds one class only."""
    model = Window.partitionBy("cand", "fold")      # at most as many rows as bins
    before = model.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    lower_n = F.coalesce(F.sum(n).over(before), F.lit(0.0))
    one = F.col("lo") == F.col("hi")
    pairs = binned.select("cand", "fold", p.alias("p"), n.alias("n"),
                          (p * lower_n + F.when(one, p * n / 2).otherwise(0.0)).alias("least"),
                          F.when(one, 0.0).otherwise(p * n).alias("open"))
    total = F.sum("p") * F.sum("n")
    return pairs.groupBy("cand", "fold").agg(
        F.try_divide(F.sum("least"), total).alias("lower"),
        F.try_divide(F.sum("least") + F.sum("open"), total).alias("upper"))


def _per_model(rows, size, folds, name) -> np.ndarray:
    out = np.full((size, folds), np.nan)
    for r in rows:
        if r[name] is not None:
            out[r["cand"], r["fold"]] = r[name]
    if np.isnan(out).any():
        raise ValueError("a fold holds one class only; its AUC is undefined")
    return out


def contenders(train, features, label, fold_col, mean, scale, chosen, cands, weights, folds, bins=SCORE_BINS) -> list[int]:
    """Places in ``cands`` that can still have the highest mean AUC of their folds."""
    return _contenders(train, features, label, fold_col, mean, scale, chosen, cands, weights, folds, bins)[0]


def _contenders(train, features, label, fold_col, mean, scale, chosen, cands, weights, folds, bins):
    """The ``contenders`` and their ``score_ranges``."""
    binned = stored(_score_bins(train, features, label, fold_col, mean, scale, chosen, cands, weights, folds, bins), "score-bins")
    rows = auc_bounds(binned).collect()
    lower = _per_model(rows, len(cands), folds, "lower").mean(axis=1)
    upper = _per_model(rows, len(cands), folds, "upper").mean(axis=1)
    # equal scores of two candidates are summed in different orders
    left = [int(i) for i in np.flatnonzero(upper >= lower.max() - 1e-9)]
    return left, score_ranges(binned.where(F.col("cand").isin(left)).toPandas(), left, folds, bins)


def score_ranges(binned: pd.DataFrame, cands: list[int], folds: int, bins: int) -> list[list[np.ndarray]]:
    """Per candidate and fold the ascending ends of ranges of about equal counts, from score bins (at most ``bins`` a
    model): a bin with more than its share is cut evenly between its smallest and largest score."""
    out = [[np.zeros(0)] * folds for _ in cands]
    for (c, f), g in binned.sort_values("bin").groupby(["cand", "fold"]):
        rows = (g["p"] + g["n"]).to_numpy()
        parts = np.ceil(rows * bins / rows.sum()).astype(int)
        out[cands.index(c)][f] = np.unique(np.concatenate(
            [np.linspace(lo, hi, k + 1)[1:] for lo, hi, k in zip(g["lo"], g["hi"], parts)]))
    return out


def fold_aucs(df, features, label, fold_col, mean, scale, base, cands, weights, folds, ranges) -> DataFrame:
    """cand, fold, auc: the exact AUC of held-out scores. Pairs of different ``ranges`` are in known order, so that
    scores meet only inside their range: one exchange, no global order. The ranges decide how evenly the rows are
    dealt, never the result; equal scores of a batch travel as one row."""
    base = list(base)

    def part(it):
        for z, y, f in _unpacked(it, features, label, fold_col, mean, scale):
            xb = np.column_stack([np.ones(len(z)), z[:, base]])
            for ci, c in enumerate(cands):
                eta = np.einsum("ni,ni->n", np.column_stack([xb, z[:, c]]), weights[ci][f])
                order = np.lexsort((eta, f))
                s, g, pos = eta[order], f[order], y[order]
                first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (g[1:] != g[:-1])]))
                p = np.add.reduceat(pos, first)
                n = np.diff(np.append(first, len(s))) - p
                s, g = s[first], g[first]
                at = np.empty(len(s), "int32")
                for k in range(folds):
                    at[g == k] = np.searchsorted(ranges[ci][k], s[g == k])
                yield pd.DataFrame({"cand": np.full(len(s), ci, dtype="int32"), "fold": g, "range": at, "score": s, "p": p, "n": n})

    by, p, n = ["cand", "fold", "range"], F.col("p"), F.col("n")
    upto = Window.partitionBy(*by).orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    scores = _columns(df, features, label, fold_col).mapInPandas(part, "cand int, fold int, range int, score double, p long, n long")
    # (negatives up to each positive) - (positives up to each negative) + all pairs: twice the pairs in order, ties half
    inside = scores.select(*by, "p", "n", (p * F.sum("n").over(upto) - n * F.sum("p").over(upto)).alias("d"))
    sums = inside.groupBy(*by).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("d").alias("d"))
    before = Window.partitionBy("cand", "fold").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    twice = 2 * p * F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("d") + p * n
    return sums.select("cand", "fold", "p", "n", twice.cast("double").alias("twice")).groupBy("cand", "fold").agg(
        F.try_divide(F.sum("twice"), 2.0 * F.sum("p") * F.sum("n")).alias("auc"))


def fold_logistic_scores(train: DataFrame, features: list[str], label: str, fold_col: str = "fold", folds: int = 5,
                         c_inv: float = 1.0, max_iter: int = 25, tol: float = 1e-6) -> DataFrame:
    """fold, y, score: every row scored (log odds) by the logistic regression on all features that leaves its fold
    out; all folds are fitted together, one pass per Newton step."""
    mean, scale = moments(train, features)
    train = _packed(train, features, label, fold_col, mean, scale)
    base, cands = list(range(len(features) - 1)), [len(features) - 1]
    weights = _newton(train, features, label, fold_col, mean, scale, base, cands, np.zeros((1, folds, len(features) + 1)),
                      folds, c_inv, max_iter, tol, "all features")
    return _heldout_scores(train, features, label, fold_col, mean, scale, base, cands, weights, folds).drop("cand")


def stepwise_logistic(train: DataFrame, features: list[str], label: str, fold_col: str = "fold",
                      folds: int = 5, max_features: int = 10, c_inv: float = 1.0,
                      max_iter: int = 25, tol: float = 1e-6, bins: int = SCORE_BINS):
    """Forward selection for L2 logistic regression (scikit-learn's C = 1 on
    raw features), each candidate scored by mean held-out AUC. Newton stops
    when no standardised weight moves by more than ``tol`` (Newton converges
    quadratically; scikit-learn's own solver stops at a gradient tolerance
    of 1e-4). The choice does not depend on ``bins``, which only decide how many
    candidates are left for the exact comparison."""
    mean, scale = moments(train, features)
    train = _packed(train, features, label, fold_col, mean, scale)
    chosen: list[int] = []
    prev_w = np.zeros((folds, 1))             # intercept only
    trace = []
    for step in range(1, min(max_features, len(features)) + 1):
        cands = [j for j in range(len(features)) if j not in chosen]
        d = len(chosen) + 2
        # warm start: previous step's weights, 0 for the new coefficient
        weights = np.zeros((len(cands), folds, d))
        weights[:, :, : d - 1] = prev_w[None, :, :]
        weights = _newton(train, features, label, fold_col, mean, scale, chosen, cands, weights, folds, c_inv, max_iter, tol,
                          f"step {step}")
        left, ranges = _contenders(train, features, label, fold_col, mean, scale, chosen, cands, weights, folds, bins)
        exact = fold_aucs(train, features, label, fold_col, mean, scale, chosen, [cands[i] for i in left], weights[left],
                          folds, ranges)
        per = _per_model(exact.collect(), len(left), folds, "auc")
        avg = per.mean(axis=1)
        top = int(avg.argmax())
        best = left[top]
        chosen.append(cands[best])
        prev_w = weights[best]
        trace.append((step, [features[c] for c in chosen], features[cands[best]],
                      float(avg[top]), float(per[top].std())))
    top = max(range(len(trace)), key=lambda i: (trace[i][3], -i))
    return list(trace[top][1]), trace


def trace_frame(spark, trace) -> DataFrame:
    return spark.createDataFrame(trace, TRACE_SCHEMA)
