"""Cross-validation and grid search (TUN1-TUN3) on a precomputed fold column (TUN4), so folds are
the same for every model and do not depend on partitioning.

All folds (and grid points) are trained in the same passes: trees, forests and boosting by the
batched histogram trainer, logistic regression by Newton sums that leave each fold out, OLS from
one Gram matrix per fold. Other models go through Spark ML's ``CrossValidator``."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import (BinaryClassificationEvaluator,
                                   MulticlassClassificationEvaluator, RegressionEvaluator)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame

from ..config import RunConfig
from . import trees as T
from .evaluate import auc
from .linear import fold_grams, moments, sse_from_gram
from .models import assembler, make_estimator
from .select import fold_logistic_scores

TREES = ("tree", "forest", "boost")


def evaluator(kind: str, task: str, label: str, metric: str):
    if metric == "auc":
        # numBins=0: exact AUC, no score down-sampling
        return BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol=label,
                                             metricName="areaUnderROC", numBins=0)
    if metric == "accuracy":
        return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return RegressionEvaluator(labelCol=label, metricName=metric)   # rmse / r2


def tree_point(kind: str, cfg: RunConfig, **overrides) -> dict:
    """The run's settings of a tree model as one grid point."""
    base = {"tree": {"maxDepth": cfg.max_depth, "minInstancesPerNode": 1},
            "forest": {"maxDepth": cfg.max_depth, "numTrees": cfg.num_trees, "bootstrap": True},
            "boost": {"maxDepth": cfg.max_depth, "maxIter": cfg.boost_iters, "stepSize": cfg.step_size}}[kind]
    return {**base, **overrides}


def cross_validate(train: DataFrame, features: list[str], label: str, kind: str, task: str,
                   cfg: RunConfig, metric: str, fold_col: str = "fold", key: str = "k",
                   rows: T.Binned | None = None, **overrides) -> float:
    """TUN2 / TUN3: mean over folds of the metric of the model fitted on the other folds. ``rows``: the
    binned training rows, where several tree models share them."""
    if kind in TREES:
        rows = rows or T.bin_rows(train, features, label, fold_col, key, cfg.max_bins)
        return T.search(rows, kind, task, [tree_point(kind, cfg, **overrides)], cfg.folds, cfg.seed, refit=False).cv(metric)
    if kind == "logistic" and metric == "auc" and not overrides:
        scored = fold_logistic_scores(train, features, label, fold_col, cfg.folds)
        return float(np.mean([r["auc"] for r in auc(scored, "y", "score", by=["fold"]).collect()]))
    if kind == "linear" and metric == "rmse" and not overrides:
        return float(np.mean(fold_rmse(train, features, label, fold_col, cfg.folds)))
    est = make_estimator(kind, task, label, cfg, n_features=len(features), **overrides)
    cv = CrossValidator(estimator=Pipeline(stages=[assembler(features), est]), estimatorParamMaps=ParamGridBuilder().build(),
                        evaluator=evaluator(kind, task, label, metric), numFolds=cfg.folds,
                        foldCol=fold_col, parallelism=cfg.folds)
    return float(cv.fit(train).avgMetrics[0])


def fold_rmse(train: DataFrame, features: list[str], label: str, fold_col: str, folds: int) -> list[float]:
    """Held-out RMSE of OLS per fold from the folds' Gram matrices (two scans in all). Collinear
    columns get the least-norm solution: predictions are those of any other."""
    mean, scale = moments(train, features)
    grams = fold_grams(train, features, label, fold_col, mean, scale, folds)
    cols, total, out = list(range(len(features) + 1)), grams.sum(axis=0), []
    for g in grams:
        rest = total - g
        beta = np.linalg.lstsq(rest[np.ix_(cols, cols)], rest[cols, -1], rcond=1e-12)[0]
        out.append(float(np.sqrt(max(sse_from_gram(g, cols, beta), 0.0) / g[0, 0])))
    return out


def tree_search(train: DataFrame, features: list[str], label: str, kind: str, task: str, cfg: RunConfig,
                fold_col: str = "fold", key: str = "k", rows: T.Binned | None = None) -> T.Search:
    """TUN1: the run's grid of a tree model, scored by accuracy or R2, with the refitted best model."""
    rows = rows or T.bin_rows(train, features, label, fold_col, key, cfg.max_bins)
    return T.search(rows, kind, task, T.grid_points(cfg.grid[kind]), cfg.folds, cfg.seed)


def grid_search(train: DataFrame, features: list[str], label: str, kind: str, task: str,
                cfg: RunConfig, fold_col: str = "fold", key: str = "k"):
    """TUN1: (best params, table of every combination with its mean score)."""
    rows = T.bin_rows(train, features, label, fold_col, key, cfg.max_bins)
    found = T.search(rows, kind, task, T.grid_points(cfg.grid[kind]), cfg.folds, cfg.seed, refit=False)
    return found.best, found.table
