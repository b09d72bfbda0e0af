"""Model comparison tables (EVA9-EVA12, ORD1, ORD3, SET1, SET2, FLT4, FLT5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def _split_title():
    return F.when(F.col("split") == "test", "Test").otherwise("Train")


def label_roc(points: DataFrame, aucs: DataFrame, model: str, by: list[str] = ("split",)) -> DataFrame:
    """ROC points with the reference's legend texts:
    ``label = "AUC <Split>: 0.xxx"`` and ``model_auc = "<model> AUC: 0.xxx"``."""
    by = list(by)
    j = points.join(aucs, on=by, how="left")
    return j.select(
        F.lit(model).alias("model"), *by, "idx", "threshold", "fpr", "tpr", "auc",
        F.format_string("AUC %s: %.3f", _split_title(), F.col("auc")).alias("label"),
        F.format_string("%s AUC: %.3f", F.lit(model), F.col("auc")).alias("model_auc"))


def label_models(points: DataFrame, aucs: DataFrame) -> DataFrame:
    """``label_roc`` for the curves of several models, named in ``model``."""
    j = points.join(aucs, on=["model", "split"], how="left")
    return j.select(
        "model", "split", "idx", "threshold", "fpr", "tpr", "auc",
        F.format_string("AUC %s: %.3f", _split_title(), F.col("auc")).alias("label"),
        F.format_string("%s AUC: %.3f", F.col("model"), F.col("auc")).alias("model_auc"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """SET1: stack frames with the same columns (matched by name)."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_missing(frames: list[DataFrame]) -> DataFrame:
    """SET2: stack frames whose columns differ; missing ones become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def contains(df: DataFrame, col: str, text: str) -> DataFrame:
    """FLT4: case-sensitive substring filter."""
    return df.where(F.contains(F.col(col), F.lit(text)))


def keep_max(df: DataFrame, col: str) -> DataFrame:
    """FLT5: rows equal to the column's maximum, all ties kept. A semi join on
    the one-row maximum (no cross join, no single-task window). The rows are written
    first: a sum computed twice may differ in its last digit and equal no row."""
    df = reliable_checkpoint(df)
    top = df.agg(F.max(col).alias(col))
    return df.join(top, on=col, how="left_semi")


def rank_rmse(df: DataFrame) -> DataFrame:
    """ORD1 / EVA11: RMSE comparison ascending, ties by model name."""
    return df.orderBy(F.asc("rmse"), F.asc_nulls_last("model"))


def best_step(trace: DataFrame, score: str = "avg_score", step: str = "step") -> DataFrame:
    """ORD3: the step with the highest average score (the first on ties)."""
    return trace.orderBy(F.desc(score), F.asc(step)).limit(1)
