"""Assessment of one fitted model (the reference's ``process_model``):
accuracy, ROC and AUC (classifier) or RMSE and error ratio (regressor) on
train and test, optional CV score, as rows of a long ``metrics`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..session import reliable_checkpoint
from . import evaluate as EV
from .models import CLASSIFIER, FittedModel, score
from .tune import cross_validate

METRICS_SCHEMA = "run string, model string, task string, split string, metric string, value double"


def assess(model: FittedModel, data: DataFrame, cfg: RunConfig, run: str = "default",
           split_col: str = "split", cv: bool = False, fold_col: str = "fold",
           label_name: str | None = None, overrides: dict | None = None) -> tuple[list[tuple], DataFrame | None]:
    """Metrics rows ``(run, model, task, split, metric, value)`` and, for a
    classifier, the ROC points of both splits. ``overrides`` are the tuned
    parameters the model was fitted with; cross-validation refits with them."""
    name = label_name or model.name
    rows, roc = assess_scored(score(model, data), name, model.task, model.label, cfg, run, split_col)
    if cv:
        metric = "auc" if model.task == CLASSIFIER else "rmse"
        v = cross_validate(data.where(F.col(split_col) == "train"), model.features, model.label, model.kind, model.task, cfg,
                           metric, fold_col=fold_col, **(overrides or {}))
        rows.append((run, name, model.task, "train_cv", metric, v))
    return rows, roc


def assess_scored(scored: DataFrame, name: str, task: str, label: str, cfg: RunConfig, run: str = "default",
                  split_col: str = "split") -> tuple[list[tuple], DataFrame | None]:
    """The metrics rows and ROC points of any scored frame."""
    rows: list[tuple] = []
    if task == CLASSIFIER:
        # one pass over the rows: positives / negatives per (split, score);
        # accuracy (class = score > 0.5), AUC and ROC all come from it
        counts = reliable_checkpoint(EV.score_counts(scored, label, "score", [split_col]))
        acc = EV.accuracy_from_counts(counts, "score", by=[split_col]).collect()
        scan = EV.score_scan(counts, "score", [split_col])
        aucs = EV.auc(None, label, "score", by=[split_col], scan=scan).collect()
        rows += [(run, name, task, r[split_col], "accuracy", float(r["accuracy"])) for r in acc]
        rows += [(run, name, task, r[split_col], "auc", float(r["auc"])) for r in aucs]
        return rows, EV.roc_curve(None, label, "score", by=[split_col],
                                  drop_intermediate=cfg.drop_intermediate, scan=scan)
    for r in EV.rmse(scored, label, "score", by=[split_col]).collect():
        rows += [(run, name, task, r[split_col], m, float(r[m])) for m in ("rmse", "target_mean", "error_ratio")]
    return rows, None


def assess_models(scored: DataFrame, task: str, label: str, run: str = "default", split_col: str = "split") -> list[tuple]:
    """The metrics rows of several models at once: ``scored`` has their names in ``model``."""
    by = ["model", split_col]
    if task == CLASSIFIER:
        counts = reliable_checkpoint(EV.score_counts(scored, label, "score", by))
        found = [(r, "accuracy") for r in EV.accuracy_from_counts(counts, "score", by=by).collect()]
        found += [(r, "auc") for r in EV.auc(None, label, "score", by=by, counts=counts).collect()]
    else:
        found = [(r, m) for r in EV.rmse(scored, label, "score", by=by).collect() for m in ("rmse", "target_mean", "error_ratio")]
    return [(run, r["model"], task, r[split_col], m, float(r[m])) for r, m in found]


def metrics_frame(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, METRICS_SCHEMA)
