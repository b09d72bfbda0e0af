"""Evaluation (EVA1-EVA5): accuracy, ROC points, AUC, RMSE, error ratio.

ROC and AUC need a global order of scores. Rows are first reduced to one row
per distinct score (combined map-side, so a score shared by a third of the
rows is one row), then the cumulative counts come from the range-partitioned
prefix sum of ``prefix.py`` — no single-task window, and one exchange of the
scores for points and area together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_sums


def accuracy(df: DataFrame, label: str, pred: str, by: list[str] = ()) -> DataFrame:
    """EVA1: share of rows whose predicted class equals the label."""
    return df.groupBy(*by).agg(
        F.avg((F.col(pred) == F.col(label)).cast("int")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def score_counts(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(label).cast("long")
    return df.groupBy(*by, score).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))


def accuracy_from_counts(counts: DataFrame, score: str, by: list[str] = (),
                         threshold: float = 0.5) -> DataFrame:
    """EVA1 from per-score counts when the class is ``score > threshold``."""
    hit = F.when(F.col(score) > threshold, F.col("p")).otherwise(F.col("n"))
    return counts.groupBy(*by).agg(
        (F.sum(hit) / F.sum(F.col("p") + F.col("n"))).alias("accuracy"),
        F.sum(F.col("p") + F.col("n")).alias("n"))


def score_scan(counts: DataFrame, score: str, by: list[str] = (), partitions: int | None = None) -> DataFrame:
    """The distinct scores in descending order: ``idx`` and ``m`` (place and number of
    scores), running counts and totals of positives and negatives, and the counts at the
    next score. ROC points and AUC of one run share it, and with it one exchange."""
    g = counts.withColumn("_one", F.lit(1).cast("long"))
    c = prefix_sums(g, [score], ["_one", "p", "n"], group=list(by), descending=True, partitions=partitions,
                    ahead=["p", "n"])
    return c.withColumnRenamed("_one_cum", "idx").withColumnRenamed("_one_total", "m")


def roc_curve(df: DataFrame, label: str, score: str, by: list[str] = (),
              drop_intermediate: bool = True, partitions: int | None = None,
              counts: DataFrame | None = None, scan: DataFrame | None = None) -> DataFrame:
    """EVA2: ROC points (scikit-learn ``roc_curve``), one curve per ``by`` group.

    Thresholds are the distinct scores in descending order; each point holds
    the cumulative false / true positive rates; the curve starts at (0, 0)
    with a null threshold. With ``drop_intermediate`` a point is dropped when
    both second differences vanish, which for step counts means the next
    distinct score has the same (positives, negatives) as this one.
    ``counts`` (``score_counts``) or ``scan`` (``score_scan``) replace ``df``.
    Columns: ``by..., idx, threshold, fpr, tpr``.
    """
    by = list(by)
    if scan is None:
        scan = score_scan(counts if counts is not None else score_counts(df, label, score, by), score, by, partitions)
    c = scan
    if drop_intermediate:
        c = c.where((F.col("idx") == 1) | (F.col("idx") == F.col("m")) | (F.col("m") <= 2)
                    | (F.col("p_next") != F.col("p")) | (F.col("n_next") != F.col("n")))
    point = F.struct(F.col("idx").cast("long").alias("idx"), F.col(score).cast("double").alias("threshold"),
                     (F.col("n_cum") / F.col("n_total")).alias("fpr"),
                     (F.col("p_cum") / F.col("p_total")).alias("tpr"))
    origin = F.struct(F.lit(0).cast("long").alias("idx"), F.lit(None).cast("double").alias("threshold"),
                      F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    if not by:      # one curve, its origin there without any rows too
        return c.select(point.alias("_x")).select("_x.*").unionByName(
            c.sparkSession.range(1).select(origin.alias("_x")).select("_x.*"))
    # the first point of a curve brings the origin along
    both = F.when(F.col("idx") == 1, F.array(origin, point)).otherwise(F.array(point))
    return c.select(*by, F.explode(both).alias("_x")).select(*by, "_x.*")


def auc(df: DataFrame, label: str, score: str, by: list[str] = (),
        partitions: int | None = None, counts: DataFrame | None = None,
        scan: DataFrame | None = None) -> DataFrame:
    """EVA3: area under the ROC curve by the trapezoid rule.

    Each distinct score adds a trapezoid of width n_s / N and mean height
    (TP_before + p_s / 2) / P, so one aggregate over the prefix sums gives the
    area; ties count half, as in scikit-learn. ``counts`` or ``scan`` as in ``roc_curve``.
    """
    by = list(by)
    c = scan
    if c is None:
        g = counts if counts is not None else score_counts(df, label, score, by)
        c = prefix_sums(g, [score], ["p", "n"], group=by, descending=True, partitions=partitions)
    area = F.sum(F.col("n") * (F.col("p_cum") - F.col("p") / 2.0))
    return c.groupBy(*by).agg(
        F.try_divide(area, F.first("p_total").cast("double") * F.first("n_total").cast("double")).alias("auc"))


def rmse(df: DataFrame, label: str, pred: str, by: list[str] = ()) -> DataFrame:
    """EVA4 + AGG17 + EVA5: RMSE, mean target and RMSE / mean target."""
    err = F.col(label).cast("double") - F.col(pred).cast("double")
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.col(label).cast("double")).alias("target_mean"),
        F.count(F.lit(1)).alias("n")).withColumn(
        "error_ratio", F.col("rmse") / F.col("target_mean"))
