"""ROC / AUC on the tied-score fixture (FIXTURES F7) against hand values."""

import pytest

from loanlens.operators import evaluate as EV

TIED = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)]


@pytest.fixture(scope="module")
def tied(spark):
    return spark.createDataFrame(TIED, "y int, s double")


def test_auc_ties_count_half(tied):
    assert EV.auc(tied, "y", "s").first()["auc"] == pytest.approx(4 / 6)


def test_roc_points(tied):
    pts = sorted((r["idx"], r["fpr"], r["tpr"]) for r in EV.roc_curve(tied, "y", "s").collect())
    assert [(round(f, 6), round(t, 6)) for _, f, t in pts] == [
        (0.0, 0.0), (round(1 / 3, 6), 0.5), (round(2 / 3, 6), 1.0), (1.0, 1.0)]


def test_drop_intermediate_removes_collinear(spark):
    # three equal steps of one positive each: the middle points are collinear
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    kept = sorted(r["idx"] for r in EV.roc_curve(df, "y", "s").collect())
    full = sorted(r["idx"] for r in EV.roc_curve(df, "y", "s", drop_intermediate=False).collect())
    assert full == [0, 1, 2, 3, 4] and kept == [0, 1, 3, 4]


def test_auc_matches_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.sql import functions as F
    df = spark.range(3000).select(((F.col("id") * 37 % 11) < 4).cast("int").alias("y"),
                                  ((F.col("id") * 13 % 97) / 97.0 + (F.col("id") % 3) / 10).alias("s"))
    ours = EV.auc(df, "y", "s").first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0)
    assert ours == pytest.approx(ev.evaluate(df.withColumn("y", F.col("y").cast("double"))), abs=1e-12)


def test_rmse_and_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, p double")
    r = EV.rmse(df, "y", "p").first()
    assert r["rmse"] == pytest.approx((0.5) ** 0.5)
    assert r["error_ratio"] == pytest.approx((0.5) ** 0.5 / 2.0)


def test_points_and_area_share_one_scan(spark):
    from pyspark.sql import functions as F
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 31 % 7 < 3).cast("int").alias("y"),
                                  (F.col("id") * 17 % 101 / 101).alias("s"))
    scan = EV.score_scan(EV.score_counts(df, "y", "s", ["g"]), "s", ["g"], partitions=4)
    key = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0], r[1]))
    assert key(EV.roc_curve(None, "y", "s", by=["g"], scan=scan).collect()) == key(
        EV.roc_curve(df, "y", "s", by=["g"], partitions=1).collect())
    aucs = {r["g"]: r["auc"] for r in EV.auc(None, "y", "s", by=["g"], scan=scan).collect()}
    assert aucs == {r["g"]: r["auc"] for r in EV.auc(df, "y", "s", by=["g"]).collect()}
    empty = df.where("g < 0")
    assert EV.roc_curve(empty, "y", "s", by=["g"]).count() == 0 and EV.roc_curve(empty, "y", "s").count() == 1


def test_null_scores_come_last(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, None)], "y int, s double")
    pts = sorted((r["idx"], r["threshold"]) for r in EV.roc_curve(df, "y", "s", drop_intermediate=False, partitions=3).collect())
    assert [i for i, _ in pts] == [0, 1, 2, 3] and pts[3][1] is None
    kept = {r["idx"] for r in EV.roc_curve(df, "y", "s", partitions=3).collect()}
    assert kept == {0, 1, 2, 3}
