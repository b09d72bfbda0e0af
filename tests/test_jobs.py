"""The three entry points run end to end at sf0.001 and write their tables."""

import os
import tempfile

from conftest import SF001
from loanlens.config import RiskSchema, RunConfig
from loanlens.plans import jobs
from loanlens.sources.frames import risk_frame

S = RiskSchema.risk_frame()
SMALL = RunConfig(num_trees=5, boost_iters=3, epochs_classifier=2, epochs_regressor=2,
                  activations=("relu",), hidden_layers=(1,), dropouts=(True,), max_stepwise=2)


def test_profile_job_writes_tables(spark):
    out = tempfile.mkdtemp()
    tables = jobs.profile_job(risk_frame(spark, SF001), S, SMALL, out=out)
    assert set(os.listdir(out)) == {*tables, "manifest"}
    assert spark.read.parquet(os.path.join(out, "expected_loss")).count() == 10


def test_fit_job(spark):
    out = tempfile.mkdtemp()
    t = jobs.fit_job(risk_frame(spark, SF001), S, SMALL, kinds=("tree",), cv=False, out=out)
    assert {"prepare_null_counts_before", "prepare_group_medians", "prepare_null_counts_after",
            "prepare_amount_before_cap", "prepare_amount_after_cap", "prepare_first_rows_before",
            "prepare_first_rows_after", "split_classifier", "split_regressor", "roc_comparison"} <= set(os.listdir(out))
    assert {r["label"].split(":")[0] for r in t["roc_comparison"].collect()} == {"AUC Test"}
    m = {(r["model"], r["split"], r["metric"]) for r in t["metrics"].collect()}
    assert ("tree_classifier", "test", "auc") in m and ("tree_regressor", "test", "rmse") in m
    assert t["tree_nodes"].count() > 1


def test_compare_job_writes_csv(spark):
    out = tempfile.mkdtemp()
    t = jobs.compare_job(risk_frame(spark, SF001), S, SMALL, out=out)
    names = os.listdir(out)
    assert "RMSE-Comparison--ep2-var-All-rs1-md5-ft0.005.csv" in names
    models = {r["model"] for r in t["rmse_comparison"].collect()}
    assert {"LR", "DT", "RF", "GB"} <= models and any(m.startswith("TF-") for m in models)
    labels = {r["model_auc"].split(" AUC")[0] for r in t["roc_comparison"].collect()}
    assert {"LR", "DT", "RF", "GB"} <= labels
    cv = {r["model"] for r in t["metrics"].where("split = 'train_cv'").collect()}
    assert cv == {"LR", "DT", "RF", "GB"}
    assert t["network_roc_comparison"].count() > 0


def test_linear_job(spark):
    t = jobs.linear_job(risk_frame(spark, SF001), S, SMALL)
    sels = {r["selection"] for r in t["selections"].collect()}
    assert {"All", "stepwise"} <= sels
    assert t["stepwise_trace"].count() == 4


def test_fit_job_grid_and_compare_with_selection(spark):
    df = risk_frame(spark, SF001)
    t = jobs.fit_job(df, S, SMALL, kinds=("tree",), grid=True, cv=False)
    assert {r["run"] for r in t["metrics"].collect()} == {"grid"}
    c = jobs.compare_job(df, S, SMALL, var_model="tree", cv=False)
    assert c["rmse_comparison"].count() > 0 and c["roc_comparison"].count() > 0


def test_cross_validation_uses_the_tuned_parameters(spark):
    from loanlens.operators import models as M
    from loanlens.operators.assess import assess
    prep, frames = jobs.task_frames(risk_frame(spark, SF001), S, SMALL, (M.CLASSIFIER,))
    data = frames[M.CLASSIFIER]
    train = data.where("split = 'train'")

    def cv(**params):
        model = M.fit(train, prep.feature_cols, "target_flag", "tree", M.CLASSIFIER, SMALL, **params)
        rows, _ = assess(model, data, SMALL, cv=True, overrides=params)
        return next(r[5] for r in rows if r[3] == "train_cv")

    assert cv(maxDepth=1) != cv() and cv(maxDepth=SMALL.max_depth) == cv()


def test_split_modes_and_pruned_scans(spark):
    from loanlens.operators import models as M
    df = risk_frame(spark, SF001)
    _, exact = jobs.task_frames(df, S, SMALL.with_(split_mode="exact"))
    for data in exact.values():
        n = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}
        assert n["test"] == -(-sum(n.values()) // 5)
    _, other = jobs.task_frames(df, S, SMALL.with_(split_mode="separate"), (M.REGRESSOR,))
    assert {r["split"] for r in other[M.REGRESSOR].select("split").distinct().collect()} == {"train", "test"}
    plan = exact[M.CLASSIFIER].where("split = 'train'").select("k")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<k:string>" in plan
