"""Model invariants on the risk frame (sf0.01): AUC level, AUC by three
routes, importances, OLS residual orthogonality, stepwise = direct CV."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from loanlens.config import RunConfig
from loanlens.operators import evaluate as EV
from loanlens.operators import models as M
from loanlens.operators import select as S
from loanlens.operators.tune import cross_validate
from loanlens.plans.jobs import task_frames
from loanlens.sources.frames import risk_frame
from loanlens.config import RiskSchema

CFG = RunConfig()


@pytest.fixture(scope="module")
def frames(spark):
    prep, fr = task_frames(risk_frame(spark, SF01), RiskSchema.risk_frame(), CFG)
    return prep.feature_cols, fr


def test_tree_auc_level_and_three_routes(spark, frames):
    feats, fr = frames
    data = fr[M.CLASSIFIER]
    model = M.fit(data.where("split = 'train'"), feats, "target_flag", "tree", M.CLASSIFIER, CFG)
    sc = M.score(model, data).where("split = 'test'")
    ours = EV.auc(sc, "target_flag", "score").first()["auc"]
    assert ours > 0.8
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="target_flag", numBins=0)
    assert ours == pytest.approx(ev.evaluate(sc), abs=1e-12)
    pdf = sc.select("target_flag", "score").toPandas()
    ranks = pdf["score"].rank()
    pos = pdf["target_flag"] == 1
    n1, n0 = pos.sum(), (~pos).sum()
    mw = (ranks[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert ours == pytest.approx(mw, abs=1e-12)
    imp = model.estimator.featureImportances.toArray()
    assert imp.sum() == pytest.approx(1.0)


def test_ols_residuals_orthogonal(spark, frames):
    feats, fr = frames
    train = fr[M.REGRESSOR].where("split = 'train'")
    model = M.fit(train, feats, "target_amt", "linear", M.REGRESSOR, CFG)
    sc = M.score(model, train).withColumn("res", F.col("target_amt") - F.col("score"))
    dots = sc.agg(*[F.sum(F.col("res") * F.col(c)).alias(c) for c in feats],
                  F.sum("res").alias("_1")).first()
    scale = sc.agg(F.sum(F.abs("target_amt"))).first()[0]
    assert all(abs(v) / scale < 1e-4 * max(1.0, 1.0) for v in dots)


def test_stepwise_ols_equals_direct_cv(spark, frames):
    feats, fr = frames
    train = fr[M.REGRESSOR].where("split = 'train'")
    chosen, trace = S.stepwise_ols(train, feats, "target_amt", max_features=3)
    step3 = trace[2]
    direct = cross_validate(train, step3[1], "target_amt", "linear", M.REGRESSOR, CFG, "rmse")
    assert -step3[3] == pytest.approx(direct, rel=1e-6)
    assert [t[0] for t in trace] == [1, 2, 3]


def test_selected_features_in_input_order(spark, frames):
    feats, fr = frames
    train = fr[M.CLASSIFIER].where("split = 'train'")
    chosen, model = S.importance_features(train, feats, "target_flag", "tree", M.CLASSIFIER,
                                          CFG, 0.05)
    assert chosen == [f for f in feats if f in chosen]
    imp = dict(zip(feats, model.estimator.featureImportances.toArray()))
    assert all(imp[f] > 0.05 for f in chosen)


def test_stepwise_logistic_first_steps(spark, frames):
    feats, fr = frames
    train = fr[M.CLASSIFIER].where("split = 'train'")
    chosen, trace = S.stepwise_logistic(train, feats, "target_flag", max_features=2)
    assert len(trace) == 2 and trace[1][3] >= trace[0][3]
    # the step score is a CV AUC of logistic regression on the chosen pair
    direct = cross_validate(train, trace[1][1], "target_flag", "logistic", M.CLASSIFIER, CFG, "auc")
    assert trace[1][3] == pytest.approx(direct, abs=2e-3)


def test_auc_bounds_hold_and_do_not_change_the_choice(spark, frames):
    """One bin bounds nothing, so every candidate is compared exactly: the same trace."""
    feats, fr = frames
    train = fr[M.CLASSIFIER].where("split = 'train'").select(*feats[:7], "target_flag", "fold").persist()
    fast = S.stepwise_logistic(train, feats[:7], "target_flag", max_features=3)
    full = S.stepwise_logistic(train, feats[:7], "target_flag", max_features=3, bins=1)
    assert fast == full
    mean, scale = S.moments(train, feats[:7])
    cands = list(range(7))
    w = S._newton(train, feats[:7], "target_flag", "fold", mean, scale, [], cands, np.zeros((7, 5, 2)), 5, 1.0, 25, 1e-6, "")
    args = (train, feats[:7], "target_flag", "fold", mean, scale, [], cands, w, 5)
    exact = {(r["cand"], r["fold"]): r["auc"] for r in
             EV.auc(S._heldout_scores(*args), "y", "score", by=["cand", "fold"]).collect()}
    for bins in (3, 64, 4096):
        bounds = S.auc_bounds(S._score_bins(*args, bins)).collect()
        assert len(bounds) == len(exact) == 35
        for r in bounds:
            assert r["lower"] - 1e-12 <= exact[r["cand"], r["fold"]] <= r["upper"] + 1e-12
            assert bins < 4096 or r["upper"] - r["lower"] < 0.02
    assert len(S.contenders(*args)) < 7 and len(S.contenders(*args, bins=1)) == 7


def test_one_class_in_a_fold_is_refused(spark):
    rows = spark.createDataFrame([(float(i % 7), i % 2 if i % 5 else 0, i % 5) for i in range(100)], "x double, y int, fold int")
    with pytest.raises(ValueError, match="one class only"):
        S.stepwise_logistic(rows, ["x"], "y", max_features=1)


def test_grid_search_refit(spark, frames):
    from loanlens.operators.tune import grid_search
    feats, fr = frames
    train = fr[M.CLASSIFIER].where("split = 'train'")
    best, table = grid_search(train, feats, "target_flag", "tree", M.CLASSIFIER, CFG)
    assert len(table) == 4 and set(best) == {"maxDepth", "minInstancesPerNode"}
    model = M.fit(train, feats, "target_flag", "tree", M.CLASSIFIER, CFG, **best)
    assert model.estimator.getMaxDepth() == best["maxDepth"]
    assert model.estimator.getMinInstancesPerNode() == best["minInstancesPerNode"]


def test_registered_searches_run_every_kind(spark):
    """grid_search and the two CV queries in full, on the tables of the smallest scale."""
    from loanlens.plans import q_models as Q
    rows = Q.q_grid_search(spark, SF001).collect()
    kinds = {f"{k}_{t}" for k in ("tree", "forest", "boost") for t in (M.CLASSIFIER, M.REGRESSOR)}
    points = {k: [r for r in rows if r.model == k and "[" in r.metric] for k in kinds}
    assert {k: len(v) for k, v in points.items()} == {k: 4 if k.startswith("tree") else 8 for k in kinds}
    for k in kinds:
        mine = {(r.split, r.metric): r.value for r in rows if r.model == k}
        own = "auc" if k.endswith(M.CLASSIFIER) else "rmse"
        assert {(s, own) for s in ("train", "test", "train_cv")} <= set(mine)
        assert mine["train", "auc"] > 0.8 if own == "auc" else mine["train", "rmse"] < 12_000
    auc = {r.model: r.value for r in Q.q_cv_auc(spark, SF001).collect()}
    assert set(auc) == {f"{k}_classifier" for k in ("tree", "forest", "boost", "logistic")} and all(0.75 < v < 0.95 for v in auc.values())
    out = Q.q_cv_rmse_ols(spark, SF001).collect()
    assert {r.model for r in out} == {f"{k}_regressor" for k in ("linear", "tree", "forest", "boost")}
    assert all(0.2 < r.error_ratio < 0.6 for r in out)


def test_mlp_sigmoid_runs_every_depth(monkeypatch):
    from types import SimpleNamespace

    from loanlens.plans import q_neural as Q
    layers, names = [], []
    monkeypatch.setattr(Q, "scaled_frames", lambda *a: (["x", "y"], SimpleNamespace(where=lambda c: None), None))
    monkeypatch.setattr(Q.M, "fit", lambda *a, **b: layers.append(b["layers"]) or SimpleNamespace(name="mlp_classifier"))
    monkeypatch.setattr(Q, "assess", lambda *a, **b: (names.append(b["label_name"]) or [], None))
    monkeypatch.setattr(Q, "metrics_frame", lambda spark, rows: rows)
    Q.q_mlp_sigmoid(None, "")
    assert layers == [[2, 4, 2], [2, 4, 4, 2]] and names == ["mlp_classifier_1", "mlp_classifier_2"]


def test_trees_keep_no_node_ids():
    """Kept node ids are rows x trees of storage, written again at every level."""
    for kind, task in (("tree", M.CLASSIFIER), ("forest", M.CLASSIFIER), ("forest", M.REGRESSOR), ("boost", M.CLASSIFIER), ("boost", M.REGRESSOR)):
        assert not M.make_estimator(kind, task, "y", CFG).getCacheNodeIds()


def test_exact_auc_inside_score_ranges(spark):
    """Whatever the ranges, plain or packed rows: the AUC of the global order, ties half."""
    rows = [(float(i % 5), float(i * 37 % 101) / 7, int(i * 7919 % 13 < 5), i * 31 % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, y int, fold int").repartition(4)
    mean, scale = S.moments(df, ["a", "b"])
    w = np.array([[[0.1, 0.5, -0.2]] * 3, [[0.1, 0.5, 0.0]] * 3])       # the second has five scores
    args = (["a", "b"], "y", "fold", mean, scale, [0], [1, 1], w, 3)
    want = {(r["cand"], r["fold"]): r["auc"] for r in
            EV.auc(S._heldout_scores(df, *args), "y", "score", by=["cand", "fold"]).collect()}
    binned = S._score_bins(df, *args, 8).toPandas()
    for ranges in (S.score_ranges(binned, [0, 1], 3, 8), [[np.zeros(0)] * 3] * 2):
        for data in (df, S._packed(df, ["a", "b"], "y", "fold", mean, scale)):
            got = {(r["cand"], r["fold"]): r["auc"] for r in S.fold_aucs(data, *args, ranges).collect()}
            assert got == pytest.approx(want, abs=1e-12)
    assert "rangepartitioning" not in S.fold_aucs(df, *args, ranges)._jdf.queryExecution().executedPlan().toString()


def test_newton_pass_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y, fold = rng.normal(size=(700, 4)), rng.integers(0, 2, 700), rng.integers(0, 3, 700)
    feats = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, r), int(t), int(f)) for r, t, f in zip(x, y, fold)],
                               "a double, b double, c double, d double, y int, fold int").repartition(3)
    w = rng.normal(size=(2, 3, 4))
    mean, scale = np.zeros(4), np.ones(4)
    for data in (df, S._packed(df, feats, "y", "fold", mean, scale)):
        g, h = S._newton_pass(data, feats, "y", "fold", mean, scale, [2, 0], [1, 3], w, 3)
        for i, c in enumerate((1, 3)):
            for k in range(3):
                z = np.column_stack([np.ones(700), x[:, [2, 0, c]]])[fold != k]
                p = 1 / (1 + np.exp(-z @ w[i, k]))
                assert g[i, k] == pytest.approx(z.T @ (p - y[fold != k]), abs=1e-9)
                assert h[i, k].ravel() == pytest.approx(((z * (p * (1 - p))[:, None]).T @ z).ravel(), abs=1e-9)


def test_select_features_fits_side_by_side(spark, monkeypatch):
    """Boosting of both tasks runs beside the other fits; rows keep their order."""
    from threading import Barrier

    from loanlens.plans import q_select
    meet = Barrier(4, timeout=20)

    def fit(train, feats, label, kind, task, cfg):
        if kind != "forest":
            meet.wait()
        return kind, task

    data = spark.createDataFrame([(1.0, "train")], "x double, split string")
    monkeypatch.setattr(q_select, "model_frames", lambda *_: (["x"], {M.CLASSIFIER: data, M.REGRESSOR: data}))
    monkeypatch.setattr(q_select.M, "fit", fit)
    monkeypatch.setattr(q_select.S, "select_by_importance", lambda model, thresh: ["x"])
    got = [(r["task"], r["selector"]) for r in q_select.q_select_features(spark, "").collect()][::2]
    assert got == [(t, k) for t in (M.CLASSIFIER, M.REGRESSOR) for k in ("tree", "forest", "boost")]
