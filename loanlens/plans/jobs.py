"""The reference's three entry points as Spark jobs over one loan table.

* ``profile_job`` (entry A): every profiling table from one cached scan.
* ``fit_job`` (entry B): preparation, split, folds, then each model x task:
  fit, metrics on train / test, CV, importances or coefficients, ROC points.
* ``linear_job`` (entry B, linear script): logistic and OLS on all features,
  on tree / forest / boosting selections and on the stepwise selection.
* ``compare_job`` (entry C): classic models plus the network grid on scaled
  features, the ROC comparison with the best network and the RMSE ranking.

Each job returns a dict of DataFrames; ``out`` writes them with SNK1 / SNK2.
The prepared frame of each task is written once to the shared checkpoint
folder and every fit scans it.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RiskSchema, RunConfig
from ..operators import compare as C
from ..operators import evaluate as EV
from ..operators import models as M
from ..operators import neural as N
from ..operators import prepare as PR
from ..operators import profile as P
from ..operators import select as S
from ..operators import split as SP
from ..operators.assess import assess, assess_models, metrics_frame
from ..session import cache, reliable_checkpoint, stored, stored_parts
from ..sources.sinks import settings_name, write_csv, write_run


def profile_job(df: DataFrame, s: RiskSchema, cfg: RunConfig = RunConfig(),
                out: str | None = None) -> dict[str, DataFrame]:
    """Entry A: AGG1-AGG16 over one cached scan, released where the tables are written."""
    base = cache(df)
    num, cats = list(s.numeric), list(s.categorical)
    vc = [P.value_counts(base, c).select(F.lit(c).alias("category"), F.col(c).alias("level"), "count")
          for c in cats]
    tables = {
        "frame_info": P.frame_info(base),
        "first_rows": P.head(base, s.key),
        "describe": P.describe(base, num, method=cfg.quantile_method),
        "value_counts": C.union_all(vc),
        "skew_kurtosis": P.skew_kurtosis(base, num),
        "describe_by_category": C.union_all([
            P.describe(base, num, by=[c], method=cfg.quantile_method)
            .select(F.lit(c).alias("category"), F.col(c).alias("level"), "*").drop(c)
            for c in cats]),
        "describe_by_categories": P.describe(base, num, by=cats, method=cfg.quantile_method),
        "histogram": P.histogram(base, num, 20),
        "target_mean_by_segment": P.target_mean_by_segment(base, s),
        "expected_loss": P.expected_loss(base, s),
        "segment_counts": P.segment_counts(base, s),
        "corr_with_flag": P.corr_with_flag(base, s),
        "corr_with_flag_by_segment": P.corr_with_flag(base, s, by=cats),
    }
    if out:
        write_run(tables, out, "profile", cfg)
        base.unpersist()
    return tables


def split_of(df: DataFrame, s: RiskSchema, cfg: RunConfig, task: str) -> DataFrame:
    """PRE8 in the run's mode; a shared hash split gives both tasks the same test rows."""
    if cfg.split_mode == "exact":
        return SP.split_exact(df, s.key, cfg.seed, cfg.test_fraction)
    if cfg.split_mode == "separate":
        return SP.split_hash(df, s.key, f"{cfg.seed}-{task}", cfg.test_fraction)
    return SP.split_hash(df, s.key, cfg.seed, cfg.test_fraction)


def task_frames(df: DataFrame, s: RiskSchema, cfg: RunConfig, tasks=(M.CLASSIFIER, M.REGRESSOR)):
    """PRE6 + PRE7 + PRE8 + TUN4: prepared classification and regression
    frames with ``split`` and train ``fold``, each written once as parquet
    partitioned by split, so that a fit reads its columns and the train rows only."""
    fit_rows = None
    if cfg.fit_on_train:
        if cfg.split_mode != "hash":
            raise ValueError("fit_on_train needs the shared hash split")
        fit_rows = SP.split_hash(df, s.key, cfg.seed, cfg.test_fraction).where(
            "split = 'train'").drop("split")
    prep = PR.fit_preparation(df, s, cap=cfg.cap, fit_rows=fit_rows,
                              method=cfg.quantile_method)
    # the feature table is written once; both tasks' fold ranking and their
    # own frames then read it instead of replaying joins and the median join
    prepared = stored(prep.transform(df), "prepared")
    frames = {}
    for task in tasks:
        d = prepared if task == M.CLASSIFIER else SP.loss_population(prepared, s.amount)
        d = split_of(d, s, cfg, task)
        strat = s.flag if task == M.CLASSIFIER else None
        train = SP.assign_folds(d.where("split = 'train'"), s.key, cfg.folds, cfg.seed,
                                stratify=strat)
        test = d.where("split = 'test'").withColumn("fold", F.lit(None).cast("int"))
        frames[task] = stored_parts({"train": train.drop("split"), "test": test.drop("split")}, task, "split")
    return prep, frames


def preparation_reports(df: DataFrame, s: RiskSchema, cfg: RunConfig, frames: dict) -> dict[str, DataFrame]:
    """SNK2: null counts, group medians, first rows and loss amounts before and
    after preparation, split counts and target statistics of every split."""
    tables = {f"prepare_{k}": v for k, v in PR.fit_preparation(
        df, s, cap=cfg.cap, reports=True, method=cfg.quantile_method).reports.items()}
    for task, data in frames.items():
        tables[f"split_{task}"] = P.describe(data, [_label(s, task)], by=["split"], method=cfg.quantile_method)
    return tables


def _labelled(roc: DataFrame, rows: list[tuple], name: str) -> DataFrame:
    """ROC points with the legend texts, from the metric rows of the same model."""
    aucs = roc.sparkSession.createDataFrame(
        [(x[3], x[5]) for x in rows if x[4] == "auc" and x[3] != "train_cv"], "split string, auc double")
    return C.label_roc(roc, aucs, name)


def _label(s: RiskSchema, task: str) -> str:
    return s.flag if task == M.CLASSIFIER else s.amount


def fit_job(df: DataFrame, s: RiskSchema, cfg: RunConfig = RunConfig(),
            kinds=("tree", "forest", "boost"), grid: bool = False, cv: bool = True,
            out: str | None = None) -> dict[str, DataFrame]:
    """Entry B (tree script): each model x task fitted, assessed and explained."""
    spark = df.sparkSession
    prep, frames = task_frames(df, s, cfg)
    feats = prep.feature_cols
    rows, rocs, imps, nodes = [], [], [], []
    from ..operators.tune import grid_search
    for kind in kinds:
        for task in (M.CLASSIFIER, M.REGRESSOR):
            data = frames[task]
            train = data.where("split = 'train'")
            params = {}
            if grid:
                params, _ = grid_search(train, feats, _label(s, task), kind, task, cfg)
            model = M.fit(train, feats, _label(s, task), kind, task, cfg, **params)
            r, roc = assess(model, data, cfg, run="grid" if grid else "default", cv=cv, overrides=params)
            rows += r
            if roc is not None:
                rocs.append(_labelled(roc, r, model.name))
            imps.append(M.importances(model, positive_only=True))
            if kind == "tree":
                nodes.append(M.tree_nodes(model).withColumn("model", F.lit(model.name)))
    points = reliable_checkpoint(C.union_all(rocs))
    tables = {"metrics": metrics_frame(spark, rows), "roc_points": points,
              "roc_comparison": points.where("split = 'test'"), "importances": C.union_all(imps),
              **preparation_reports(df, s, cfg, frames)}
    if nodes:
        tables["tree_nodes"] = C.union_all(nodes)
    if out:
        write_run(tables, out, "fit", {**asdict(cfg), "kinds": list(kinds), "tuned": grid, "cv": cv})
    return tables


def linear_job(df: DataFrame, s: RiskSchema, cfg: RunConfig = RunConfig(),
               out: str | None = None) -> dict[str, DataFrame]:
    """Entry B (linear script): logistic / OLS on all features, on the
    importance selections of tree, forest and boosting, and on the stepwise
    selection; coefficients and stepwise traces included."""
    spark = df.sparkSession
    prep, frames = task_frames(df, s, cfg)
    feats = prep.feature_cols
    rows, coefs, traces, chosen_rows, rocs = [], [], [], [], []
    for task, kind in ((M.CLASSIFIER, "logistic"), (M.REGRESSOR, "linear")):
        data = frames[task]
        train = data.where("split = 'train'")
        label = _label(s, task)
        sets = {"All": feats}
        for sel in ("tree", "forest", "boost"):
            sets[sel], _ = S.importance_features(train, feats, label, sel, task, cfg,
                                                 cfg.feature_thresh)
        if task == M.CLASSIFIER:
            sets["stepwise"], trace = S.stepwise_logistic(train, feats, label, folds=cfg.folds,
                                                          max_features=cfg.max_stepwise)
        else:
            sets["stepwise"], trace = S.stepwise_ols(train, feats, label, folds=cfg.folds,
                                                     max_features=cfg.max_stepwise)
        traces.append(S.trace_frame(spark, trace).withColumn("task", F.lit(task)))
        for name, cols in sets.items():
            if not cols:
                continue
            model = M.fit(train, cols, label, kind, task, cfg)
            r, roc = assess(model, data, cfg, run=name, cv=True)
            rows += r
            if roc is not None:
                rocs.append(_labelled(roc, r, f"{model.name} {name}"))
            coefs.append(M.coefficients(model).withColumn("selection", F.lit(name)))
            chosen_rows += [(task, name, i, c) for i, c in enumerate(cols)]
    tables = {"metrics": metrics_frame(spark, rows), "coefficients": C.union_all(coefs),
              "stepwise_trace": C.union_all(traces),
              "roc_comparison": C.union_all(rocs).where("split = 'test'"),
              **preparation_reports(df, s, cfg, frames),
              "selections": spark.createDataFrame(
                  chosen_rows, "task string, selection string, position int, feature string")}
    if out:
        write_run(tables, out, "linear", cfg)
    return tables


def compare_job(df: DataFrame, s: RiskSchema, cfg: RunConfig = RunConfig(),
                var_model: str | None = None, out: str | None = None,
                net_mode: str = "average", cv: bool = True) -> dict[str, DataFrame]:
    """Entry C: LR / DT / RF / GB and the network grid for one variable set
    (all features, or those a tree / forest / boosting model finds above the
    deep-learning threshold), compared by test ROC and test RMSE."""
    spark = df.sparkSession
    prep, frames = task_frames(df, s, cfg)
    feats = prep.feature_cols
    cls, reg = frames[M.CLASSIFIER], frames[M.REGRESSOR]
    scaler = PR.fit_minmax(cls.where("split = 'train'"), feats)
    use = {M.CLASSIFIER: feats, M.REGRESSOR: feats}
    if var_model:
        for task in use:
            use[task], _ = S.importance_features(frames[task].where("split = 'train'"), feats,
                                                 _label(s, task), var_model, task, cfg,
                                                 cfg.feature_thresh_dl)
    rows, rocs = [], []
    for kind_c, kind_r in (("logistic", "linear"), ("tree", "tree"), ("forest", "forest"),
                           ("boost", "boost")):
        for task, kind in ((M.CLASSIFIER, kind_c), (M.REGRESSOR, kind_r)):
            data = frames[task]
            model = M.fit(data.where("split = 'train'"), use[task], _label(s, task), kind, task, cfg)
            short = M.SHORT[kind]
            r, roc = assess(model, data, cfg, run="classic", label_name=short, cv=cv)
            rows += r
            if roc is not None:
                rocs.append(_labelled(roc, r, short))
    net_rows, net_test = [], None
    for task, data, epochs in ((M.CLASSIFIER, cls, cfg.epochs_classifier), (M.REGRESSOR, reg, cfg.epochs_regressor)):
        scaled, label = scaler.transform(data), _label(s, task)
        specs = N.grid_specs(len(use[task]), task, cfg)
        if not specs:
            continue
        # all networks of a task train together and are scored in one pass
        train = scaled.where("split = 'train'")
        nets = (N.train_many(train, use[task], label, specs, epochs, seed=cfg.seed, key=s.key, scale_target=cfg.scale_target)
                if net_mode == "average" else
                [N.train(train, use[task], label, spec, epochs, seed=cfg.seed, mode=net_mode, key=s.key,
                         scale_target=cfg.scale_target) for spec in specs])
        scored = N.score_many(nets, [n.spec.name(epochs) for n in nets], scaled, ["split", label])
        net_rows += [r for r in assess_models(scored, task, label, "net") if r[4] != "target_mean"]
        if task == M.CLASSIFIER:
            by = ["model", "split"]
            scan = EV.score_scan(EV.score_counts(scored.where("split = 'test'"), label, "score", by), "score", by)
            net_test = reliable_checkpoint(C.label_models(
                EV.roc_curve(None, label, "score", by=by, drop_intermediate=cfg.drop_intermediate, scan=scan),
                EV.auc(None, label, "score", by=by, scan=scan)))
    metrics = metrics_frame(spark, rows + net_rows)
    test_rocs = C.union_all(rocs).where("split = 'test'")
    best_net = C.keep_max(net_test, "auc") if net_test is not None else None
    roc_comparison = C.union_missing([test_rocs] + ([best_net] if best_net is not None else []))
    rmse = (metrics.where("metric = 'rmse' AND split = 'test'")
            .select("model", "split", F.col("value").alias("rmse")))
    tables = {"metrics": metrics, "roc_comparison": roc_comparison,
              "rmse_comparison": C.rank_rmse(rmse), **preparation_reports(df, s, cfg, frames)}
    if net_test is not None:
        tables["network_roc_comparison"] = net_test
    if out:
        write_run(tables, out, "compare", {**asdict(cfg), "var_model": var_model, "net_mode": net_mode, "cv": cv})
        write_csv(tables["rmse_comparison"], out, settings_name(
            "RMSE-Comparison", epochs=cfg.epochs_regressor, var=var_model or "All",
            seed=cfg.seed, max_depth=cfg.max_depth, thresh=cfg.feature_thresh_dl))
    return tables
