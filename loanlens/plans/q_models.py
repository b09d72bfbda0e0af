"""Model queries (MOD1-MOD8, MOD12, TUN1-TUN3, EVA6-EVA8): each fits on the
prepared frame of the given tables and returns a small result table. Fitted
models are not SQL-expressible, so these carry rows-only checks; the
invariants are asserted in ``tests/``. One-feature OLS has an exact oracle.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import models as M
from ..operators import split as SP
from ..operators import trees as T
from ..operators.assess import assess, assess_models, metrics_frame
from ..operators.compare import union_all
from ..operators.tune import cross_validate, tree_point, tree_search
from .jobs import task_frames
from .oracle import r4, with_rf
from .q_prepare import FEATURES, _prep_ctes
from .registry import RS, register, rf, rf_table, rounded
from .tree_sql import bin_ctes, tree_ctes

CFG = RunConfig()



def model_frames(spark, sf_dir, tasks=(M.CLASSIFIER, M.REGRESSOR)):
    """Features and the prepared rows of each task with ``split`` and, on train
    rows, ``fold``, from the given tables. Every query builds and writes its own
    (``jobs.task_frames``); its fits, CV folds and metrics then scan that table
    instead of replaying the joins, the median aggregate and the fold ranking."""
    prep, frames = task_frames(rf_table(spark, sf_dir), RS, CFG, tasks)
    return prep.feature_cols, frames


def model_frame(spark, sf_dir, task: str):
    feats, frames = model_frames(spark, sf_dir, (task,))
    return feats, frames[task]


@register("model_frames", with_rf(
    "SELECT task, split, count(*) AS rows FROM (SELECT 'classifier' AS task, split FROM s UNION ALL "
    "SELECT 'regressor' AS task, split FROM s WHERE target_amt IS NOT NULL) GROUP BY task, split",
    f"s AS (SELECT *, CASE WHEN substr(md5('{CFG.seed}' || k), 1, 4) < '{SP.hash_threshold(CFG.test_fraction)}' "
    "THEN 'test' ELSE 'train' END AS split FROM rf)"))
def q_model_frames(spark, sf_dir):
    """PRE6-PRE8 + TUN4 end to end: both tasks' prepared frames built and
    written; rows per task and split."""
    _, frames = model_frames(spark, sf_dir)
    cls, reg = frames[M.CLASSIFIER], frames[M.REGRESSOR]
    return (cls.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).withColumn("task", F.lit(M.CLASSIFIER))
            .unionByName(reg.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
                         .withColumn("task", F.lit(M.REGRESSOR))))


def label_of(task):
    return "target_flag" if task == M.CLASSIFIER else "target_amt"


def run_model(spark, sf_dir, kind, task, cfg=CFG, cv=False):
    feats, data = model_frame(spark, sf_dir, task)
    train = data.where("split = 'train'")
    model = M.fit(train, feats, label_of(task), kind, task, cfg)
    rows, _ = assess(model, data, cfg, cv=cv)
    return metrics_frame(spark, rows)


def _model_query(kind, task):
    def q(spark, sf_dir):
        return run_model(spark, sf_dir, kind, task)
    q.__name__ = f"q_{kind}_{task}"
    q.__doc__ = f"{kind} {task}: metrics on train and test."
    return q


for _name, _kind, _task in [
        ("forest_classifier", "forest", M.CLASSIFIER), ("forest_regressor", "forest", M.REGRESSOR),
        ("boost_classifier", "boost", M.CLASSIFIER), ("boost_regressor", "boost", M.REGRESSOR),
        ("logistic", "logistic", M.CLASSIFIER), ("linear_regression", "linear", M.REGRESSOR)]:
    register(_name)(_model_query(_kind, _task))


# ---- trees at full depth: the histogram trainer's rule is SQL-expressible

def _tree_sql(body: str, task: str, *more: str, depth: int = CFG.max_depth) -> str:
    """``body`` over the tree ``t`` grown on the prepared training rows of a task."""
    where = "TRUE" if task == M.CLASSIFIER else "target_amt IS NOT NULL"
    split = f"CASE WHEN substr(md5('{CFG.seed}' || k), 1, 4) < '{SP.hash_threshold(CFG.test_fraction)}' THEN 'test' ELSE 'train' END"
    return with_rf(body, *_prep_ctes(),
                   f"d AS MATERIALIZED (SELECT k, {split} AS split, CAST({label_of(task)} AS DOUBLE) AS y, {', '.join(FEATURES)} FROM prep WHERE {where})",
                   "y0 AS (SELECT k, y FROM d WHERE split = 'train')", *bin_ctes(FEATURES), *tree_ctes("t", "y0", depth), *more)


def _names() -> str:
    return "['" + "', '".join(FEATURES) + "'][f + 1]"


def _fit_tree(spark, sf_dir, task, kind="tree", **point):
    """Prepared rows of the task and a tree model grown by the histogram trainer on the training rows."""
    feats, data = model_frame(spark, sf_dir, task)
    if sorted(feats) != sorted(FEATURES):
        raise ValueError(f"features {feats} are not those of the oracle")
    binned = _binned(data.where("split = 'train'"), FEATURES, task)
    return data, T.search(binned, kind, task, [tree_point(kind, CFG, **point)], folds=0, seed=CFG.seed).model


def _metrics_query(task):
    def q(spark, sf_dir):
        data, model = _fit_tree(spark, sf_dir, task)
        scored = model.score(data).withColumn("model", F.lit(model.name))
        return rounded(metrics_frame(spark, assess_models(scored, task, label_of(task))))
    q.__name__, q.__doc__ = f"q_tree_{task}", f"Depth-5 tree {task}: metrics on train and test."
    return q


_ROW = "SELECT 'default' AS run, 'tree_{0}' AS model, '{0}' AS task, split, '{1}' AS metric, {2} AS value FROM {3} GROUP BY split"
_AUC = ("g AS (SELECT split, value AS score, sum(y) AS p, sum(1 - y) AS n FROM t_leaf JOIN d USING (k, split) GROUP BY split, value)",
        "a AS (SELECT split, p, n, sum(p) OVER (PARTITION BY split ORDER BY score DESC) AS pc, sum(p) OVER (PARTITION BY split) AS pt, "
        "sum(n) OVER (PARTITION BY split) AS nt FROM g)")
register("tree_classifier", _tree_sql(" UNION ALL ".join([
    _ROW.format(M.CLASSIFIER, "accuracy", r4("avg(CASE WHEN (value > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)"), "t_leaf JOIN d USING (k, split)"),
    _ROW.format(M.CLASSIFIER, "auc", r4("sum(n * (pc - p / 2)) / (max(pt) * max(nt))"), "a")]), M.CLASSIFIER, *_AUC))(_metrics_query(M.CLASSIFIER))
register("tree_regressor", _tree_sql(" UNION ALL ".join(
    _ROW.format(M.REGRESSOR, m, r4(e), "t_leaf JOIN d USING (k, split)") for m, e in (
        ("rmse", "sqrt(avg(power(y - value, 2)))"), ("target_mean", "avg(y)"),
        ("error_ratio", "sqrt(avg(power(y - value, 2))) / avg(y)"))), M.REGRESSOR))(_metrics_query(M.REGRESSOR))


@register("ols", with_rf(
    f"SELECT {r4('regr_slope(target_amt, loan)', 6)} AS slope, "
    f"{r4('regr_intercept(target_amt, loan)', 4)} AS intercept, count(*) AS n "
    "FROM rf WHERE target_amt IS NOT NULL"))
def q_ols(spark, sf_dir):
    """MOD8 with one feature: equals the SQL regression aggregates."""
    df = SP.loss_population(rf_table(spark, sf_dir, "loan", "target_amt"), "target_amt")
    model = M.fit(df, ["loan"], "target_amt", "linear", M.REGRESSOR, CFG)
    est = model.estimator
    out = spark.createDataFrame([(float(est.coefficients[0]), float(est.intercept))],
                                "slope double, intercept double")
    from .registry import round_half_away
    return out.select(round_half_away(F.col("slope"), 6).alias("slope"),
                      round_half_away(F.col("intercept"), 4).alias("intercept"),
                      F.lit(est.summary.numInstances).cast("long").alias("n"))


def _stump_sql(label: str, where: str) -> str:
    """Depth-1 tree on one low-cardinality feature: the split between two
    neighbouring values with the largest variance gain, its nodes and their means."""
    return with_rf(
        f"SELECT 0 AS id, thr AS threshold, nt AS samples, {r4('st / nt')} AS value FROM best UNION ALL "
        f"SELECT 1, NULL, nl, {r4('sl / nl')} FROM best UNION ALL "
        f"SELECT 2, NULL, nt - nl, {r4('(st - sl) / (nt - nl)')} FROM best",
        f"d AS (SELECT discount AS x, count(*) AS n, sum(CAST({label} AS DOUBLE)) AS s FROM rf WHERE {where} GROUP BY discount)",
        "c AS (SELECT x, lead(x) OVER w AS nx, sum(n) OVER w AS nl, sum(s) OVER w AS sl, "
        "sum(n) OVER () AS nt, sum(s) OVER () AS st FROM d WINDOW w AS (ORDER BY x))",
        f"best AS (SELECT {r4('(x + nx) / 2')} AS thr, CAST(nl AS BIGINT) AS nl, sl, CAST(nt AS BIGINT) AS nt, st FROM c "
        "WHERE nx IS NOT NULL ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC LIMIT 1)")


def _stump(spark, sf_dir, task):
    df = rf_table(spark, sf_dir, "discount", *RS.targets)
    df = df if task == M.CLASSIFIER else SP.loss_population(df, "target_amt")
    model = M.fit(df.select("discount", label_of(task)), ["discount"], label_of(task), "tree", task,
                  CFG.with_(max_depth=1))
    return rounded(M.tree_nodes(model).select(
        "id", "threshold", F.col("samples").cast("long").alias("samples"), "value"))


@register("tree_stump_classifier", _stump_sql("target_flag", "TRUE"))
def q_tree_stump_classifier(spark, sf_dir):
    """MOD1 + EVA8 at depth 1 on one feature: the best split is SQL-expressible."""
    return _stump(spark, sf_dir, M.CLASSIFIER)


@register("tree_stump_regressor", _stump_sql("target_amt", "target_amt IS NOT NULL"))
def q_tree_stump_regressor(spark, sf_dir):
    """MOD2 + EVA8 at depth 1 on one feature."""
    return _stump(spark, sf_dir, M.REGRESSOR)


@register("cv_rmse_one_feature", with_rf(
    f"SELECT {r4('avg(r)')} AS cv_rmse FROM (SELECT f.fold, sqrt(avg(power(t.target_amt - (a + b * t.loan), 2))) AS r "
    "FROM f JOIN t ON t.fold = f.fold GROUP BY f.fold)",
    f"t AS (SELECT target_amt, loan, CAST(('0x' || substr(md5('fold{CFG.seed}' || k), 1, 8)) AS BIGINT) % {CFG.folds} AS fold "
    f"FROM rf WHERE target_amt IS NOT NULL AND NOT substr(md5('{CFG.seed}' || k), 1, 4) < '{SP.hash_threshold(CFG.test_fraction)}')",
    f"g AS (SELECT unnest(range({CFG.folds})) AS fold)",
    "f AS (SELECT g.fold, regr_slope(target_amt, loan) AS b, regr_intercept(target_amt, loan) AS a "
    "FROM g JOIN t ON t.fold <> g.fold GROUP BY g.fold)"))
def q_cv_rmse_one_feature(spark, sf_dir):
    """TUN3 with one feature: each fold's line comes from the other folds' regression sums."""
    df = SP.split_hash(SP.loss_population(rf_table(spark, sf_dir, "k", "loan", "target_amt"), "target_amt"),
                       "k", CFG.seed, CFG.test_fraction)
    train = SP.assign_folds(df.where("split = 'train'"), "k", CFG.folds, CFG.seed)
    v = cross_validate(train, ["loan"], "target_amt", "linear", M.REGRESSOR, CFG, "rmse")
    return rounded(spark.createDataFrame([(v,)], "cv_rmse double"))


@register("score_batch", _tree_sql(
    f"SELECT k, split, {r4('value')} AS score, CASE WHEN value > 0.5 THEN 1 ELSE 0 END AS pred FROM t_leaf", M.CLASSIFIER))
def q_score_batch(spark, sf_dir):
    """MOD12: every row scored by a fitted depth-5 tree (key, split, score, class)."""
    data, model = _fit_tree(spark, sf_dir, M.CLASSIFIER)
    return rounded(model.score(data).select("k", "split", "score", "pred"))


@register("importance_table", _tree_sql(
    f"SELECT 'tree_classifier' AS model, CAST(f AS INTEGER) AS position, {_names()} AS feature, "
    f"{r4('sum(gain) / (SELECT sum(gain) FROM t_nodes)')} AS importance FROM t_nodes WHERE f IS NOT NULL GROUP BY f", M.CLASSIFIER))
def q_importance_table(spark, sf_dir):
    """EVA6: positive importances of the depth-5 tree, largest first."""
    _, model = _fit_tree(spark, sf_dir, M.CLASSIFIER)
    rows = [(model.name, i, f, float(v)) for i, (f, v) in enumerate(zip(FEATURES, model.importances())) if v > 0]
    rows.sort(key=lambda r: -r[3])
    return rounded(spark.createDataFrame(rows, "model string, position int, feature string, importance double"))


@register("boost_stages_regressor", _tree_sql(
    f"SELECT k, split, {r4(f't_leaf.value + {CFG.step_size} * u_leaf.value + {CFG.step_size} * w_leaf.value')} AS score "
    "FROM t_leaf JOIN u_leaf USING (k, split) JOIN w_leaf USING (k, split)", M.REGRESSOR,
    "y1 AS (SELECT k, 2 * (y - value) AS y FROM t_leaf JOIN d USING (k, split) WHERE split = 'train')", *tree_ctes("u", "y1", 3),
    f"y2 AS (SELECT k, 2 * (y - (t_leaf.value + {CFG.step_size} * u_leaf.value)) AS y FROM t_leaf JOIN u_leaf USING (k, split) "
    "JOIN d USING (k, split) WHERE split = 'train')", *tree_ctes("w", "y2", 3), depth=3))
def q_boost_stages_regressor(spark, sf_dir):
    """MOD6: every row scored by three boosting stages of depth 3."""
    data, model = _fit_tree(spark, sf_dir, M.REGRESSOR, "boost", maxIter=3, maxDepth=3)
    return rounded(model.score(data).select("k", "split", "score"))


@register("coefficients")
def q_coefficients(spark, sf_dir):
    """EVA7: logistic and linear coefficients with intercept and variable count."""
    out = None
    feats, frames = model_frames(spark, sf_dir)
    for task, kind in ((M.CLASSIFIER, "logistic"), (M.REGRESSOR, "linear")):
        data = frames[task]
        model = M.fit(data.where("split = 'train'"), feats, label_of(task), kind, task, CFG)
        c = M.coefficients(model)
        out = c if out is None else out.unionByName(c)
    return out


@register("tree_nodes", _tree_sql(
    f"SELECT CAST(node AS BIGINT) AS id, {_names()} AS feature, {r4('cut')} AS threshold, CAST(samples AS BIGINT) AS samples, "
    f"{r4('value')} AS value, {r4('gain')} AS gain FROM t_nodes", M.CLASSIFIER))
def q_tree_nodes(spark, sf_dir):
    """EVA8: node table of the depth-5 classification tree, by heap number."""
    _, model = _fit_tree(spark, sf_dir, M.CLASSIFIER)
    return rounded(T.node_table(spark, model))


def _binned(train, feats, task):
    return T.bin_rows(train, feats, label_of(task), "fold", RS.key, CFG.max_bins)


@register("cv_auc")
def q_cv_auc(spark, sf_dir):
    """TUN2: 5-fold CV AUC of every classifier on the training split."""
    feats, data = model_frame(spark, sf_dir, M.CLASSIFIER)
    train = data.where("split = 'train'")
    binned = _binned(train, feats, M.CLASSIFIER)
    rows = [(f"{kind}_classifier", "auc", cross_validate(train, feats, "target_flag", kind, M.CLASSIFIER, CFG, "auc", rows=binned))
            for kind in ("tree", "forest", "boost", "logistic")]
    return spark.createDataFrame(rows, "model string, metric string, value double")


@register("cv_rmse_ols")
def q_cv_rmse_ols(spark, sf_dir):
    """TUN3: 5-fold CV RMSE of every regressor on the training split, with the ratio to the mean."""
    feats, data = model_frame(spark, sf_dir, M.REGRESSOR)
    train = data.where("split = 'train'")
    mean = train.agg(F.avg("target_amt")).first()[0]
    binned, rows = _binned(train, feats, M.REGRESSOR), []
    for kind in ("linear", "tree", "forest", "boost"):
        v = cross_validate(train, feats, "target_amt", kind, M.REGRESSOR, CFG, "rmse", rows=binned)
        rows.append((f"{kind}_regressor", v, v / mean))
    return spark.createDataFrame(rows, "model string, cv_rmse double, error_ratio double")


@register("grid_search")
def q_grid_search(spark, sf_dir):
    """TUN1: the reference's six grids (tree, forest and boosting for both tasks), 5 folds,
    accuracy or R2; the best of each refitted on all training rows and assessed with its CV metric."""
    feats, frames = model_frames(spark, sf_dir)

    def one(task):
        rows, data, label = [], frames[task], label_of(task)
        metric, own = ("accuracy", "auc") if task == M.CLASSIFIER else ("r2", "rmse")
        train = data.where("split = 'train'")
        binned = _binned(train, feats, task)
        found = [tree_search(train, feats, label, kind, task, CFG, rows=binned) for kind in ("tree", "forest", "boost")]
        for f in found:
            rows += [("grid", f.model.name, task, "train_cv",
                      metric + "[" + ",".join(f"{k}={v}" for k, v in sorted(r.items()) if k != "score") + "]",
                      r["score"]) for r in f.table]
        # the refitted models and the held-out scores of the best points, each in one pass
        scored = union_all([f.model.score(data).select(F.lit(f.model.name).alias("model"), "split", label, "score") for f in found])
        rows += assess_models(scored, task, label, "grid")
        held = union_all([T.held_out(f.forest, [f.by_fold]).withColumn("model", F.lit(i)) for i, f in enumerate(found)])
        return rows + [("grid", found[i].model.name, task, "train_cv", own, v) for i, v in T.cv_metric(held, own).items()]

    return metrics_frame(spark, both_tasks(one))


def both_tasks(one) -> list:
    """Rows of the classifiers and the regressors; the two run side by side, as each leaves cores idle between its jobs."""
    with ThreadPoolExecutor(2) as pool:
        parts = list(pool.map(one, (M.CLASSIFIER, M.REGRESSOR)))
    return parts[0] + parts[1]
