"""Batched histogram trainer: both ways give one model, splits by brute force, Spark ML's trees and searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.config import RunConfig
from loanlens.operators import models as M
from loanlens.operators import trees as T
from loanlens.operators.tune import cross_validate, fold_rmse, grid_search, tree_search

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    """Few distinct values, so that the trainer's cuts are Spark ML's."""
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), *[
        F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n)).cast("double").alias(c) for i, (c, n) in enumerate(zip(FEATS, (40, 13, 2, 7)))])
    noise = F.pmod(F.xxhash64("k", F.lit(99)), F.lit(1000)) / 1000.0
    df = df.withColumn("amt", 3 * F.col("a") - F.col("b") * F.col("c") + F.when(F.col("d") > 3, 25).otherwise(0) + 8 * noise)
    df = df.withColumn("flag", (F.col("amt") + 40 * noise > 85).cast("int"))
    return df.withColumn("fold", F.pmod(F.xxhash64("k", F.lit(5)), F.lit(5)).cast("int")).checkpoint()


def binned(rows, label):
    return T.bin_rows(rows, FEATS, label)


def chains():
    out = [T.Chain(fold=f, depth=4, least=2) for f in (-1, 0, 3)]
    out += [T.Chain(fold=1, depth=3, bag=b, subset=2) for b in range(4)]
    return out + [T.Chain(fold=f, depth=d, loss=T.LOGISTIC, step=0.3, stages=s) for f, d, s in ((-1, 2, 11), (2, 3, 5))]


def test_two_ways_give_the_same_trees(rows, monkeypatch):
    monkeypatch.setattr(T, "CELLS", 1500)       # several groups of models per level
    monkeypatch.setattr(T, "KEEP", 3)           # sums written several times
    b = binned(rows, "flag")
    one, two = T.grow(b, chains(), "models").trees, T.grow(b, chains(), "rows").trees
    for x, y in zip(one, two):
        assert (x.feature == y.feature).all() and (x.cut == y.cut).all()
        assert np.allclose(x.value, y.value) and np.allclose(x.rows, y.rows) and (x.rows >= 0).all()
    assert any((t.feature[-1] >= 0).any() for t in one)


def test_trees_do_not_depend_on_layout(rows):
    two = T.grow(T.bin_rows(rows.repartition(3, "b"), FEATS, "flag"), chains(), "models").trees
    for x, y in zip(T.grow(binned(rows, "flag"), chains(), "models").trees, two):
        assert (x.feature == y.feature).all() and (x.cut == y.cut).all() and np.allclose(x.value, y.value)


def brute_tree(x, y, depth, least, heap=0, out=None):
    out = {} if out is None else out
    out[heap] = (len(y), y.mean())
    best = None
    for f in range(x.shape[1] if depth else 0):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            n, m = left.sum(), len(y) - left.sum()
            if min(n, m) >= least:
                gain = ((y - y.mean()) ** 2).sum() - ((y[left] - y[left].mean()) ** 2).sum() - ((y[~left] - y[~left].mean()) ** 2).sum()
                if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, v, left)
    if best:
        out[heap] += best[1:3]
        brute_tree(x[best[3]], y[best[3]], depth - 1, least, 2 * heap + 1, out)
        brute_tree(x[~best[3]], y[~best[3]], depth - 1, least, 2 * heap + 2, out)
    return out


@pytest.mark.parametrize("least,fold", [(1, -1), (60, 2)])
def test_tree_equals_brute_force(rows, least, fold):
    b = binned(rows, "amt")
    [t] = T.grow(b, [T.Chain(fold=fold, depth=4, least=least)]).trees
    pdf = rows.where(F.col("fold") != fold).toPandas()
    want = brute_tree(pdf[FEATS].to_numpy(), pdf["amt"].to_numpy(), 4, least)
    for heap in range(31):
        assert (t.rows[0, heap] > 0) == (heap in want)
        if heap in want:
            n, mean, *split = want[heap]
            assert t.rows[0, heap] == n and t.value[0, heap] == pytest.approx(mean)
            assert (t.feature[0, heap] >= 0) == bool(split)
            if split:
                assert t.feature[0, heap] == split[0] and b.cuts[split[0]][t.cut[0, heap]] == split[1]


@pytest.mark.parametrize("kind,task", [("tree", M.CLASSIFIER), ("tree", M.REGRESSOR), ("boost", M.CLASSIFIER), ("boost", M.REGRESSOR)])
def test_models_equal_spark_ml(rows, kind, task):
    """Deterministic models score every row as Spark ML's do."""
    cfg = RunConfig().with_(max_depth=3, boost_iters=8)
    label = "flag" if task == M.CLASSIFIER else "amt"
    theirs = M.score(M.fit(rows, FEATS, label, kind, task, cfg), rows)
    point = {"tree": {"maxDepth": 3}, "boost": {"maxDepth": 3, "maxIter": 8, "stepSize": cfg.step_size}}[kind]
    mine = T.search(binned(rows, label), kind, task, [point]).model.score(rows)
    both = mine.select("k", F.col("score").alias("s")).join(theirs.select("k", "score"), "k")
    assert both.agg(F.max(F.abs(F.col("s") - F.col("score")))).first()[0] < 1e-9
    assert mine.columns == theirs.columns and mine.count() == rows.count()


def test_forest_level(rows):
    cfg = RunConfig().with_(num_trees=30)
    for task, label in ((M.CLASSIFIER, "flag"), (M.REGRESSOR, "amt")):
        theirs = M.score(M.fit(rows, FEATS, label, "forest", task, cfg), rows)
        found = T.search(binned(rows, label), "forest", task, [{"maxDepth": 5, "numTrees": 30, "bootstrap": True}])
        err = [d.agg(F.avg((F.col(label) - F.col("score")) ** 2)).first()[0] for d in (theirs, found.model.score(rows))]
        assert 0.8 < err[1] / err[0] < 1.25
        assert found.model.importances().sum() == pytest.approx(1.0) and found.model.importances()[0] == max(found.model.importances())
    one = T.plan([{"maxDepth": 5, "numTrees": 200, "bootstrap": False}], "forest", M.REGRESSOR, [0], 4, 1)[0]
    assert len(one) == 1            # equal trees are grown once


def test_best_parameters_equal_spark_ml(rows):
    """Scores of the tree grid are Spark ML's, point by point."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import DecisionTreeRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from loanlens.operators.tune import evaluator
    cfg = RunConfig().with_(grid={"tree": {"maxDepth": [2, 4], "minInstancesPerNode": [1, 40]}})
    est = DecisionTreeRegressor(labelCol="amt", featuresCol="features", maxBins=256, seed=1)
    grid = ParamGridBuilder().addGrid(est.maxDepth, [2, 4]).addGrid(est.minInstancesPerNode, [1, 40]).build()
    cv = CrossValidator(estimator=Pipeline(stages=[M.assembler(FEATS), est]), estimatorParamMaps=grid,
                        evaluator=evaluator("tree", M.REGRESSOR, "amt", "r2"), numFolds=5, foldCol="fold").fit(rows)
    best, table = grid_search(rows, FEATS, "amt", "tree", M.REGRESSOR, cfg)
    assert [r["score"] for r in table] == pytest.approx(cv.avgMetrics, abs=1e-9)
    assert best == {k: v for k, v in table[int(np.argmax(cv.avgMetrics))].items() if k != "score"}


def test_search_grows_shared_chains_once_and_refits():
    points = T.grid_points({"maxDepth": [3, 5], "maxIter": [100, 200], "stepSize": [0.01, 0.1]})
    all_chains, used = T.plan(points, "boost", M.CLASSIFIER, [0, 1, -1], 4, 1)
    assert len(all_chains) == 4 * 3 and all(c.stages == 200 for c in all_chains) and len(used) == 8 * 3
    points = T.grid_points({"bootstrap": [True, False], "maxDepth": [3, 5], "numTrees": [100, 200]})
    assert len(T.plan(points, "forest", M.CLASSIFIER, [0], 4, 1)[0]) == 400


def test_tree_search_over_boosting(rows):
    cfg = RunConfig().with_(grid={"boost": {"maxDepth": [1, 2], "maxIter": [3, 6], "stepSize": [0.1, 0.5]}})
    found = tree_search(rows, FEATS, "flag", "boost", M.CLASSIFIER, cfg)
    assert len(found.table) == 8
    assert {k: v for k, v in max(found.table, key=lambda r: r["score"]).items() if k != "score"} == found.best
    assert 0.8 < found.cv("auc") < 1
    # the same point alone, by cross-validation
    b = found.best
    again = cross_validate(rows, FEATS, "flag", "boost", M.CLASSIFIER, cfg, "auc", maxDepth=b["maxDepth"], maxIter=b["maxIter"], stepSize=b["stepSize"])
    assert again == pytest.approx(found.cv("auc"), abs=1e-12)


def test_linear_and_logistic_cv_equal_spark_ml(rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
    cfg, rm, au = RunConfig(), [], []
    for f in range(5):
        rest, held = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        for kind, task, label, out in (("linear", M.REGRESSOR, "amt", rm), ("logistic", M.CLASSIFIER, "flag", au)):
            est = M.make_estimator(kind, task, label, cfg, n_train=rest.count())
            p = Pipeline(stages=[M.assembler(FEATS), est]).fit(rest).transform(held)
            ev = (RegressionEvaluator(labelCol=label) if kind == "linear" else
                  BinaryClassificationEvaluator(labelCol=label, numBins=0))
            out.append(ev.evaluate(p))
    assert fold_rmse(rows, FEATS, "amt", "fold", 5) == pytest.approx(rm, rel=1e-9)
    assert cross_validate(rows, FEATS, "flag", "logistic", M.CLASSIFIER, cfg, "auc") == pytest.approx(np.mean(au), abs=1e-6)


def test_rows_descend_and_add_up_without_a_look_up_per_row(monkeypatch):
    """Leaves by comparing a level's nodes with all rows equal those found row by row, with nodes that stop early; a pass
    spreads the groups' sums to features once, and folds draw a bootstrap once."""
    rng = np.random.default_rng(2)
    x = np.asfortranarray(rng.integers(0, 256, size=(500, 6)).astype(np.uint8))
    t = T.Trees(1, 5)
    t.feature[0, :31] = np.where(rng.random(31) < 0.8, rng.integers(0, 6, 31), -1)
    t.cut[0, :31], t.value[0] = rng.integers(0, 255, 31), rng.normal(size=63)
    for levels in range(6):
        want = t.leaf(x, 0, levels, np.zeros(500, np.int64))
        path, ends = t.descend(x, 0, levels)
        assert (ends[path] == want).all() and (t.leaf(x, 0, levels) == want).all()
        assert (t.values(x, 0, levels) == t.value[0][want]).all()
    hashes = rng.integers(-2 ** 62, 2 ** 62, size=500)
    u = (T._mix(hashes.view(np.uint64) ^ T._mix(np.array([1_000_003 + 4], np.uint64))) >> np.uint64(11)).astype(float) / 2 ** 53
    assert (T.bag_weights(hashes, 3, 1) == np.searchsorted(T._POISSON, u, side="right")).all()
    drawn, plain = [], T.bag_weights
    monkeypatch.setattr(T, "bag_weights", lambda *a: drawn.append(a[1]) or plain(*a))
    bags, fold = {}, rng.integers(0, 5, 500)
    ws = [T._weights(T.Chain(fold=f, bag=3), fold, hashes, bags) for f in range(5)]
    assert drawn == [3] and all(((w == 0) | (fold != f)).all() for f, w in enumerate(ws))
    lay = T._Layout([256, 3, 2, 2, 2, 256])
    y, node, codes = rng.normal(size=500), rng.integers(0, 4, 500), lay.codes((x % np.array([256, 3, 2, 2, 2, 256])).astype(np.uint8))
    both = lay.joint(codes[:, :200], node[:200], 4, None, y[:200]) + lay.joint(codes[:, 200:], node[200:], 4, None, y[200:])
    h = lay.spread(both, 4)
    for f in range(6):
        for v in range(lay.widths[f]):
            for n in range(4):
                some = (node == n) & (x[:, f] % lay.widths[f] == v)
                assert h[0, n, lay.first[f] + v] == some.sum() and abs(h[1, n, lay.first[f] + v] - y[some].sum()) < 1e-9


def test_only_the_smaller_child_of_a_node_is_counted(rows, monkeypatch):
    """A level's histograms come from its smaller children and the level above; a level costs one job, and the rows' sums
    are renewed without being written."""
    rng = np.random.default_rng(4)
    lay = T._Layout([9, 4])
    x, y = np.column_stack([rng.integers(0, 9, 400), rng.integers(0, 4, 400)]).astype(np.uint8), rng.normal(size=400)
    t, codes, above = T.Trees(1, 3), lay.codes(x), None
    for level in range(3):
        low, node = (1 << level) - 1, t.leaf(x, 0, level)
        whole = lay.histogram(codes[:, node >= low], node[node >= low] - low, 1 << level, None, y[node >= low])
        if level:
            small, other, parent = t.smaller(0, level)
            assert (whole[0, small].sum(1) <= whole[0, other].sum(1)).all() and (small // 2 == parent).all()
            place = np.full(len(t.feature[0]), -1)
            place[low + small] = np.arange(len(small))
            some = place[node] >= 0
            got = lay.siblings(lay.histogram(codes[:, some], place[node][some], len(small), None, y[some]), above, (small, other, parent), 1 << level)
            assert (got[0] == whole[0]).all() and np.allclose(got[1], whole[1])
        lay.apply(t, 0, level, lay.best(whole, T.Chain(depth=3), 0, np.arange(low, 2 * low + 1)))
        above = whole
    counted = []
    plain = T._Layout.joint
    monkeypatch.setattr(T._Layout, "joint", lambda self, codes, node, *a: counted.append(len(node)) or plain(self, codes, node, *a))
    T._grow_alone(x, y, None, None, T.Chain(depth=3), lay)
    assert counted[0] == 400 and all(n <= 200 for n in counted[1:])
    b = binned(rows, "flag")
    monkeypatch.setattr(T, "stored", None)      # training by rows writes nothing
    [t] = T.grow(b, [T.Chain(depth=2, loss=T.LOGISTIC, step=0.3, stages=T.KEEP + 2)], "rows").trees
    assert (t.feature[:, 0] >= 0).all()
