"""MOD12: fitted models as column expressions, against ``transform`` and against Arrow batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.config import RunConfig
from loanlens.operators import compiled as X
from loanlens.operators import models as M
from loanlens.operators import trees as T
from loanlens.operators.tune import tree_point

FEATS = ["a", "b c", "d-e"]
CFG = RunConfig(num_trees=12, boost_iters=20)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(5)).cast("int").alias("fold"), *[
        (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n)) / 7 - 2).alias(c) for i, (c, n) in enumerate(zip("xyz", (40, 13, 300)))])
    df = df.withColumn("amt", F.col("x") * F.col("y") + F.sin("z")).withColumn("flag", (F.col("amt") > 0).cast("int"))
    return df.withColumnsRenamed(dict(zip("xyz", FEATS))).persist()


@pytest.mark.parametrize("kind, task", [
    ("tree", M.CLASSIFIER), ("tree", M.REGRESSOR), ("forest", M.CLASSIFIER), ("forest", M.REGRESSOR),
    ("boost", M.CLASSIFIER), ("boost", M.REGRESSOR), ("logistic", M.CLASSIFIER), ("linear", M.REGRESSOR)])
def test_equal_to_transform(spark, rows, kind, task):
    plain = rows.withColumnsRenamed(dict(zip(FEATS, "xyz")))       # Spark ML's own code cannot quote names
    model = M.fit(plain, list("xyz"), "flag" if task == M.CLASSIFIER else "amt", kind, task, CFG)
    ours = M.score(model, plain)
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Python" not in plan and "struct<type" not in plan
    got = ours.select("k", "score").toPandas().set_index("k")["score"]
    want = M.transformed(model, plain).select("k", "score").toPandas().set_index("k")["score"]
    assert np.allclose(got, want.loc[got.index], rtol=1e-12, atol=1e-12) and len(got) == 3000
    assert got.nunique() > 5
    if task == M.CLASSIFIER:
        assert ours.where((F.col("score") > 0.5) != (F.col("pred") == 1)).isEmpty()


@pytest.mark.parametrize("kind, task, more", [
    ("tree", M.CLASSIFIER, {}), ("forest", M.REGRESSOR, {}), ("boost", M.CLASSIFIER, {}), ("boost", M.REGRESSOR, {"maxDepth": 2})])
def test_histogram_models_equal_their_batches(spark, rows, kind, task, more):
    binned = T.bin_rows(rows.withColumnsRenamed(dict(zip(FEATS, "xyz"))), list("xyz"), "flag" if task == M.CLASSIFIER else "amt")
    model = T.search(binned, kind, task, [tree_point(kind, CFG, **more)], folds=0, seed=1).model
    model.features = FEATS
    got = model.score(rows).select("k", "score").toPandas().set_index("k")["score"]
    want = model.score_batches(rows).select("k", "score").toPandas().set_index("k")["score"]
    assert np.allclose(got, want.loc[got.index], rtol=1e-12, atol=1e-12) and got.nunique() > 5
    assert "Python" not in model.score(rows)._jdf.queryExecution().executedPlan().toString()


def test_missing_features_are_refused(spark, rows):
    plain = rows.withColumnsRenamed(dict(zip(FEATS, "xyz")))
    model = M.fit(plain, list("xyz"), "amt", "linear", M.REGRESSOR, CFG)
    for bad in (F.lit(None).cast("double"), F.lit(float("nan"))):
        with pytest.raises(Exception, match="missing"):
            M.score(model, plain.withColumn("y", bad)).collect()
    assert M.score(model, plain.limit(0)).count() == 0


def test_large_ensembles_are_scored_another_way(spark, rows, monkeypatch):
    plain = rows.withColumnsRenamed(dict(zip(FEATS, "xyz")))
    model = M.fit(plain, list("xyz"), "amt", "forest", M.REGRESSOR, CFG)
    want = M.score(model, plain).agg(F.sum("score")).first()[0]
    monkeypatch.setattr(X, "NODES", 10)
    assert M.score_column(model) is None
    assert M.score(model, plain).agg(F.sum("score")).first()[0] == pytest.approx(want, rel=1e-12)


def test_sums_keep_their_terms():
    terms = [f"{i}D" for i in range(100)]
    text = X.sum_text(terms, 3)
    assert eval(text.replace("D", "")) == sum(range(100)) and X.sum_text([]) == "0D"


def test_trees_with_many_nodes_are_compiled(spark, rows):
    """100 trees of depth 5: more than one generated method can hold."""
    plain = rows.withColumnsRenamed(dict(zip(FEATS, "xyz")))
    model = M.fit(plain, list("xyz"), "flag", "forest", M.CLASSIFIER, RunConfig(num_trees=100))
    column = M.score_column(model)
    assert column is not None and X.saved_nodes(spark, model.estimator, list("xyz"), True)
    got = plain.select("k", column.alias("score")).toPandas().set_index("k")["score"]
    want = M.transformed(model, plain).select("k", "score").toPandas().set_index("k")["score"]
    assert np.allclose(got, want.loc[got.index], rtol=1e-12)
