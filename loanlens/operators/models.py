"""Models (MOD1-MOD9, MOD12) on Spark ML, plus their fitted tables
(EVA6 importances, EVA7 coefficients, EVA8 tree nodes).

Every model is a ``Pipeline(VectorAssembler, estimator)`` fitted on the rows
of one split; scoring adds ``score`` (probability of default, or the
predicted amount) and, for classifiers, ``pred`` (the class, 1 when the
probability of 1 is larger, ties to 0 as ``argmax`` does).
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..session import checkpoint_dir
from . import compiled as X

CLASSIFIER, REGRESSOR = "classifier", "regressor"
KINDS = ("logistic", "linear", "tree", "forest", "boost", "mlp")
# short names used in the comparison tables (the reference's labels)
SHORT = {"logistic": "LR", "linear": "LR", "tree": "DT", "forest": "RF", "boost": "GB"}


@dataclass
class FittedModel:
    kind: str
    task: str
    features: list[str]
    label: str
    pipeline: PipelineModel

    @property
    def estimator(self):
        return self.pipeline.stages[-1]

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.task}"


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def make_estimator(kind: str, task: str, label: str, cfg: RunConfig, n_train: int | None = None,
                   n_features: int | None = None, **overrides):
    """The Spark ML estimator matching the reference's model and settings."""
    common = dict(featuresCol="features", labelCol=label)
    # tree learners: a larger node-statistics budget groups more nodes of
    # the forest into each pass over the data; trees are descended again at each
    # level, as node ids kept instead are rows x trees, stored and checkpointed
    trees = dict(maxMemoryInMB=1024, cacheNodeIds=False)
    depth = overrides.pop("maxDepth", cfg.max_depth)
    if kind == "tree":
        # a regression tree on the 0/1 flag keeps leaf probabilities that the
        # classifier prunes away (same splits: Gini is twice the variance)
        est = DecisionTreeRegressor(maxDepth=depth, maxBins=cfg.max_bins, seed=cfg.seed,
                                    **trees, **common)
    elif kind == "forest" and task == CLASSIFIER:
        est = RandomForestClassifier(numTrees=cfg.num_trees, maxDepth=depth, maxBins=cfg.max_bins,
                                     featureSubsetStrategy="sqrt", seed=cfg.seed, **trees,
                                     **common)
    elif kind == "forest":
        est = RandomForestRegressor(numTrees=cfg.num_trees, maxDepth=depth, maxBins=cfg.max_bins,
                                    featureSubsetStrategy="all", seed=cfg.seed, **trees,
                                    **common)
    elif kind == "boost" and task == CLASSIFIER:
        est = GBTClassifier(maxIter=cfg.boost_iters, stepSize=cfg.step_size, maxDepth=depth,
                            maxBins=cfg.max_bins, seed=cfg.seed, **trees, **common)
    elif kind == "boost":
        est = GBTRegressor(maxIter=cfg.boost_iters, stepSize=cfg.step_size, maxDepth=depth,
                           maxBins=cfg.max_bins, seed=cfg.seed, **trees, **common)
    elif kind == "logistic":
        # scikit-learn's C = 1: loss sum + 0.5 |w|^2, i.e. regParam = 1 / n on the mean loss
        reg = 1.0 / n_train if n_train else 0.0
        est = LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False,
                                 maxIter=1000, tol=1e-10, **common)
    elif kind == "linear":
        est = LinearRegression(solver="normal", regParam=0.0, **common)
    elif kind == "mlp":
        p = n_features
        est = MultilayerPerceptronClassifier(layers=[p, 2 * p, 2], maxIter=cfg.epochs_classifier,
                                             seed=cfg.seed, **common)
    else:
        raise ValueError(f"unknown model {kind}/{task}")
    for k, v in overrides.items():
        est.set(est.getParam(k), v)      # Params.set updates in place
    return est


def fit(train: DataFrame, features: list[str], label: str, kind: str, task: str,
        cfg: RunConfig, n_train: int | None = None, **overrides) -> FittedModel:
    if kind == "logistic" and n_train is None:
        n_train = train.count()
    est = make_estimator(kind, task, label, cfg, n_train=n_train, n_features=len(features),
                         **overrides)
    pipe = Pipeline(stages=[assembler(features), est]).fit(train)
    return FittedModel(kind, task, list(features), label, pipe)


def score_column(model: FittedModel):
    """The model's score as a column expression over its features (a missing feature is an
    error, as in ``transform``); None for networks and for ensembles of more than ``compiled.NODES`` nodes."""
    est, kind, cls = model.estimator, model.kind, model.task == CLASSIFIER
    if kind in ("logistic", "linear"):
        text = X.linear_text(model.features, est.coefficients.toArray().tolist(), est.intercept)
        return X.refuse(model.features, X.logistic_text(text) if kind == "logistic" else text)
    if kind not in ("tree", "forest", "boost") or (est.numNodes if kind == "tree" else est.totalNumNodes) > X.NODES:
        return None
    votes = kind == "forest" and cls
    trees = X.saved_nodes(_spark(model), est, model.features, votes)
    text = X.weighted_text(trees, est.treeWeights if kind == "boost" else [1.0] * len(trees))
    if kind == "forest":
        text = f"{text} / {len(trees)}D"
    elif kind == "boost" and cls:
        text = X.logistic_text(text, 2)
    return X.refuse(model.features, text)


def score(model: FittedModel, df: DataFrame) -> DataFrame:
    """MOD12: batch scoring; keeps the input columns, adds ``score`` and ``pred``."""
    column = score_column(model)
    out = df.withColumn("score", column) if column is not None else transformed(model, df)
    if model.task == CLASSIFIER:
        out = out.withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return out.select(*df.columns, "score", *(["pred"] if model.task == CLASSIFIER else []))


def transformed(model: FittedModel, df: DataFrame) -> DataFrame:
    """``df`` with ``score`` by the pipeline's own ``transform``."""
    out = model.pipeline.transform(df)
    est = model.estimator
    if model.task == CLASSIFIER and model.kind != "tree":
        return out.withColumn("score", vector_to_array(F.col(est.getProbabilityCol()))[1])
    return out.withColumn("score", F.col(est.getPredictionCol()))


def importances(model: FittedModel, positive_only: bool = False) -> DataFrame:
    """EVA6: feature importances of a tree model in input order (or the
    positive ones, largest first)."""
    spark = _spark(model)
    imp = model.estimator.featureImportances.toArray().tolist()
    rows = [(model.name, i, f, float(v)) for i, (f, v) in enumerate(zip(model.features, imp))]
    df = spark.createDataFrame(rows, "model string, position int, feature string, importance double")
    if positive_only:
        df = df.where("importance > 0").orderBy(F.desc("importance"), "position")
    return df


def coefficients(model: FittedModel) -> DataFrame:
    """EVA7: intercept and coefficients of a linear model, with the variable count."""
    spark = _spark(model)
    est = model.estimator
    coefs = est.coefficients.toArray().tolist()
    rows = [(model.name, 0, "INTERCEPT", float(est.intercept))]
    rows += [(model.name, i + 1, f, float(v)) for i, (f, v) in enumerate(zip(model.features, coefs))]
    df = spark.createDataFrame(rows, "model string, position int, term string, value double")
    return df.withColumn("n_variables", F.lit(len(model.features)))


def tree_nodes(model: FittedModel) -> DataFrame:
    """EVA8: node table of a fitted decision tree (the data behind the tree
    picture): the saved model's node rows with feature names joined on.

    The model is written under the session's shared checkpoint folder.
    """
    spark = _spark(model)
    path = os.path.join(checkpoint_dir(spark), f"tree-{uuid.uuid4().hex}")
    model.estimator.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data"))
    names = spark.createDataFrame(list(enumerate(model.features)), "featureIndex int, feature string")
    flat = nodes.select("id", "prediction", "impurity", "rawCount", "gain", "leftChild",
                        "rightChild", F.col("split.featureIndex").alias("featureIndex"),
                        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
    return (flat.join(F.broadcast(names), "featureIndex", "left")
            .select("id", "feature", "threshold", "impurity", F.col("rawCount").alias("samples"),
                    F.col("prediction").alias("value"), "gain", "leftChild", "rightChild")
            .withColumn("feature", F.when(F.col("leftChild") >= 0, F.col("feature")))
            .withColumn("threshold", F.when(F.col("leftChild") >= 0, F.col("threshold"))))


def _spark(model: FittedModel):
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()
