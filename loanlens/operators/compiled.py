"""MOD12: fitted trees, ensembles and linear models as one column expression.

Scoring is then an ordinary projection: no vector is assembled, no Python worker
started, only the model's own features are read, and filters pass through it. The
text of a tree is a nested ``if``; an ensemble is a sum of such texts.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Nodes up to which an ensemble is compiled; beyond, its expression takes longer to plan than to run.
NODES = 20_000


def _number(v: float) -> str:
    return f"{float(v)!r}D" if v >= 0 else f"({float(v)!r}D)"


def _name(feature: str) -> str:
    return "CAST(`" + feature.replace("`", "``") + "` AS DOUBLE)"


def tree_text(nodes: dict, at: int = 0) -> str:
    """``nodes``: number -> (feature, threshold, left, right), or the value of a leaf. Rows up to
    the threshold go left."""
    node = nodes[at]
    if not isinstance(node, tuple):
        return _number(node)
    feature, threshold, left, right = node
    return f"IF({_name(feature)} <= {_number(threshold)}, {tree_text(nodes, left)}, {tree_text(nodes, right)})"


def sum_text(terms: list[str], width: int = 32) -> str:
    """A sum in groups of ``width``, so that the expression does not nest as deep as the sum is long."""
    while len(terms) > 1:
        terms = ["(" + " + ".join(terms[i:i + width]) + ")" for i in range(0, len(terms), width)]
    return terms[0] if terms else "0D"


def weighted_text(trees: list[dict], weights: list[float]) -> str:
    return sum_text([tree_text(t) if w == 1 else f"{_number(w)} * {tree_text(t)}" for t, w in zip(trees, weights)])


def linear_text(features: list[str], coefficients, intercept: float) -> str:
    return sum_text([*[f"{_number(c)} * {_name(f)}" for f, c in zip(features, coefficients)], _number(intercept)])


def logistic_text(margin: str, factor: int = 1) -> str:
    return f"1D / (1D + exp(-{factor} * ({margin})))"


def refuse(features: list[str], text: str, nan: bool = True) -> Column:
    """The expression, or an error at a row with a missing feature (``nan``: NaN counts as missing)."""
    missing = " OR ".join(f"({_name(f)} IS NULL{f' OR isnan({_name(f)})' if nan else ''})" for f in features)
    value = F.expr(text).cast("double")
    if not features:
        return value
    return F.when(F.expr(missing), F.raise_error(F.lit("a feature of a scored row is missing")).cast("double")).otherwise(value)


def saved_nodes(spark: SparkSession, estimator, features: list[str], stats: bool) -> list[dict]:
    """Node tables of a fitted Spark ML tree or ensemble, one per tree (``stats``: a leaf's value
    is the share of class 1 there). At most trees x 2 ^ (depth + 1) rows reach the driver."""
    path = os.path.join(checkpoint_dir(spark), f"nodes-{uuid.uuid4().hex}")
    estimator.write().save(path)
    data = spark.read.parquet(os.path.join(path, "data"))
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    rows = data.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split.featureIndex",
                       F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).collect()
    trees: dict[int, dict] = {}
    for r in rows:
        if r["leftChild"] >= 0:
            node = (features[r["featureIndex"]], r["threshold"], r["leftChild"], r["rightChild"])
        elif stats:
            total = sum(r["impurityStats"])
            node = r["impurityStats"][1] / total if total else 0.0
        else:
            node = r["prediction"]
        trees.setdefault(r["treeID"], {})[r["id"]] = node
    return [trees[k] for k in sorted(trees)]


def used(trees: list[dict], features: list[str]) -> list[str]:
    met = {n[0] for t in trees for n in t.values() if isinstance(n, tuple)}
    return [f for f in features if f in met]
