"""Profiling aggregates on the inline edge-case frame (FIXTURES F7)."""

import math

import pytest
from pyspark.sql import functions as F

from loanlens.config import RiskSchema
from loanlens.functions.stats import kurtosis_unbiased, pearson, skewness_unbiased
from loanlens.operators import profile as P

ROWS = [("a", 1.0, 5.0), ("a", 2.0, 5.0), ("a", None, 5.0), ("a", 4.0, 5.0),
        (None, 3.0, 1.0), (None, None, None), ("b", 7.0, 2.0)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, "k string, x double, y double")


def pandas_skew(v):
    n = len(v)
    m = sum(v) / n
    m2 = sum((a - m) ** 2 for a in v) / n
    m3 = sum((a - m) ** 3 for a in v) / n
    return math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2 ** 1.5


def pandas_kurt(v):
    n = len(v)
    m = sum(v) / n
    m2 = sum((a - m) ** 2 for a in v) / n
    m4 = sum((a - m) ** 4 for a in v) / n
    g2 = m4 / m2 ** 2 - 3
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def test_skew_kurtosis_corrected(edge):
    out = {r["column_name"]: r for r in P.skew_kurtosis(edge, ["x", "y"]).collect()}
    xs = [1.0, 2.0, 4.0, 3.0, 7.0]
    assert out["x"]["skewness"] == pytest.approx(pandas_skew(xs), rel=1e-12)
    assert out["x"]["kurtosis"] == pytest.approx(pandas_kurt(xs), rel=1e-12)


def test_constant_group_gives_zero_not_null(edge):
    g = edge.where("k = 'a'")
    r = P.skew_kurtosis(g, ["y"]).first()
    assert r["skewness"] == 0.0 and r["kurtosis"] == 0.0


def test_too_few_values_null(edge):
    r = P.skew_kurtosis(edge.where("k = 'b'"), ["x"]).first()
    assert r["skewness"] is None and r["kurtosis"] is None


def test_corr_constant_group_is_null_not_error(edge):
    rows = edge.groupBy("k").agg(pearson("x", "y").alias("r")).collect()
    got = {r["k"]: r["r"] for r in rows}
    assert got["a"] is None          # y constant in group a (T1)
    assert got["b"] is None          # one pair only


def test_describe_keeps_null_group(edge):
    out = P.describe(edge, ["x"], by=["k"]).collect()
    keys = {r["k"] for r in out}
    assert None in keys and {"a", "b"} <= keys
    a = [r for r in out if r["k"] == "a"][0]
    assert a["count"] == 3 and a["q50"] == 2.0 and a["q25"] == 1.5
    b = [r for r in out if r["k"] == "b"][0]
    assert b["std"] is None         # one value: null, not NaN (T8)


@pytest.mark.parametrize("method", ["exact", "distributed"])
def test_describe_methods_agree(edge, method):
    out = {r["column_name"]: r for r in P.describe(edge, ["x", "y"], method=method).collect()}
    assert out["x"]["q25"] == 2.0 and out["x"]["q75"] == 4.0 and out["x"]["q50"] == 3.0
    assert out["y"]["count"] == 6


def test_expected_loss_drops_null_groups(spark):
    s = RiskSchema("f", "a", ("c1", "c2"), ("f", "a"))
    df = spark.createDataFrame([(1, 10.0, "x", "u"), (0, None, "x", "u"), (1, 20.0, None, "u")],
                               "f int, a double, c1 string, c2 string")
    rows = P.expected_loss(df, s).collect()
    assert len(rows) == 1
    assert rows[0]["expected_loss"] == pytest.approx(0.5 * 10.0)


def test_value_counts_keeps_null(edge):
    got = {r["k"]: r["count"] for r in P.value_counts(edge, "k").collect()}
    assert got == {"a": 4, None: 2, "b": 1}


def test_histogram_constant_column_middle_bin(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    rows = P.histogram(df, ["v"], 20).collect()
    assert [(r["bin"], r["count"]) for r in rows] == [(11, 2)]


def test_histogram_max_in_last_bin_and_nulls_skipped(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (None,), (5.0,)], "v double")
    got = {r["bin"]: r["count"] for r in P.histogram(df, ["v"], 20).collect()}
    assert got == {1: 1, 11: 1, 20: 1}


def test_corr_with_flag_removes_self_and_undefined(spark):
    s = RiskSchema("f", "a", ("c",), ("f", "a", "z"))
    df = spark.createDataFrame([(1, 1.0, 5.0, "x"), (0, 3.0, 5.0, "x"), (1, 2.0, 5.0, "x")],
                               "f int, a double, z double, c string")
    cols = [r["column_name"] for r in P.corr_with_flag(df, s).collect()]
    assert cols == ["a"]


def test_moments_of_more_rows_than_a_long_product_holds(spark):
    """n (n - 1) and positives x negatives of 4e9 rows exceed 63 bits."""
    counts = spark.createDataFrame([(0.2, 0, 4_000_000_000), (0.8, 4_000_000_000, 0)], "score double, p long, n long")
    from loanlens.operators import evaluate as EV
    assert EV.auc(None, "y", "score", counts=counts).first()["auc"] == 1.0
    n = F.lit(4_000_000_000).cast("double")
    skew = spark.range(1).select(F.sqrt(n * (n - 1)) / (n - 2), (n - 1) / ((n - 2) * (n - 3))).first()
    assert skew[0] == pytest.approx(1.0) and skew[1] == pytest.approx(2.5e-10)
    plan = spark.range(5).agg(skewness_unbiased("id"), kurtosis_unbiased("id"))._jdf.queryExecution().analyzed().toString()
    assert "as double" in plan
