"""Radix selection of quantiles against numpy: spread, tied, special and missing values."""

import numpy as np
import pytest

from loanlens.operators import profile as P
from loanlens.operators import quantiles as Q

PROBS, NAMES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], ["a", "b", "c", "d", "e", "f"]


def frame(spark, groups):
    rows = [(g, float(v) if v is not None else None) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, x double").repartition(5)


def values_of_every_kind():
    r = np.random.default_rng(7)
    return {
        "wide": (r.choice([-1, 1], 700) * np.exp2(r.uniform(-1070, 1020, 700))).tolist(),
        "near": (1 + np.arange(300) * 2.0 ** -52).tolist(),      # neighbouring doubles
        "tied": r.choice([3.0, 3.0000000000000004, 7.0], 500, p=[.5, .3, .2]).tolist(),
        "zero": [0.0, -0.0, 0.0, 5e-324, -5e-324, 1.0],
        "one": [4.0], "same": [2.5] * 40, "gaps": [None, 1.0, None, 2.0], "none": [None, None],
        None: r.normal(0, 1, 400).tolist(),
    }


@pytest.mark.parametrize("parts, ranked", [(Q.PARTS, Q.RANKED), (2, 1), (16, 3)])
def test_equal_to_numpy(spark, parts, ranked):
    groups = values_of_every_kind()
    if parts == 2:                  # 1,100 binary exponents would take as many passes as bits
        groups = {k: groups[k] for k in ("tied", "zero", "one", "none")}
    got = {r["g"]: r for r in Q.long_quantiles(frame(spark, groups), ["g"], "x", PROBS, NAMES,
                                               parts=parts, ranked=ranked).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        v = np.sort([x for x in values if x is not None])
        for p, name in zip(PROBS, NAMES):
            if not len(v):
                assert got[g][name] is None
                continue
            pos = (len(v) - 1) * p
            lo, hi, fr = v[int(np.floor(pos))], v[int(np.ceil(pos))], pos - np.floor(pos)
            assert got[g][name] == (lo if fr == 0 else (1 - fr) * lo + fr * hi), (g, p)


def test_infinite_and_not_a_number(spark):
    inf, nan = float("inf"), float("nan")
    df = frame(spark, {"a": [-inf, -1.7e308, 1.7e308, inf, nan]})
    r = Q.long_quantiles(df, ["g"], "x", [0, .25, .5, .75, 1], list("pqrst"), ranked=1).first()
    assert [r["p"], r["q"], r["r"], r["s"]] == [-inf, -1.7e308, 1.7e308, inf] and np.isnan(r["t"])


def test_describe_moments_come_from_the_buckets(spark):
    groups = {k: v for k, v in values_of_every_kind().items() if k != "wide"}
    groups["far"] = [1e9 + k / 8 for k in range(200)] + [-3.0]
    df = frame(spark, groups)
    key = lambda r: str(r["g"])     # noqa: E731
    ours = sorted(P.describe(df, ["x"], by=["g"]).collect(), key=key)
    plain = sorted(P.describe(df, ["x"], by=["g"], method="exact").collect(), key=key)
    assert [r["g"] for r in ours] == [r["g"] for r in plain]
    for a, b in zip(ours, plain):
        for c in P.DESCRIBE_STATS:
            assert a[c] == (None if b[c] is None else pytest.approx(b[c], rel=1e-12, abs=1e-14)), (a, b, c)


def test_table_without_rows(spark):
    df = spark.createDataFrame([], "g string, x double, y double")
    got = P.describe(df, ["x", "y"]).collect()
    assert sorted((r["column_name"], r["count"], r["mean"], r["q50"]) for r in got) == [("x", 0, None, None), ("y", 0, None, None)]
    assert P.describe(df, ["x"], by=["g"]).count() == 0
    assert P.group_medians(df, ["g"], ["x", "y"]).count() == 0


def test_only_counts_are_exchanged(spark):
    """No range partitioning, no exchange of single values in the first pass."""
    df = spark.range(1000).selectExpr("cast(id % 3 as string) g", "cast(id as double) _x")
    plan = Q._first_pass(df, ["g"], [0.5], True)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "partial_count" in plan
