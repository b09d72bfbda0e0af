"""Preparation on the literal rows of FIXTURES F2 with their known answers."""

import pytest
from pyspark.sql import functions as F

from loanlens.config import RiskSchema
from loanlens.operators import prepare as PR

S = RiskSchema.hmeq()
COLS = ["k", "TARGET_BAD_FLAG", "TARGET_LOSS_AMT", "LOAN", "MORTDUE", "VALUE", "REASON", "JOB",
        "YOJ", "DEROG", "DELINQ", "CLAGE", "NINQ", "CLNO", "DEBTINC"]
SCHEMA = ("k string, TARGET_BAD_FLAG int, TARGET_LOSS_AMT double, LOAN int, MORTDUE double, "
          "VALUE double, REASON string, JOB string, YOJ double, DEROG double, DELINQ double, "
          "CLAGE double, NINQ double, CLNO double, DEBTINC double")
ROWS = [
    ("0", 1, 641.0, 1100, 25860.0, 39025.0, "HomeImp", "Other", 10.5, 0.0, 0.0, 94.366667, 1.0, 9.0, None),
    ("1", 1, 1109.0, 1300, 70053.0, 68400.0, "HomeImp", "Other", 7.0, 0.0, 2.0, 121.833333, 0.0, 14.0, None),
    ("2", 1, 767.0, 1500, 13500.0, 16700.0, "HomeImp", "Other", 4.0, 0.0, 0.0, 149.466667, 1.0, 10.0, None),
    ("3", 1, 1425.0, 1500, None, None, None, None, None, None, None, None, None, None, None),
    ("4", 0, None, 1700, 97800.0, 112000.0, "HomeImp", "Office", 3.0, 0.0, 0.0, 93.333333, 0.0, 14.0, None),
]
IMPUTED = ["MORTDUE", "VALUE", "YOJ", "DEROG", "DELINQ", "CLAGE", "NINQ", "CLNO", "DEBTINC"]
# medians of the reference log for the groups these rows fall in
MEDIANS = [
    ("HomeImp", "Other", 53812.5, 73319.0, 7.0, 0.0, 0.0, 168.666667, 0.0, 15.0, 34.485533),
    ("HomeImp", "Office", 62200.0, 80147.0, 10.0, 0.0, 0.0, 175.082704, 0.0, 17.5, 35.949877),
    ("Unknown", "Unknown", 47811.0, 72583.0, 0.95, 0.0, 0.0, 118.976063, 0.0, 0.0, 23.988913),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_literal_rows_with_given_medians(spark, rows):
    med = spark.createDataFrame(MEDIANS, "REASON string, JOB string, " + ", ".join(
        f"{c} double" for c in IMPUTED))
    imp = PR.Imputer(S, IMPUTED, med)
    out = {r["k"]: r for r in imp.transform(rows).collect()}
    r3 = out["3"]
    assert r3["REASON"] == "Unknown" and r3["JOB"] == "Unknown"
    assert r3["IMP_MORTDUE"] == 47811.0 and r3["IMP_VALUE"] == 72583.0
    assert r3["IMP_YOJ"] == 0.95 and r3["IMP_CLAGE"] == pytest.approx(118.976063)
    assert all(r3[f"M_{c}"] == 1 for c in IMPUTED)
    r2 = out["2"]
    assert r2["IMP_MORTDUE"] == 13500.0 and r2["M_MORTDUE"] == 0
    assert r2["IMP_DEBTINC"] == pytest.approx(34.485533) and r2["M_DEBTINC"] == 1
    assert "MORTDUE" not in imp.transform(rows).columns


def test_fit_finds_null_columns_only(rows):
    imp = PR.fit_imputer(rows, S)
    assert imp.null_cols == IMPUTED            # LOAN has no null; targets skipped


def test_all_null_group_stays_null(spark, rows):
    imp = PR.fit_imputer(rows, S)
    out = {r["k"]: r for r in imp.transform(rows).collect()}
    assert out["3"]["IMP_DEBTINC"] is None     # DEBTINC is null everywhere


def test_dummies_sorted_last_level_dropped(rows):
    enc = PR.fit_dummies(rows, S)
    assert enc.levels["REASON"] == ["HomeImp", "Unknown"]
    assert enc.columns() == ["z_REASON_HomeImp", "z_JOB_Office", "z_JOB_Other"]
    out = {r["k"]: r for r in enc.transform(PR.fill_unknown(rows, S)).collect()}
    assert (out["4"]["z_JOB_Office"], out["4"]["z_JOB_Other"]) == (1, 0)
    assert (out["3"]["z_REASON_HomeImp"], out["3"]["z_JOB_Other"]) == (0, 0)


def test_cap_keeps_null(spark):
    df = spark.createDataFrame([(30000.0,), (None,), (100.0,)], "a double")
    got = [r["a"] for r in PR.cap_amount(df, "a", 25000.0).collect()]
    assert got == [25000.0, None, 100.0]


def test_full_chain_width(rows):
    prep = PR.fit_preparation(rows, S)
    out = prep.transform(rows)
    assert prep.feature_cols[0] == "LOAN"
    assert out.columns[:3] == ["k", "TARGET_BAD_FLAG", "TARGET_LOSS_AMT"]
    assert len(prep.feature_cols) == 1 + 2 * len(IMPUTED) + 3


def test_minmax_constant_and_unclipped(spark):
    train = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "a double, c double")
    other = spark.createDataFrame([(20.0, 7.0)], "a double, c double")
    sc = PR.fit_minmax(train, ["a", "c"])
    assert [tuple(r) for r in sc.transform(train).collect()] == [(0.0, 0.0), (1.0, 0.0)]
    assert tuple(sc.transform(other).first()) == (2.0, 2.0)


def test_median_join_is_broadcast(rows):
    imp = PR.fit_imputer(rows, S)
    out = imp.transform(rows)
    out.collect()
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_levels_as_a_table(spark):
    """The wide-category encoder gives every level its place in string order."""
    df = spark.createDataFrame([(i, None if i % 50 == 7 else f"lv{i % 50:02d}") for i in range(500)], "k int, c string")
    out = PR.encode_levels(df, "c", "place").collect()
    levels = sorted({r["c"] or "Unknown" for r in out})
    assert len(out) == 500 and all(r["place"] == levels.index(r["c"] or "Unknown") for r in out)


def test_queries_of_several_scans_join_once(spark):
    """Queries that fit before they transform read the joined rows from one table, not through the joins again."""
    import __spark_entry__ as E
    for name in ("missing_flags", "impute_group_median", "minmax_scale", "split_counts", "target_mean_by_split", "prepare_full"):
        files = E.queries()[name](spark, E.SMOKE_DIR).inputFiles()
        assert files and not any("lineitem" in f for f in files), name
