"""PRE8 exact and TUN4: hash-bucket ranks equal a global sort, at any bucket size."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from loanlens.operators.split import _selected_hash, assign_folds, key_hash, split_exact
from loanlens.session import stored_parts


def _md5(seed, k):
    return "" if k is None else hashlib.md5(f"{seed}{k}".encode()).hexdigest()


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.333, 1.0])
def test_split_exact_takes_the_smallest_hashes(spark, fraction):
    df = spark.range(2503).withColumn("x", F.col("id") % 3).repartition(5)
    rows = split_exact(df, "id", 7, fraction).collect()
    test = {r["id"] for r in rows if r["split"] == "test"}
    order = sorted(range(2503), key=lambda k: _md5(7, k))
    assert len(rows) == 2503 and test == set(order[:math.ceil(round(2503 * fraction, 9))])


@pytest.mark.parametrize("digits", [1, 2, 5, 32])
def test_selection_in_any_number_of_passes(spark, digits):
    df = spark.range(400)
    hashes = sorted(_md5(1, k) for k in range(400))
    for n in (1, 2, 57, 399, 400):
        cut = _selected_hash(df, key_hash("id", 1), lambda rows, n=n: n, digits)
        assert [h for h in hashes if h[:len(cut)] <= cut] == hashes[:n]


def test_split_exact_edge_cases(spark):
    empty = split_exact(spark.range(0), "id")
    assert empty.columns == ["id", "split"] and empty.count() == 0
    # a null key comes first; rows that share a key stay together
    df = spark.createDataFrame([(None,), (1,), (1,), (1,), (2,), (3,)], "k long")
    got = split_exact(df, "k", 1, 1 / 6).collect()
    assert [r["k"] for r in got if r["split"] == "test"] == [None]
    for f in (0.2, 0.4, 0.5, 0.7, 0.9):
        got = split_exact(df, "k", 1, f).collect()
        assert len({r["split"] for r in got if r["k"] == 1}) == 1
        assert sum(r["split"] == "test" for r in got) >= math.ceil(6 * f)


def test_split_exact_moves_no_rows(spark):
    plan = split_exact(spark.range(1000), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


@pytest.mark.parametrize("digits", [1, 4])
def test_folds_are_dealt_by_rank_in_every_class(spark, digits):
    # one class holds most rows; one class is null
    df = spark.range(3000).withColumn("c", F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 == 7, None).otherwise(0))
    got = {r["id"]: r["fold"] for r in assign_folds(df.repartition(7), "id", 5, 3, stratify="c", digits=digits).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r["c"], []).append(r["id"])
    want = {k: i % 5 for ks in by.values() for i, k in enumerate(sorted(ks, key=lambda k: _md5("fold3", k)))}
    assert got == want


def test_folds_use_no_range_partitioning(spark):
    df = spark.range(1000).withColumn("c", F.col("id") % 2)
    plan = assign_folds(df, "id", stratify="c")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan
    assert assign_folds(spark.range(0).withColumn("c", F.lit(1)), "id", stratify="c").count() == 0


def test_folds_cross_one_exchange_and_no_join(spark):
    df = spark.range(1000).withColumn("c", F.col("id") % 2)
    plan = assign_folds(df, "id", stratify="c")._jdf.queryExecution().executedPlan().toString().split("\n\n")[0]
    assert "Join" not in plan
    # the rows once, the bucket counts by (class, bucket) and by class
    assert plan.count("Exchange") == 3


def test_parts_are_read_back_as_one_table(spark):
    a, b = spark.createDataFrame([(1, 0), (2, None)], "k long, fold int"), spark.createDataFrame([], "k long, fold int")
    got = stored_parts({"train": a, "test": b}, "parts", "split")
    assert got.columns == ["k", "fold", "split"]
    assert sorted(map(tuple, got.collect())) == [(1, 0, "train"), (2, None, "train")]
