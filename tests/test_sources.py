"""SRC1 CSV reader (NaN to null, content key with duplicates) and sinks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from loanlens.sources.frames import read_loans_csv
from loanlens.config import RunConfig
from loanlens.sources.sinks import read_runs, run_id, runs, settings_name, write_csv, write_reports, write_run

HEADER = ("TARGET_BAD_FLAG,TARGET_LOSS_AMT,LOAN,MORTDUE,VALUE,REASON,JOB,YOJ,DEROG,DELINQ,"
          "CLAGE,NINQ,CLNO,DEBTINC")
LINES = [
    "1,641,1100,25860,39025,HomeImp,Other,10.5,0,0,94.366667,1,9,",
    "1,1109,1300,70053,68400,HomeImp,Other,7,0,2,121.833333,0,14,",
    "1,1425,1500,,,,,,,,,,,",
    "1,1425,1500,,,,,,,,,,,",
    "0,,1700,97800,112000,HomeImp,Office,3,0,0,93.333333,0,14,NaN",
]


def test_csv_nan_null_and_unique_keys(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "loans.csv")
    with open(p, "w") as f:
        f.write(HEADER + "\n" + "\n".join(LINES) + "\n")
    df = read_loans_csv(spark, p)
    rows = df.collect()
    assert len(rows) == 5
    assert df.select("k").distinct().count() == 5
    assert sum(r["DEBTINC"] is None for r in rows) == 5
    assert sum(r["REASON"] is None for r in rows) == 2
    assert dict(df.dtypes)["LOAN"] == "int"


def test_sinks_round_trip(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "model string, rmse double")
    name = settings_name("RMSE-Comparison", epochs=800, var="All", seed=1, max_depth=5, thresh=0.005)
    assert name == "RMSE-Comparison--ep800-var-All-rs1-md5-ft0.005"
    path = write_csv(df, d, name)
    back = spark.read.option("header", True).schema("model string, rmse double").csv(path)
    assert sorted(map(tuple, back.collect())) == [("a", 1.5), ("b", 2.5)]
    paths = write_reports({"metrics": df}, d)
    assert spark.read.parquet(paths["metrics"]).count() == 2


def test_csv_reads_numbers_and_missing_tokens_as_pandas(spark, tmp_path):
    import pandas as pd
    lines = ["1,641,1100.0,25860,39025,NaN,NA,10.5,0,0,94.366667,1,9,n/a",
             "0,null,1300, 70053,<NA>,HomeImp,None,7,0,2,-1e3,0,14,NULL"]
    p = tmp_path / "loans.csv"
    p.write_text(HEADER + "\n" + "\n".join(lines) + "\n")
    rows = sorted(read_loans_csv(spark, str(p)).drop("k").collect(), key=lambda r: r["LOAN"])
    want = pd.read_csv(p)
    for r, (_, w) in zip(rows, want.iterrows()):
        for c in want.columns:
            assert (r[c] is None and pd.isna(w[c])) or r[c] == w[c], c
    assert rows[0]["LOAN"] == 1100
    for bad in ("1,641,11x0,1,1,a,b,1,1,1,1,1,1,1", "1,641,1100.5,1,1,a,b,1,1,1,1,1,1,1"):
        p.write_text(HEADER + "\n" + bad + "\n")
        with pytest.raises(Exception, match="malformed number in LOAN"):
            read_loans_csv(spark, str(p)).collect()


def _table(spark, *rows):
    return spark.createDataFrame(list(rows), "run string, value double")


def test_runs_stay_side_by_side(spark, tmp_path):
    root = str(tmp_path)
    one, two = RunConfig(seed=1), RunConfig(seed=2)
    a = write_run({"metrics": _table(spark, ("x", 1.0)), "nodes": _table(spark, ("n", 0.0))}, root, "fit", one)
    b = write_run({"metrics": _table(spark, ("x", 2.0)).withColumn("extra", F.lit(1))}, root, "fit", two)
    c = write_run({"metrics": _table(spark, ("x", 3.0))}, root, "compare", one)
    assert len({a, b, c}) == 3 and a == run_id("fit", RunConfig(seed=1))[0]
    got = {(r["run_id"], r["value"], r["extra"], r["seed"]) for r in read_runs(spark, root, "metrics", ["seed"]).collect()}
    assert got == {(a, 1.0, None, "1"), (b, 2.0, 1, "2"), (c, 3.0, None, "1")}
    # a run written again replaces its own reports alone, and drops those it has no more
    assert write_run({"metrics": _table(spark, ("x", 9.0), ("y", 8.0))}, root, "fit", RunConfig(seed=1)) == a
    got = {(r["run_id"], r["value"]) for r in read_runs(spark, root, "metrics").collect()}
    assert got == {(a, 9.0), (a, 8.0), (b, 2.0), (c, 3.0)}
    assert {(r["run_id"], r["report"]) for r in runs(spark, root).collect()} == {(a, "metrics"), (b, "metrics"), (c, "metrics")}
    with pytest.raises(ValueError, match="no run"):
        read_runs(spark, root, "nodes")


def test_failed_run_is_never_seen(spark, tmp_path):
    root = str(tmp_path)
    a = write_run({"metrics": _table(spark, ("x", 1.0))}, root, "fit", {"cap": 1})
    fails = _table(spark, ("x", 2.0)).withColumn("value", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        write_run({"metrics": _table(spark, ("x", 5.0)), "nodes": fails}, root, "fit", {"cap": 1})
    assert [(r["run_id"], r["value"]) for r in read_runs(spark, root, "metrics").collect()] == [(a, 1.0)]
    # an empty report is a report: the run's earlier rows are gone
    write_run({"metrics": _table(spark, ("x", 1.0)).where("value < 0")}, root, "fit", {"cap": 1})
    assert read_runs(spark, root, "metrics").count() == 0
