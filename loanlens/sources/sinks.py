"""Sinks: SNK1 (CSV comparison table with the run settings in its name) and
SNK2 (one parquet table per report, replacing the reference's text log).

Several runs share one root. A run is a job with its settings; its tables go to
``root/<table>/run_id=<run>/attempt_id=<id>``, and when all are written one row per table
is appended to ``root/manifest``. Readers go by the manifest, so the reports of other
runs stay, a run written again replaces its own reports alone, and one that failed
half way is never seen: its reader still gets the attempt before.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "manifest"


def settings_name(prefix: str, **settings) -> str:
    """``RMSE-Comparison--ep800-var-All-rs1-md5-ft0.005``-style names."""
    short = {"epochs": "ep", "var": "var", "seed": "rs", "max_depth": "md", "thresh": "ft"}
    parts = [f"{short.get(k, k)}{'-' if k == 'var' else ''}{v}" for k, v in settings.items()]
    return prefix + "--" + "-".join(parts)


def write_csv(df: DataFrame, root: str, name: str) -> str:
    """SNK1: header CSV, no index column; a folder of part files."""
    path = os.path.join(root, name + ".csv")
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_reports(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """SNK2: every report table as parquet under ``root/<name>``."""
    out = {}
    for name, df in tables.items():
        path = os.path.join(root, name)
        df.write.mode("overwrite").parquet(path)
        out[name] = path
    return out


def run_id(job: str, settings) -> tuple[str, str]:
    """The run's folder name and its settings as JSON (a dictionary or a dataclass)."""
    plain = asdict(settings) if is_dataclass(settings) else dict(settings)
    text = json.dumps(plain, sort_keys=True, default=str)
    return f"{job}-{hashlib.md5(text.encode()).hexdigest()[:12]}", text


def write_run(tables: dict[str, DataFrame], root: str, job: str, settings) -> str:
    """SNK2 for one run of several in ``root``; returns the run's name. The manifest's
    rows are appended last, in one job: before that, nothing of this attempt is visible."""
    run, text = run_id(job, settings)
    if MANIFEST in tables:
        raise ValueError(f"a report cannot be called {MANIFEST}")
    attempt = uuid.uuid4().hex
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.parquet(os.path.join(root, name, f"run_id={run}", f"attempt_id={attempt}"))
    if spark is not None:
        spark.createDataFrame([(job, run, text, name, attempt) for name in tables],
                              "job string, run_id string, settings string, report string, attempt_id string").coalesce(1) \
            .withColumn("written", F.current_timestamp()).write.mode("append").parquet(os.path.join(root, MANIFEST))
    return run


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The reports in force: job, run_id, settings, report, attempt_id, written; of every run
    its last whole attempt, so that a report it no longer writes is gone too."""
    last = Window.partitionBy("run_id").orderBy(F.desc("written"), F.desc("attempt_id"))
    return (spark.read.parquet(os.path.join(root, MANIFEST))
            .withColumn("_place", F.rank().over(last)).where("_place = 1").drop("_place"))


def read_runs(spark: SparkSession, root: str, report: str, settings: list[str] = ()) -> DataFrame:
    """One report of all runs side by side: its columns (null where a run lacks one), the
    run's name in ``run_id``, and the named settings as text columns. The driver reads the manifest only."""
    found = runs(spark, root).where(F.col("report") == report).orderBy("run_id").collect()
    if not found:
        raise ValueError(f"no run in {root} has a report {report}")
    base = os.path.join(root, report)
    rows = (spark.read.option("basePath", base).option("mergeSchema", True)
            .parquet(*[os.path.join(base, f"run_id={r['run_id']}", f"attempt_id={r['attempt_id']}") for r in found])
            .drop("attempt_id"))
    if not settings:
        return rows
    named = spark.createDataFrame(
        [(r["run_id"], *[None if (v := json.loads(r["settings"]).get(s)) is None else str(v) for s in settings]) for r in found],
        ", ".join(["run_id string", *[f"{s} string" for s in settings]]))
    return rows.join(named, "run_id")
