"""Driver contract: entry() runs; every oracle key is a registered query;
a sample of oracles equals the Spark result at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from loanlens.sources.frames import TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["reason", "job", "default_mean", "loss_mean", "expected_loss"]


def test_oracles_are_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows),
                  key=lambda t: repr(tuple(x for x in t if not isinstance(x, float))))


def _same(a, b):
    """Equal, doubles within one unit of the fourth decimal: an exact mean on
    a rounding tie may round either way depending on summation order."""
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1.5e-4 * max(1.0, abs(a) * 1e-8)
    return a == b


@pytest.mark.parametrize("name", ["expected_loss", "describe_by_categories", "group_medians",
                                  "corr_with_flag_by_segment", "histogram20", "prepare_full",
                                  "split_exact", "fold_assign", "roc_points", "auc",
                                  "best_by_max", "ols", "model_frames", "tree_stump_classifier",
                                  "tree_stump_regressor", "cv_rmse_one_feature"])
def test_oracle_matches(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF001)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    a, b = _norm(sdf.collect(), sdf.columns), _norm(rel.fetchall(), rel.columns)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if not all(_same(u, v) for u, v in zip(x, y))]
    assert not bad, bad[:3]
