"""Query registry shared by the catalog modules: one Spark callable per
operator of the inventory, each with its DuckDB oracle text where SQL can
express it.

Every query reads the given tables (through ``risk_frame``) in full. Doubles
are rounded to four digits in both engines, counts are BIGINT, and every
computed column carries the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RiskSchema
from ..session import stored
from ..sources.frames import risk_frame

RS = RiskSchema.risk_frame()
NUM = list(RS.numeric)
CATS = list(RS.categorical)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def round_half_away(c, digits: int):
    """``round(x, d)`` as DuckDB computes it on doubles: scale, round half
    away from zero, unscale. (Spark's ``round`` rounds the decimal text of x,
    which differs on values such as 11850.85235.)"""
    m = float(10 ** digits)
    return F.round(c * F.lit(m), 0) / F.lit(m)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column (the oracle texts do the same)."""
    return df.select(*[
        round_half_away(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_frame(spark, sf_dir)


def rf_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``rf`` (or columns of it) written once, for queries that scan it several times: the
    joins behind it then run, shuffle and spill once, not once a scan."""
    df = rf(spark, sf_dir)
    return stored(df.select(*columns) if columns else df, "risk")


