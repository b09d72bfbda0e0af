"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner"):
    """Equi-join on ``on`` where null keys match each other (SQL ``<=>``),
    keeping one copy of the key columns. Spark plans ``<=>`` keys as a
    normal hash or sort-merge join."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on],
                     *[c for c in right.columns if c not in on])
    cond = None
    for c in on:
        e = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])
