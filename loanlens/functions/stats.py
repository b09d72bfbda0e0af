"""Column-expression helpers for the profiling aggregates.

All are built-in Spark expressions, so they stay inside whole-stage codegen
and combine map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def skewness_unbiased(c) -> Column:
    """Bias-corrected sample skewness (pandas ``skew``).

    ``F.skewness`` is the population form g1; G1 = g1 * sqrt(n(n-1)) / (n-2).
    Null below three values; 0 for a constant column (pandas returns 0 there,
    Spark's own aggregate returns null).
    """
    x = _c(c)
    n = F.count(x).cast("double")       # n (n - 1) leaves 63 bits beyond 3e9 rows
    g1 = F.skewness(x)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.min(x) == F.max(x), F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def kurtosis_unbiased(c) -> Column:
    """Bias-corrected excess kurtosis (pandas ``kurt``).

    G2 = (n-1) / ((n-2)(n-3)) * ((n+1) g2 + 6) with g2 the population excess
    kurtosis of ``F.kurtosis``. Null below four values; 0 for a constant.
    """
    x = _c(c)
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(F.min(x) == F.max(x), F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def pearson(x, y) -> Column:
    """Pairwise-complete Pearson correlation that is null (not an error) when
    either side is constant.

    ``F.corr`` raises DIVIDE_BY_ZERO under ANSI mode on a constant group, even
    behind a ``when`` guard; covariance over the product of standard
    deviations with ``try_divide`` gives the same value and null instead.
    Both sides are masked to the rows where the other is present.
    """
    xc, yc = _c(x), _c(y)
    xm = F.when(yc.isNotNull(), xc)
    ym = F.when(xc.isNotNull(), yc)
    # a constant side is detected exactly by min < max: merged partial
    # moments can leave a standard deviation of 1e-17 instead of 0
    varies = (F.min(xm) < F.max(xm)) & (F.min(ym) < F.max(ym))
    return F.when(varies, F.try_divide(F.covar_pop(xm, ym), F.stddev_pop(xm) * F.stddev_pop(ym)))


def stack_expr(items: list[tuple[str, list[str]]], out_cols: list[str]) -> Column:
    """``stack`` turning one wide row into one row per item.

    ``items`` is ``[(label, [column, ...]), ...]``; each label becomes the
    first output column, the listed columns the following ones.
    """
    parts = []
    for label, cols in items:
        parts.append("'" + label.replace("'", "\\'") + "'")
        parts.extend(f"`{c}`" for c in cols)
    names = ", ".join(f"`{c}`" for c in out_cols)
    return F.expr(f"stack({len(items)}, {', '.join(parts)}) AS ({names})")
