"""Profiling aggregates (AGG1-AGG18) and ORD2.

Every statistic of one grouping is computed by a single wide aggregate (one
scan, one shuffle of partial buffers, no per-column passes); the small result
is then turned to long form with ``stack``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskSchema
from ..functions.stats import kurtosis_unbiased, pearson, skewness_unbiased, stack_expr
from .quantiles import grouped_quantiles

DESCRIBE_STATS = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def frame_info(df: DataFrame) -> DataFrame:
    """AGG1: position, type and non-null count of every column."""
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    items = []
    exprs = []
    for i, f in enumerate(df.schema.fields):
        items.append((f.name, [f"_p{i}", f"_t{i}", f.name]))
        exprs += [F.lit(i).alias(f"_p{i}"), F.lit(f.dataType.simpleString()).alias(f"_t{i}")]
    return wide.select("*", *exprs).select(
        stack_expr(items, ["column_name", "position", "dtype", "non_null"]))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """AGG9: nulls per column, one aggregate."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    return wide.select(stack_expr([(c, [c]) for c in cols], ["column_name", "nulls"]))


def describe(df: DataFrame, cols: list[str], by: list[str] = (),
             method: str = "distributed", accuracy: int = 100_000) -> DataFrame:
    """AGG2-AGG5: pandas ``describe`` per column (and per ``by`` group, null
    groups kept): count, mean, std (n-1), min, quartiles (linear), max."""
    by = list(by)
    probs, qnames = [0.25, 0.5, 0.75], ["q25", "q50", "q75"]
    if method == "distributed":
        out = grouped_quantiles(df, by, cols, probs, qnames, moments=True).withColumnRenamed("column", "column_name")
        if not by:      # a table without rows has its columns all the same
            names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
            out = names.join(out, "column_name", "left").fillna(0, ["count"])
    else:
        from .quantiles import quantile_exprs
        aggs = []
        for c in cols:
            x = F.col(c).cast("double")
            aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                     F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                     F.max(x).alias(f"{c}__max")]
            for e, n in zip(quantile_exprs(c, probs, method, accuracy), qnames):
                aggs.append(e.alias(f"{c}__{n}"))
        wide = df.groupBy(*by).agg(*aggs)
        items = [(c, [f"{c}__{s}" for s in DESCRIBE_STATS]) for c in cols]
        out = wide.select(*by, stack_expr(items, ["column_name", *DESCRIBE_STATS]))
    return out.select(*by, "column_name", *DESCRIBE_STATS)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """AGG6: rows per value, the null value included, most frequent first."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_first(col)))


def skew_kurtosis(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG7 + AGG8: bias-corrected skewness and excess kurtosis per column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [skewness_unbiased(x).alias(f"{c}__skew"), kurtosis_unbiased(x).alias(f"{c}__kurt")]
    wide = df.agg(*aggs)
    items = [(c, [f"{c}__skew", f"{c}__kurt"]) for c in cols]
    return wide.select(stack_expr(items, ["column_name", "skewness", "kurtosis"]))


def group_medians(df: DataFrame, by: list[str], cols: list[str], method: str = "distributed",
                  accuracy: int = 100_000) -> DataFrame:
    """AGG10: median of every column per group, null groups kept (wide)."""
    by = list(by)
    if method == "distributed":
        long = grouped_quantiles(df, by, cols, [0.5], ["median"], method="distributed")
        return long.groupBy(*by).pivot("column", list(cols)).agg(F.first("median"))
    from .quantiles import quantile_exprs
    return df.groupBy(*by).agg(*[quantile_exprs(c, [0.5], method, accuracy)[0].alias(c)
                                 for c in cols])


def target_mean_by_segment(df: DataFrame, s: RiskSchema) -> DataFrame:
    """AGG11: mean of each target per category pair; null groups dropped."""
    cats = list(s.categorical)
    return (df.dropna(subset=cats).groupBy(*cats)
            .agg(F.avg(s.flag).alias("flag_mean"), F.avg(s.amount).alias("amount_mean")))


def expected_loss(df: DataFrame, s: RiskSchema) -> DataFrame:
    """AGG12: default rate x mean loss per category pair; null groups dropped."""
    cats = list(s.categorical)
    return (df.dropna(subset=cats).groupBy(*cats)
            .agg(F.avg(s.flag).alias("default_mean"), F.avg(s.amount).alias("loss_mean"))
            .withColumn("expected_loss", F.col("default_mean") * F.col("loss_mean")))


def segment_counts(df: DataFrame, s: RiskSchema) -> DataFrame:
    """AGG13: rows per category pair; null groups dropped."""
    cats = list(s.categorical)
    return (df.dropna(subset=cats).groupBy(*cats)
            .agg(F.count(F.lit(1)).alias("observations")))


def corr_with_flag(df: DataFrame, s: RiskSchema, by: list[str] = ()) -> DataFrame:
    """AGG14 / AGG15: Pearson correlation of every numeric column with the
    flag (pairwise complete), per group when ``by`` is given (null groups
    dropped). Undefined values and the flag itself are removed by ``r < 1``,
    as the reference's ``query`` does; sorted descending."""
    by = list(by)
    base = df.dropna(subset=by) if by else df
    cols = list(s.numeric)
    wide = base.groupBy(*by).agg(*[pearson(c, s.flag).alias(f"{c}__r") for c in cols])
    long = wide.select(*by, stack_expr([(c, [f"{c}__r"]) for c in cols], ["column_name", "r"]))
    return (long.where((F.col("r") < 1) & (F.col("column_name") != s.flag))
            .orderBy(F.desc("r"), *by, "column_name"))


def histogram(df: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """AGG16: equal-width histogram per column (numpy ``histogram`` bins).

    One aggregate gets min and max of every column (one row to the driver);
    then each value's bin is computed in place and ``stack`` + a grouped
    count (combined map-side) tallies all columns in one shuffle. A constant
    column gets numpy's range (v - 0.5, v + 0.5): every value in the middle
    bin.
    """
    mm = df.agg(*[F.min(F.col(c).cast("double")).alias(f"{c}__mn") for c in cols],
                *[F.max(F.col(c).cast("double")).alias(f"{c}__mx") for c in cols]).first()
    bexprs, items = [], []
    for c in cols:
        mn, mx = mm[f"{c}__mn"], mm[f"{c}__mx"]
        if mn is None:
            continue
        if mn == mx:
            mn, mx = mn - 0.5, mx + 0.5
        x = F.col(c).cast("double")
        # ``least`` skips nulls, so a missing value must stay outside it
        b = F.when(x.isNotNull(), F.least(
            F.floor(F.lit(float(bins)) * (x - F.lit(mn)) / F.lit(mx - mn)) + 1,
            F.lit(bins))).cast("int")
        bexprs.append(b.alias(f"{c}__bin"))
        items.append((c, [f"{c}__bin"]))
    long = df.select(*bexprs).select(stack_expr(items, ["column_name", "bin"]))
    counts = long.where(F.col("bin").isNotNull()).groupBy("column_name", "bin").agg(
        F.count(F.lit(1)).alias("count"))
    edges = df.sparkSession.createDataFrame(
        [(c, float(mm[f"{c}__mn"] - (0.5 if mm[f"{c}__mn"] == mm[f"{c}__mx"] else 0)),
          float(mm[f"{c}__mx"] + (0.5 if mm[f"{c}__mn"] == mm[f"{c}__mx"] else 0)))
         for c in cols if mm[f"{c}__mn"] is not None],
        "column_name string, lo double, hi double")
    span = F.col("hi") - F.col("lo")
    # the edge table has one row per column: a proven size bound for the broadcast
    return (counts.join(F.broadcast(edges), "column_name")
            .select("column_name", "bin",
                    (F.col("lo") + (F.col("bin") - 1) * span / F.lit(float(bins))).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * span / F.lit(float(bins))).alias("bin_hi"),
                    "count"))


def target_mean_by_split(df: DataFrame, target: str, split_col: str = "split") -> DataFrame:
    """AGG17: mean target per split (the base of the error ratio)."""
    return df.groupBy(split_col).agg(F.avg(target).alias("target_mean"),
                                     F.count(target).alias("n"))


def split_counts(df: DataFrame, feature_cols: list[str], split_col: str = "split") -> DataFrame:
    """AGG18: rows and feature width of each split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "cols", F.lit(len(feature_cols)))


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """ORD2: first ``n`` rows in key order (a top-k, not a full sort)."""
    return df.orderBy(key).limit(n)
