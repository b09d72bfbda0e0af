"""Profiling queries (SRC1, AGG1-AGG16, ORD2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from .oracle import nan_null, r4, union_all, with_rf
from .registry import CATS, NUM, RS, register, rf, rf_table, rounded


# ------------------------------------------------------------------ scan

@register("scan_profile", with_rf(
    "SELECT count(*) AS n_rows, count(DISTINCT k) AS n_keys, "
    "CAST(sum(target_flag) AS BIGINT) AS n_default, count(target_amt) AS n_loss, "
    f"{r4('sum(loan)', 2)} AS loan_total FROM rf"))
def q_scan_profile(spark, sf_dir):
    df = rf(spark, sf_dir)
    return rounded(df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("k").alias("n_keys"),
        F.sum("target_flag").cast("long").alias("n_default"),
        F.count("target_amt").alias("n_loss"), F.sum("loan").alias("loan_total")), 2)


# ------------------------------------------------------------------ profile

def _frame_info_sql() -> str:
    types = [("k", "string"), ("target_flag", "int"), ("target_amt", "double"),
             ("loan", "double"), ("quantity", "double"), ("acctbal", "double"),
             ("retailprice", "double"), ("psize", "double"), ("discount", "double"),
             ("reason", "string"), ("job", "string")]
    return with_rf(union_all([
        f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS dtype, count({c}) AS non_null FROM rf"
        for i, (c, t) in enumerate(types)]))


@register("frame_info", _frame_info_sql())
def q_frame_info(spark, sf_dir):
    return P.frame_info(rf(spark, sf_dir))


@register("null_counts", with_rf(union_all([
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS nulls FROM rf"
    for c in ["k", *NUM, *CATS]])))
def q_null_counts(spark, sf_dir):
    df = rf(spark, sf_dir)
    return P.null_counts(df, ["k", *NUM, *CATS])


def _quantile_sql(p: float) -> str:
    """Linear-interpolated quantile from ranked rows ``i`` (0-based) of ``n``
    values, written out so both engines do the same double arithmetic."""
    pos = f"((max(n) - 1) * CAST({p} AS DOUBLE))"
    lo = f"max(CASE WHEN i = floor((n - 1) * CAST({p} AS DOUBLE)) THEN x END)"
    hi = f"max(CASE WHEN i = ceil((n - 1) * CAST({p} AS DOUBLE)) THEN x END)"
    d = f"({pos} - floor({pos}))"
    return (f"CASE WHEN max(n) = 0 THEN NULL WHEN {d} = 0 THEN {lo} "
            f"ELSE (1 - {d}) * {lo} + {d} * {hi} END")


def _describe_sql(by: list[str], src: str = "rf", cols=NUM) -> str:
    by_sel = "".join(f"{b}, " for b in by)
    part = ", ".join([*by, "column_name"])
    long = union_all([f"SELECT {by_sel}'{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM {src}"
                      for c in cols])
    return (
        f"SELECT {by_sel}column_name, count(x) AS count, {r4('avg(x)')} AS mean, "
        f"{r4('stddev_samp(x)')} AS std, {r4('min(x)')} AS min, "
        f"{r4(_quantile_sql(0.25))} AS q25, {r4(_quantile_sql(0.5))} AS q50, "
        f"{r4(_quantile_sql(0.75))} AS q75, {r4('max(x)')} AS max FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY x) - 1 AS i, "
        f"count(x) OVER (PARTITION BY {part}) AS n FROM ({long}) l) r GROUP BY {part}")


@register("describe_all", with_rf(_describe_sql([])))
def q_describe_all(spark, sf_dir):
    return rounded(P.describe(rf_table(spark, sf_dir, *NUM), NUM))


@register("describe_all_distributed", with_rf(_describe_sql([])))
def q_describe_all_distributed(spark, sf_dir):
    """AGG2 with exact quartiles by radix selection, asked for by name."""
    return rounded(P.describe(rf_table(spark, sf_dir, *NUM), NUM, method="distributed"))


@register("describe_by_category", with_rf(union_all([
    _describe_sql(["category", "level"], src=f"(SELECT '{c}' AS category, {c} AS level, * FROM rf) s")
    for c in CATS])))
def q_describe_by_category(spark, sf_dir):
    df = rf_table(spark, sf_dir, *NUM, *CATS)
    outs = []
    for c in CATS:
        d = P.describe(df, NUM, by=[c]).select(
            F.lit(c).alias("category"), F.col(c).alias("level"), "*").drop(c)
        outs.append(d)
    return rounded(outs[0].unionByName(outs[1]))


@register("describe_by_categories", with_rf(_describe_sql(CATS)))
def q_describe_by_categories(spark, sf_dir):
    return rounded(P.describe(rf_table(spark, sf_dir, *NUM, *CATS), NUM, by=CATS))


@register("describe_by_categories_distributed", with_rf(_describe_sql(CATS)))
def q_describe_by_categories_distributed(spark, sf_dir):
    """AGG5 with exact quartiles by radix selection, asked for by name."""
    return rounded(P.describe(rf_table(spark, sf_dir, *NUM, *CATS), NUM, by=CATS, method="distributed"))


@register("describe_by_categories_approx")
def q_describe_by_categories_approx(spark, sf_dir):
    """Quartiles by ``percentile_approx``: rows-only check (approximate)."""
    return rounded(P.describe(rf(spark, sf_dir), NUM, by=CATS, method="approx"))


@register("value_counts", with_rf(union_all([
    f"SELECT '{c}' AS category, {c} AS level, count(*) AS count FROM rf GROUP BY {c}"
    for c in CATS])))
def q_value_counts(spark, sf_dir):
    df = rf_table(spark, sf_dir, *CATS)
    outs = [P.value_counts(df, c).select(F.lit(c).alias("category"), F.col(c).alias("level"),
                                         "count") for c in CATS]
    return outs[0].unionByName(outs[1])


def _moment_sql(fn: str, nmin: int, alias: str) -> str:
    return with_rf(union_all([
        f"SELECT '{c}' AS column_name, {r4(f'CASE WHEN count({c}) < {nmin} THEN NULL WHEN min({c}) = max({c}) THEN 0 ELSE {fn}(CAST({c} AS DOUBLE)) END', 6)} AS {alias} FROM rf"
        for c in NUM]))


@register("skewness_unbiased", _moment_sql("skewness", 3, "skewness"))
def q_skewness(spark, sf_dir):
    return rounded(P.skew_kurtosis(rf(spark, sf_dir), NUM).select("column_name", "skewness"), 6)


@register("kurtosis_unbiased", _moment_sql("kurtosis", 4, "kurtosis"))
def q_kurtosis(spark, sf_dir):
    return rounded(P.skew_kurtosis(rf(spark, sf_dir), NUM).select("column_name", "kurtosis"), 6)


@register("group_medians", with_rf(
    "SELECT reason, job, " + ", ".join(f"{r4(f'median(CAST({c} AS DOUBLE))')} AS {c}" for c in NUM)
    + " FROM rf GROUP BY reason, job"))
def q_group_medians(spark, sf_dir):
    return rounded(P.group_medians(rf_table(spark, sf_dir, *CATS, *NUM), CATS, NUM))


@register("group_medians_distributed", with_rf(
    "SELECT reason, job, " + ", ".join(f"{r4(f'median(CAST({c} AS DOUBLE))')} AS {c}" for c in NUM)
    + " FROM rf GROUP BY reason, job"))
def q_group_medians_distributed(spark, sf_dir):
    """AGG10 with the rank-based exact medians used above the size threshold."""
    return rounded(P.group_medians(rf_table(spark, sf_dir, *CATS, *NUM), CATS, NUM, method="distributed"))


@register("target_mean_by_segment", with_rf(
    f"SELECT reason, job, {r4('avg(target_flag)')} AS flag_mean, {r4('avg(target_amt)')} AS amount_mean "
    "FROM rf WHERE reason IS NOT NULL AND job IS NOT NULL GROUP BY reason, job"))
def q_target_mean_by_segment(spark, sf_dir):
    return rounded(P.target_mean_by_segment(rf(spark, sf_dir), RS))


@register("expected_loss", with_rf(
    f"SELECT reason, job, {r4('avg(target_flag)')} AS default_mean, {r4('avg(target_amt)')} AS loss_mean, "
    f"{r4('avg(target_flag) * avg(target_amt)')} AS expected_loss "
    "FROM rf WHERE reason IS NOT NULL AND job IS NOT NULL GROUP BY reason, job"))
def q_expected_loss(spark, sf_dir):
    return rounded(P.expected_loss(rf(spark, sf_dir), RS))


@register("segment_counts", with_rf(
    "SELECT reason, job, count(*) AS observations FROM rf "
    "WHERE reason IS NOT NULL AND job IS NOT NULL GROUP BY reason, job"))
def q_segment_counts(spark, sf_dir):
    return P.segment_counts(rf(spark, sf_dir), RS)


def _corr_sql(by: list[str]) -> str:
    sel_by = "".join(f"{b}, " for b in by)
    where = " WHERE " + " AND ".join(f"{b} IS NOT NULL" for b in by) if by else ""
    grp = f" GROUP BY {', '.join(by)}" if by else ""
    inner = union_all([
        f"SELECT {sel_by}'{c}' AS column_name, {nan_null(f'corr(CAST({c} AS DOUBLE), CAST(target_flag AS DOUBLE))')} AS r FROM rf{where}{grp}"
        for c in NUM])
    return with_rf(f"SELECT {sel_by}column_name, {r4('r', 6)} AS r FROM ({inner}) t "
                   "WHERE r < 1 AND column_name <> 'target_flag'")


@register("corr_with_flag", _corr_sql([]))
def q_corr_with_flag(spark, sf_dir):
    return rounded(P.corr_with_flag(rf(spark, sf_dir), RS), 6)


@register("corr_with_flag_by_segment", _corr_sql(CATS))
def q_corr_with_flag_by_segment(spark, sf_dir):
    return rounded(P.corr_with_flag(rf(spark, sf_dir), RS, by=CATS), 6)


def _hist_sql(bins: int = 20) -> str:
    parts = []
    for c in NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, {x} AS v, "
            f"CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, "
            f"CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi "
            f"FROM rf, (SELECT min({x}) AS mn, max({x}) AS mx FROM rf) m WHERE {x} IS NOT NULL")
    vals = union_all(parts)
    return with_rf(
        f"SELECT column_name, bin, {r4(f'lo + (bin - 1) * (hi - lo) / {bins}.0')} AS bin_lo, "
        f"{r4(f'lo + bin * (hi - lo) / {bins}.0')} AS bin_hi, count(*) AS count FROM ("
        f"SELECT column_name, lo, hi, CAST(least(floor({bins}.0 * (v - lo) / (hi - lo)) + 1, {bins}) AS INTEGER) AS bin "
        f"FROM ({vals}) a) b GROUP BY column_name, bin, lo, hi")


@register("histogram20", _hist_sql())
def q_histogram20(spark, sf_dir):
    return rounded(P.histogram(rf_table(spark, sf_dir, *NUM), NUM, 20))


_HEAD_COLS = ["k", "target_flag", *[c for c in NUM if c != "target_flag"], *CATS]


@register("head5", with_rf("SELECT " + ", ".join(
    c if c in ("k", "target_flag", *CATS) else f"{r4(c)} AS {c}" for c in _HEAD_COLS)
    + " FROM rf ORDER BY k LIMIT 5"))
def q_head5(spark, sf_dir):
    return rounded(P.head(rf(spark, sf_dir), "k", 5))
