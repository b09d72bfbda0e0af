"""Preparation, split and fold queries (PRE1-PRE10, AGG17, AGG18, TUN4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import prepare as PR
from ..operators import profile as P
from ..operators import split as SP
from ..session import checkpoint_dir, stored
from ..sources.sinks import read_runs, write_run
from .oracle import r4, with_rf
from .q_profile import _describe_sql
from .registry import RS, register, rf, rf_table, rounded

CAP = 25_000.0
SEED = 1
# The columns with nulls and the sorted category levels of the
# test tables (the oracle texts spell out what ``fit`` finds in the data).
NULL_COLS = ["quantity", "acctbal", "retailprice", "psize"]
PLAIN = ["loan", "discount"]
LEVELS = {"reason": ["F", "O", "Unknown"],
          "job": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Unknown"]}
DUMMIES = [f"z_{c}_{lv}" for c, lvs in LEVELS.items() for lv in lvs[:-1]]
FEATURES = PLAIN + [x for c in NULL_COLS for x in (f"M_{c}", f"IMP_{c}")] + DUMMIES
TEST_SQL = "substr(md5('1' || k), 1, 4) < '3333'"


def _prep_ctes(fit_where: str = "TRUE") -> list[str]:
    f = ("f AS (SELECT * REPLACE (coalesce(reason, 'Unknown') AS reason, "
         "coalesce(job, 'Unknown') AS job) FROM rf)")
    m = ("m AS (SELECT reason, job, " + ", ".join(
        f"median({c}) AS med_{c}" for c in NULL_COLS) + f" FROM f WHERE {fit_where} GROUP BY reason, job)")
    cols = ["k", "target_flag",
            f"CASE WHEN target_amt > {CAP} THEN {CAP} ELSE target_amt END AS target_amt",
            *PLAIN]
    for c in NULL_COLS:
        cols += [f"CAST({c} IS NULL AS INTEGER) AS M_{c}", f"coalesce({c}, med_{c}) AS IMP_{c}"]
    for c, lvs in LEVELS.items():
        cols += [f"CAST({c} = '{lv}' AS INTEGER) AS z_{c}_{lv}" for lv in lvs[:-1]]
    prep = f"prep AS (SELECT {', '.join(cols)} FROM f LEFT JOIN m USING (reason, job))"
    return [f, m, prep]


def _round_cols(cols, src="") -> str:
    out = []
    for c in cols:
        if c.startswith(("M_", "z_")) or c in ("k", "target_flag", "split", "fold"):
            out.append(f"{src}{c}")
        else:
            out.append(f"{r4(src + c)} AS {c}")
    return ", ".join(out)


def prepared(spark, sf_dir, fit_on_train: bool = False):
    df = rf_table(spark, sf_dir)        # scanned by every fit and by the transform
    fit_rows = None
    if fit_on_train:
        fit_rows = SP.split_hash(df, "k", SEED).where("split = 'train'").drop("split")
    prep = PR.fit_preparation(df, RS, cap=CAP, fit_rows=fit_rows)
    return prep, prep.transform(df)


@register("fill_unknown", with_rf(
    "SELECT k, coalesce(reason, 'Unknown') AS reason, coalesce(job, 'Unknown') AS job FROM rf"))
def q_fill_unknown(spark, sf_dir):
    return PR.fill_unknown(rf(spark, sf_dir), RS).select("k", "reason", "job")


@register("missing_flags", with_rf(
    "SELECT k, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS M_{c}" for c in NULL_COLS)
    + " FROM rf"))
def q_missing_flags(spark, sf_dir):
    _, out = prepared(spark, sf_dir)
    return out.select("k", *[f"M_{c}" for c in NULL_COLS])


@register("impute_group_median", with_rf(
    "SELECT k, " + ", ".join(f"{r4(f'IMP_{c}')} AS IMP_{c}" for c in NULL_COLS) + " FROM prep",
    *_prep_ctes()))
def q_impute_group_median(spark, sf_dir):
    _, out = prepared(spark, sf_dir)
    return rounded(out.select("k", *[f"IMP_{c}" for c in NULL_COLS]))


@register("dummy_encode", with_rf(
    "SELECT k, " + ", ".join(DUMMIES) + " FROM prep", *_prep_ctes()))
def q_dummy_encode(spark, sf_dir):
    df = rf_table(spark, sf_dir, "k", *RS.categorical, *RS.features)
    enc = PR.fit_dummies(df, RS)
    return enc.transform(PR.fill_unknown(df, RS).select("k", *RS.categorical))


@register("cap_amount", with_rf(
    f"SELECT k, {r4(f'CASE WHEN target_amt > {CAP} THEN {CAP} ELSE target_amt END')} AS target_amt FROM rf"))
def q_cap_amount(spark, sf_dir):
    return rounded(PR.cap_amount(rf(spark, sf_dir), "target_amt", CAP).select("k", "target_amt"))


_CAP_SRC = ("(SELECT 'before' AS stage, target_amt FROM rf UNION ALL SELECT 'after' AS stage, "
            f"CASE WHEN target_amt > {CAP} THEN {CAP} ELSE target_amt END AS target_amt FROM rf) c")


@register("describe_loss_cap", with_rf(_describe_sql(["stage"], src=_CAP_SRC, cols=["target_amt"])))
def q_describe_loss_cap(spark, sf_dir):
    """AGG3: describe of the loss amount before and after the cap."""
    df = rf_table(spark, sf_dir, "target_amt")
    both = df.withColumn("stage", F.lit("before")).unionByName(
        PR.cap_amount(df, "target_amt", CAP).withColumn("stage", F.lit("after")))
    return rounded(P.describe(both, ["target_amt"], by=["stage"]))


@register("prepare_full", with_rf(
    f"SELECT {_round_cols(['k', 'target_flag', 'target_amt', *FEATURES])} FROM prep", *_prep_ctes()))
def q_prepare_full(spark, sf_dir):
    _, out = prepared(spark, sf_dir)
    return rounded(out)


@register("prepare_train_fit", with_rf(
    f"SELECT {_round_cols(['k', 'target_flag', 'target_amt', *FEATURES])} FROM prep",
    *_prep_ctes(fit_where=f"NOT ({TEST_SQL})")))
def q_prepare_train_fit(spark, sf_dir):
    _, out = prepared(spark, sf_dir, fit_on_train=True)
    return rounded(out)


@register("loss_population", with_rf(
    f"SELECT k, {r4('target_amt')} AS target_amt FROM rf WHERE target_amt IS NOT NULL"))
def q_loss_population(spark, sf_dir):
    return rounded(SP.loss_population(rf(spark, sf_dir), "target_amt").select("k", "target_amt"))


@register("split_hash", with_rf(
    f"SELECT k, CASE WHEN {TEST_SQL} THEN 'test' ELSE 'train' END AS split FROM rf"))
def q_split_hash(spark, sf_dir):
    return SP.split_hash(rf(spark, sf_dir), "k", SEED).select("k", "split")


@register("split_exact", with_rf(
    "SELECT k, CASE WHEN row_number() OVER (ORDER BY md5('1' || k), k) <= "
    "ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM rf"))
def q_split_exact(spark, sf_dir):
    # each counting pass scans the keys: written once, the joins behind them run once
    return SP.split_exact(stored(rf(spark, sf_dir).select("k"), "keys"), "k", SEED)


@register("fold_assign", with_rf(
    "SELECT k, target_flag, CAST((row_number() OVER (PARTITION BY target_flag "
    "ORDER BY md5('fold1' || k), k) - 1) % 5 AS INTEGER) AS fold "
    f"FROM rf WHERE NOT ({TEST_SQL})"))
def q_fold_assign(spark, sf_dir):
    df = SP.split_hash(rf(spark, sf_dir).select("k", "target_flag"), "k", SEED)
    train = stored(df.where("split = 'train'").drop("split"), "keys")
    return SP.assign_folds(train, "k", 5, SEED, stratify="target_flag")


CAPS = [25_000.0, 10_000.0]


@register("run_reports", with_rf(" UNION ALL ".join(
    f"SELECT '{c}' AS cap, reason, job, {r4('avg(target_flag)')} AS default_mean, "
    f"{r4(f'avg(CASE WHEN target_amt > {c} THEN {c} ELSE target_amt END)')} AS loss_mean, "
    f"{r4(f'avg(target_flag) * avg(CASE WHEN target_amt > {c} THEN {c} ELSE target_amt END)')} AS expected_loss "
    "FROM rf WHERE reason IS NOT NULL AND job IS NOT NULL GROUP BY reason, job" for c in CAPS)))
def q_run_reports(spark, sf_dir):
    """SNK2: the loss reports of runs with two caps in one folder, the first run written
    again, read side by side."""
    df, root = rf_table(spark, sf_dir, *RS.targets, *RS.categorical), f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    for cap in [*CAPS, CAPS[0]]:
        write_run({"expected_loss": P.expected_loss(PR.cap_amount(df, "target_amt", cap), RS)}, root, "profile", {"cap": cap})
    return rounded(read_runs(spark, root, "expected_loss", ["cap"]).drop("run_id"))


def _minmax_sql() -> str:
    mm = ("mm AS (SELECT " + ", ".join(
        f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in FEATURES)
        + f" FROM prep WHERE NOT ({TEST_SQL}))")
    cols = []
    for c in FEATURES:
        cols.append(f"{r4(f'CASE WHEN mx_{c} = mn_{c} THEN {c} - mn_{c} ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END')} AS {c}")
    return with_rf(f"SELECT k, {', '.join(cols)} FROM prep, mm", *_prep_ctes(), mm)


@register("minmax_scale", _minmax_sql())
def q_minmax_scale(spark, sf_dir):
    prep, out = prepared(spark, sf_dir)
    feats = prep.feature_cols
    out = SP.split_hash(out, "k", SEED)
    scaler = PR.fit_minmax(out.where("split = 'train'"), feats)
    return rounded(scaler.transform(out.select("k", *feats)))


@register("target_mean_by_split", with_rf(
    f"SELECT CASE WHEN {TEST_SQL} THEN 'test' ELSE 'train' END AS split, "
    f"{r4('avg(target_amt)')} AS target_mean, count(target_amt) AS n "
    "FROM prep WHERE target_amt IS NOT NULL GROUP BY 1", *_prep_ctes()))
def q_target_mean_by_split(spark, sf_dir):
    _, out = prepared(spark, sf_dir)
    loss = SP.split_hash(SP.loss_population(out, "target_amt"), "k", SEED)
    return rounded(P.target_mean_by_split(loss, "target_amt"))


@register("split_counts", with_rf(
    f"SELECT CASE WHEN {TEST_SQL} THEN 'test' ELSE 'train' END AS split, count(*) AS rows, "
    f"{len(FEATURES)} AS cols FROM rf GROUP BY 1"))
def q_split_counts(spark, sf_dir):
    prep, out = prepared(spark, sf_dir)
    return P.split_counts(SP.split_hash(out, "k", SEED), prep.feature_cols)
