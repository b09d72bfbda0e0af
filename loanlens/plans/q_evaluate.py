"""Evaluation and comparison queries on rule-based scores (EVA1-EVA5,
EVA9-EVA11, SET1, SET2, FLT4, FLT5, ORD1).

A fixed rule stands in for a fitted model so that both engines can compute
the same scores: the evaluation operators are what is under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import evaluate as EV
from ..operators import split as SP
from .oracle import r4, union_all, with_rf
from .registry import register, rf, round_half_away, rounded

TEST_SQL = "substr(md5('1' || k), 1, 4) < '3333'"
# The rule-based scores (same text in both engines).
RULES = {
    "rule_a": "0.5 * CAST(acctbal IS NULL AS INTEGER) + 0.01 * coalesce(quantity, 25.0) + 2 * discount",
    "rule_b": "0.01 * coalesce(quantity, 25.0) + 2 * discount",
    "rule_c": "0.5 * CAST(acctbal IS NULL AS INTEGER) + 2 * discount",
}
AMOUNT_RULES = {"amt_a": "0.3 * loan", "amt_b": "0.25 * loan + 1000.0"}


def _rule_col(name: str):
    a = F.col("acctbal").isNull().cast("int")
    q = F.coalesce(F.col("quantity"), F.lit(25.0))
    d = F.col("discount")
    e = {"rule_a": F.lit(0.5) * a + F.lit(0.01) * q + F.lit(2) * d,
         "rule_b": F.lit(0.01) * q + F.lit(2) * d,
         "rule_c": F.lit(0.5) * a + F.lit(2) * d}[name]
    return round_half_away(e, 6)


def _amount_col(name: str):
    return {"amt_a": F.lit(0.3) * F.col("loan"),
            "amt_b": F.lit(0.25) * F.col("loan") + F.lit(1000.0)}[name]


def scored(spark, sf_dir, rule="rule_a"):
    df = SP.split_hash(rf(spark, sf_dir), "k", 1)
    return df.select("k", "split", F.col("target_flag").alias("y"), _rule_col(rule).alias("s"))


def _scored_sql(rule="rule_a") -> str:
    return (f"s AS (SELECT k, CASE WHEN {TEST_SQL} THEN 'test' ELSE 'train' END AS split, "
            f"target_flag AS y, round({RULES[rule]}, 6) AS s FROM rf)")


def _roc_sql(rule="rule_a", src="s") -> str:
    g = f"SELECT split, s, sum(y) AS p, sum(1 - y) AS n FROM {src} GROUP BY split, s"
    c = ("SELECT *, row_number() OVER (PARTITION BY split ORDER BY s DESC) AS idx, "
         "count(*) OVER (PARTITION BY split) AS m, "
         "sum(p) OVER (PARTITION BY split ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, "
         "sum(n) OVER (PARTITION BY split ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp, "
         "sum(p) OVER (PARTITION BY split) AS tot_p, sum(n) OVER (PARTITION BY split) AS tot_n, "
         "lead(p) OVER (PARTITION BY split ORDER BY s DESC) AS p_next, "
         "lead(n) OVER (PARTITION BY split ORDER BY s DESC) AS n_next "
         f"FROM ({g}) g")
    return (f"SELECT split, CAST(idx AS BIGINT) AS idx, CAST(s AS DOUBLE) AS threshold, "
            f"fp / tot_n AS fpr, tp / tot_p AS tpr FROM ({c}) c "
            "WHERE idx = 1 OR idx = m OR m <= 2 OR p_next <> p OR n_next <> n "
            f"UNION ALL SELECT DISTINCT split, CAST(0 AS BIGINT) AS idx, CAST(NULL AS DOUBLE) AS threshold, "
            f"0.0 AS fpr, 0.0 AS tpr FROM {src}")


def _auc_sql(src="s") -> str:
    g = f"SELECT split, s, sum(y) AS p, sum(1 - y) AS n FROM {src} GROUP BY split, s"
    c = ("SELECT *, sum(p) OVER (PARTITION BY split ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp "
         f"FROM ({g}) g")
    return f"SELECT split, sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)) AS auc FROM ({c}) c GROUP BY split"


@register("roc_points", with_rf(
    "SELECT split, idx, " + ", ".join(f"{r4(c, 6)} AS {c}" for c in ("threshold", "fpr", "tpr"))
    + f" FROM ({_roc_sql()}) r", _scored_sql()))
def q_roc_points(spark, sf_dir):
    return rounded(EV.roc_curve(scored(spark, sf_dir), "y", "s", by=["split"]), 6)


@register("roc_points_all", with_rf(
    "SELECT split, idx, " + ", ".join(f"{r4(c, 6)} AS {c}" for c in ("threshold", "fpr", "tpr"))
    + f" FROM ({_roc_sql().replace('WHERE idx = 1 OR idx = m OR m <= 2 OR p_next <> p OR n_next <> n ', '')}) r",
    _scored_sql()))
def q_roc_points_all(spark, sf_dir):
    """EVA2 without ``drop_intermediate``: one point per distinct score."""
    return rounded(EV.roc_curve(scored(spark, sf_dir), "y", "s", by=["split"],
                                drop_intermediate=False), 6)


@register("auc", with_rf(f"SELECT split, {r4('auc', 6)} AS auc FROM ({_auc_sql()}) a", _scored_sql()))
def q_auc(spark, sf_dir):
    return rounded(EV.auc(scored(spark, sf_dir), "y", "s", by=["split"]), 6)


@register("accuracy", with_rf(
    f"SELECT split, {r4('avg(CAST(CAST(s > 0.5 AS INTEGER) = y AS INTEGER))', 6)} AS accuracy, "
    "count(*) AS n FROM s GROUP BY split", _scored_sql()))
def q_accuracy(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("pred", (F.col("s") > 0.5).cast("int"))
    return rounded(EV.accuracy(df, "y", "pred", by=["split"]), 6)


def _rmse_sql(rule="amt_a") -> str:
    return (f"SELECT CASE WHEN {TEST_SQL} THEN 'test' ELSE 'train' END AS split, "
            f"{r4(f'sqrt(avg((target_amt - ({AMOUNT_RULES[rule]})) * (target_amt - ({AMOUNT_RULES[rule]}))))')} AS rmse, "
            f"{r4('avg(target_amt)')} AS target_mean, count(*) AS n, "
            f"{r4(f'sqrt(avg((target_amt - ({AMOUNT_RULES[rule]})) * (target_amt - ({AMOUNT_RULES[rule]})))) / avg(target_amt)', 6)} AS error_ratio "
            "FROM rf WHERE target_amt IS NOT NULL GROUP BY 1")


def _amount_scored(spark, sf_dir, rule="amt_a"):
    df = SP.split_hash(SP.loss_population(rf(spark, sf_dir), "target_amt"), "k", 1)
    return df.withColumn("pred", _amount_col(rule))


@register("rmse", with_rf(_rmse_sql()))
def q_rmse(spark, sf_dir):
    out = EV.rmse(_amount_scored(spark, sf_dir), "target_amt", "pred", by=["split"])
    return rounded(out.select("split", "rmse", "target_mean", "n"),
                   4).join(rounded(out.select("split", "error_ratio"), 6), "split")


@register("error_ratio", with_rf(
    f"SELECT split, error_ratio FROM ({_rmse_sql()}) r"))
def q_error_ratio(spark, sf_dir):
    out = EV.rmse(_amount_scored(spark, sf_dir), "target_amt", "pred", by=["split"])
    return rounded(out.select("split", "error_ratio"), 6)


# ---------------------------------------------------------------- comparison

def _labeled_roc(spark, sf_dir, rule):
    scan = EV.score_scan(EV.score_counts(scored(spark, sf_dir, rule), "y", "s", ["split"]), "s", ["split"])
    pts = EV.roc_curve(None, "y", "s", by=["split"], scan=scan)
    aucs = EV.auc(None, "y", "s", by=["split"], scan=scan)
    return C.label_roc(pts, aucs, rule)


def _labeled_roc_sql(rule) -> str:
    src = f"s_{rule}"
    return (f"SELECT '{rule}' AS model, r.split, idx, threshold, fpr, tpr, a.auc, "
            "printf('AUC %s: %.3f', CASE WHEN r.split = 'test' THEN 'Test' ELSE 'Train' END, a.auc) AS label, "
            f"printf('%s AUC: %.3f', '{rule}', a.auc) AS model_auc "
            f"FROM ({_roc_sql(rule, src)}) r JOIN ({_auc_sql(src)}) a ON r.split = a.split")


def _rule_ctes(rules) -> list[str]:
    return [_scored_sql(r).replace("s AS (", f"s_{r} AS (", 1) for r in rules]


def _round_roc(sql: str) -> str:
    return ("SELECT model, split, idx, label, model_auc, "
            + ", ".join(f"{r4(c, 6)} AS {c}" for c in ("threshold", "fpr", "tpr", "auc"))
            + f" FROM ({sql}) x")


@register("roc_union", with_rf(_round_roc(union_all([_labeled_roc_sql(r) for r in RULES])),
                               *_rule_ctes(RULES)))
def q_roc_union(spark, sf_dir):
    """SET1 / EVA9: labelled ROC points of several scorers stacked."""
    return rounded(C.union_all([_labeled_roc(spark, sf_dir, r) for r in RULES]), 6)


@register("filter_contains", with_rf(
    _round_roc(f"SELECT * FROM ({union_all([_labeled_roc_sql(r) for r in RULES])}) u "
               "WHERE contains(label, 'Test')"), *_rule_ctes(RULES)))
def q_filter_contains(spark, sf_dir):
    """FLT4: keep the test curves by their label text."""
    u = C.union_all([_labeled_roc(spark, sf_dir, r) for r in RULES])
    return rounded(C.contains(u, "label", "Test"), 6)


def _auc_table(spark, sf_dir):
    frames = [EV.auc(scored(spark, sf_dir, r), "y", "s", by=["split"])
              .where("split = 'test'").select(F.lit(r).alias("model"), "auc") for r in RULES]
    return C.union_all(frames)


@register("best_by_max", with_rf(
    f"SELECT model, {r4('auc', 6)} AS auc FROM ("
    + union_all([f"SELECT '{r}' AS model, auc FROM ({_auc_sql(f's_{r}')}) a WHERE split = 'test'"
                 for r in RULES])
    + ") t QUALIFY auc = max(auc) OVER ()", *_rule_ctes(RULES)))
def q_best_by_max(spark, sf_dir):
    """FLT5 / EVA10: the best model(s) by test AUC, ties kept."""
    return rounded(C.keep_max(_auc_table(spark, sf_dir), "auc"), 6)


def _rmse_frames(spark, sf_dir):
    frames = []
    for r in AMOUNT_RULES:
        out = EV.rmse(_amount_scored(spark, sf_dir, r), "target_amt", "pred", by=["split"])
        frames.append(out.select(F.lit(r).alias("model"), "split", "rmse"))
    return frames


@register("rmse_ranking", with_rf(
    f"SELECT model, split, {r4('rmse')} AS rmse FROM ("
    + union_all([f"SELECT '{r}' AS model, split, rmse FROM ({_rmse_sql(r)}) x" for r in AMOUNT_RULES])
    + ") t ORDER BY rmse"))
def q_rmse_ranking(spark, sf_dir):
    """ORD1 / EVA11: RMSE of every model and split, ascending."""
    return rounded(C.rank_rmse(C.union_all(_rmse_frames(spark, sf_dir))))


@register("union_missing_cols", with_rf(
    f"SELECT model, split, {r4('rmse')} AS rmse FROM ("
    f"SELECT 'amt_a' AS model, split, rmse FROM ({_rmse_sql('amt_a')}) x UNION ALL "
    f"SELECT NULL AS model, split, rmse FROM ({_rmse_sql('amt_b')}) y) t"))
def q_union_missing_cols(spark, sf_dir):
    """SET2: one table carries a model column, the other does not."""
    a, b = _rmse_frames(spark, sf_dir)
    return rounded(C.union_missing([a, b.drop("model")]))
