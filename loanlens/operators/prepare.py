"""Feature preparation (PRE1-PRE6, PRE9, PRE10) as fit / transform pairs.

``fit`` runs a few aggregates and keeps their small results (null columns,
group medians, category levels, min / max); ``transform`` is then a pure
projection plus one join to the median table, with an output schema fixed by
the fitted state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskSchema
from .joins import null_safe_join
from .prefix import global_rank
from .profile import describe, group_medians, head, null_counts

UNKNOWN = "Unknown"


def fill_unknown(df: DataFrame, s: RiskSchema) -> DataFrame:
    """PRE1: missing category becomes ``"Unknown"``."""
    return df.fillna({c: UNKNOWN for c in s.categorical})


def cap_amount(df: DataFrame, col: str, cap: float) -> DataFrame:
    """PRE5: cap at ``cap``; null stays null (``least`` would turn it into the cap)."""
    c = F.col(col)
    return df.withColumn(col, F.when(c > F.lit(cap), F.lit(cap).cast(
        df.schema[col].dataType)).otherwise(c))


@dataclass
class Imputer:
    """PRE2 + PRE3 fitted state: columns with nulls and their group medians."""

    schema: RiskSchema
    null_cols: list[str]
    medians: DataFrame           # categorical..., one median column per null column

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.schema
        cats = list(s.categorical)
        filled = fill_unknown(df, s)
        if not self.null_cols:
            return filled
        med = self.medians.select(*cats, *[F.col(c).alias(f"_med_{c}") for c in self.null_cols])
        # no hint: the measured size decides between broadcast and shuffle
        joined = null_safe_join(filled, med, cats, "left")
        keep = [c for c in df.columns if c not in self.null_cols]
        added = []
        for c in self.null_cols:
            added += [F.col(c).isNull().cast("int").alias(f"M_{c}"),
                      F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")).alias(f"IMP_{c}")]
        return joined.select(*keep, *added)


def fit_scan(df: DataFrame, s: RiskSchema) -> tuple[list[str], dict[str, list[str]]]:
    """Features with a null and the sorted levels of every category (``Unknown``
    for null), in one aggregate. The levels become the output's columns, so all
    of them are read; a category too wide for columns goes through
    ``encode_levels`` instead."""
    feats = list(s.features)
    row = df.select(
            *[F.col(c).isNull().alias(f"n{i}") for i, c in enumerate(feats)],
            *[F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(f"l{i}") for i, c in enumerate(s.categorical)]).agg(
            *[F.max(f"n{i}").alias(f"n{i}") for i in range(len(feats))],
            *[F.collect_set(f"l{i}").alias(f"l{i}") for i in range(len(s.categorical))]).first()
    return ([c for i, c in enumerate(feats) if row[f"n{i}"]],
            {c: sorted(row[f"l{i}"]) for i, c in enumerate(s.categorical)})


def imputer_of(df: DataFrame, s: RiskSchema, null_cols: list[str], method: str) -> Imputer:
    med = group_medians(fill_unknown(df, s), list(s.categorical), null_cols, method=method) if null_cols else None
    return Imputer(s, null_cols, med)


def fit_imputer(df: DataFrame, s: RiskSchema, method: str = "distributed") -> Imputer:
    """Columns with at least one null (targets skipped) and their medians per
    category group, the groups formed after filling ``Unknown``."""
    return imputer_of(df, s, fit_scan(df, s)[0], method)


@dataclass
class DummyEncoder:
    """PRE4 fitted state: sorted levels per category (the last is dropped)."""

    levels: dict[str, list[str]]

    def columns(self) -> list[str]:
        return [f"z_{c}_{lv}" for c, lvs in self.levels.items() for lv in lvs[:-1]]

    def transform(self, df: DataFrame) -> DataFrame:
        out = [F.col(c) for c in df.columns if c not in self.levels]
        for c, lvs in self.levels.items():
            out += [(F.col(c) == F.lit(lv)).cast("int").alias(f"z_{c}_{lv}") for lv in lvs[:-1]]
        return df.select(*out)


def fit_dummies(df: DataFrame, s: RiskSchema) -> DummyEncoder:
    """Distinct levels of every category in one aggregate, sorted by string order."""
    return DummyEncoder(fit_scan(df, s)[1])


def encode_levels(df: DataFrame, col: str, out: str) -> DataFrame:
    """PRE4 for a category too wide for columns: the levels stay a table (distinct,
    ranked in string order by DSP1) and each row gets ``out``, the 0-based place of its
    level, for a one-hot vector or an embedding. The place of the last level is the
    one that dummies drop."""
    levels = global_rank(df.select(F.coalesce(F.col(col), F.lit(UNKNOWN)).alias("_level")).distinct(), ["_level"])
    places = levels.select("_level", (F.col("rank") - 1).alias(out))
    return (df.withColumn("_level", F.coalesce(F.col(col), F.lit(UNKNOWN)))
            .join(places, "_level", "left").drop("_level"))


@dataclass
class Preparation:
    """PRE6: the fitted chain impute -> dummies -> cap."""

    schema: RiskSchema
    imputer: Imputer
    dummies: DummyEncoder
    cap: float
    reports: dict = field(default_factory=dict)

    @property
    def feature_cols(self) -> list[str]:
        s = self.schema
        plain = [c for c in s.features if c not in self.imputer.null_cols]
        pairs = [x for c in self.imputer.null_cols for x in (f"M_{c}", f"IMP_{c}")]
        return plain + pairs + self.dummies.columns()

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.schema
        out = self.dummies.transform(self.imputer.transform(df))
        out = cap_amount(out, s.amount, self.cap)
        return out.select(s.key, s.flag, s.amount, *self.feature_cols)


def fit_preparation(df: DataFrame, s: RiskSchema, cap: float = 25_000.0,
                    fit_rows: DataFrame | None = None, reports: bool = False,
                    method: str = "distributed") -> Preparation:
    """Fit PRE1-PRE5 on ``fit_rows`` (default: all rows, as the reference
    does; pass the training split for the leak-free PRE10)."""
    base = fit_rows if fit_rows is not None else df
    null_cols, levels = fit_scan(base, s)
    imp, dum = imputer_of(base, s, null_cols, method), DummyEncoder(levels)
    prep = Preparation(s, imp, dum, cap)
    if reports:
        imputed = imp.transform(df)
        prep.reports = {
            "null_counts_before": null_counts(df),
            "group_medians": group_medians(df, list(s.categorical), list(s.numeric), method=method),
            "null_counts_after": null_counts(imputed),
            "amount_before_cap": describe(df, [s.amount], method=method),
            "amount_after_cap": describe(cap_amount(df, s.amount, cap), [s.amount], method=method),
            "first_rows_before": head(df, s.key), "first_rows_after": head(imputed, s.key),
        }
    return prep


@dataclass
class MinMaxScaler:
    """PRE9: (x - min) / (max - min) with the min and max of the fit rows;
    a constant column maps to 0; no clipping outside the fitted range."""

    ranges: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.ranges:
                lo, hi = self.ranges[c]
                span = hi - lo
                # a constant column is divided by 1, as scikit-learn does
                e = (F.col(c) - F.lit(lo)) / F.lit(span) if span else F.col(c) - F.lit(lo)
                out.append(e.cast("double").alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)


def fit_minmax(df: DataFrame, cols: list[str]) -> MinMaxScaler:
    row = df.agg(*[F.min(c).cast("double").alias(f"{c}__mn") for c in cols],
                 *[F.max(c).cast("double").alias(f"{c}__mx") for c in cols]).first()
    return MinMaxScaler({c: (row[f"{c}__mn"], row[f"{c}__mx"]) for c in cols})
