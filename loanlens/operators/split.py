"""PRE7 / PRE8 / TUN4: populations, train-test splits and CV folds.

All assignments are functions of the row key, so they do not depend on
partitioning, file layout or re-execution after a lost executor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash counted in one pass of the exact split, and of a fold's rank bucket.
SELECT_DIGITS, RANK_DIGITS = 3, 4


def key_hash(key: str, seed) -> Column:
    """md5 of ``seed || key`` as 32 hex characters."""
    return F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))


def hash_threshold(fraction: float) -> str:
    """4-hex-digit cut so that a uniform md5 prefix falls below it with
    probability ``fraction`` (0.2 gives '3333')."""
    return format(int(fraction * 65536), "04x")


def loss_population(df: DataFrame, amount: str) -> DataFrame:
    """PRE7: rows that carry a loss amount (the regression population)."""
    return df.where(F.col(amount).isNotNull())


def split_hash(df: DataFrame, key: str, seed=1, test_fraction: float = 0.2,
               col: str = "split") -> DataFrame:
    """PRE8 default: row-local split, ``test`` when the md5 prefix is below
    the cut. No shuffle; stable under any layout."""
    test = F.substring(key_hash(key, seed), 1, 4) < F.lit(hash_threshold(test_fraction))
    return df.withColumn(col, F.when(test, "test").otherwise("train"))


def _selected_hash(df: DataFrame, h: Column, n_test, digits: int = SELECT_DIGITS) -> str | None:
    """The hash of rank ``n_test(rows)`` in ascending order, or a prefix of it that
    ends the same rows; null when no row is wanted.

    Radix selection: each pass counts the rows by the next ``digits`` hex digits
    (combined map-side, at most 16 ** digits rows reach the driver) and keeps the one
    bucket that holds the rank, until a bucket ends on it.
    """
    hashes = df.select(h.alias("h"))
    prefix, wanted = "", None
    while True:
        size = len(prefix) + digits
        counts = sorted(hashes.where(F.col("h").startswith(prefix)).groupBy(
            F.substring("h", 1, size).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        if wanted is None:
            wanted = n_test(sum(r["n"] for r in counts))
            if wanted <= 0:
                return None
        for r in counts:
            if r["n"] >= wanted:
                break
            wanted -= r["n"]
        if r["n"] == wanted or len(r["b"]) < size or size >= 32:
            return r["b"]
        prefix = r["b"]


def split_exact(df: DataFrame, key: str, seed=1, test_fraction: float = 0.2,
                col: str = "split") -> DataFrame:
    """PRE8 exact-count mode: the ceil(f * n) rows with the smallest
    md5(seed || key) form the test set (scikit-learn's test size).

    Only the hash of the last test row is looked for, by radix selection over the
    key column; the split itself is then row-local, so no row is shuffled or sorted.
    ``df`` is scanned about log(n) / log(4096) times for its key: pass a table. Rows
    that share a key stay together, all of them in the test set if one is; a null key
    comes before all others.
    """
    h = F.coalesce(key_hash(key, seed), F.lit(""))
    # guard against float noise in f * n (0.2 * 5960 = 1192.0000000000002)
    cut = _selected_hash(df, h, lambda n: math.ceil(round(n * float(test_fraction), 9)))
    test = F.lit(False) if cut is None else F.substring(h, 1, max(len(cut), 1)) <= F.lit(cut)
    return df.withColumn(col, F.when(test, "test").otherwise("train"))


def assign_folds(df: DataFrame, key: str, k: int = 5, seed=1, stratify: str | None = None,
                 col: str = "fold", digits: int = RANK_DIGITS) -> DataFrame:
    """TUN4: fold numbers 0..k-1.

    Stratified (classifier): rows of each class are ranked by md5 and dealt
    round-robin, so every fold gets the class ratio. A row's rank is the number of its
    class's rows in lower hash buckets (the first ``digits`` hex digits; one count,
    combined map-side) plus its place inside its bucket. md5 spreads a class evenly
    over 16 ** digits buckets, so one exchange by (class, bucket) has no hot task,
    however large a class is. A null class is a class of its own.
    Plain (regressor): a row-local md5 bucket.
    """
    h = key_hash(key, f"fold{seed}")
    if stratify is None:
        bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
        return df.withColumn(col, F.pmod(bucket, F.lit(k)).cast("int"))
    h = F.coalesce(h, F.lit(""))
    counts = df.groupBy(stratify, F.substring(h, 1, digits).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    # at most 16 ** digits rows of a class meet in this window
    lower = Window.partitionBy(stratify).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(stratify, "_b", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_o"))
    # the offset travels as the first row of its bucket (null hash), so that rows cross one exchange and no join
    x = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits)).unionByName(offsets, allowMissingColumns=True)
    inside = Window.partitionBy(stratify, "_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(inside) - 2 + F.max("_o").over(inside)
    ranked = x.withColumn("_r", rank).where(F.col("_h").isNotNull())
    return ranked.select(*df.columns, F.pmod(F.col("_r"), F.lit(k)).cast("int").alias(col))
