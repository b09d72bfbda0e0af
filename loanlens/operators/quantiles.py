"""Exact and approximate quantiles with linear interpolation (pandas
``quantile``, DuckDB ``quantile_cont``).

Three methods, chosen by the caller and never by the input's size:

* ``exact``: Spark's ``percentile`` aggregate. Partial aggregation keeps a map
  of distinct values with counts per group, so memory grows with the number
  of distinct values of the largest group.
* ``distributed`` (default): exact and bounded per task, by radix selection.
  Values are counted in buckets of their leading bits (sign, exponent, first
  bits of the fraction) per group and column, combined map-side, so that only
  counts are shuffled. The buckets that hold a wanted rank are kept, and the next
  pass counts only the values inside them, until each has one value. A hot group
  adds no more rows to a task than any other, and no value is sorted against all.
* ``approx``: ``percentile_approx`` (GK sketch) with a chosen accuracy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .joins import null_safe_join

#: Buckets of an octave in the first pass, parts of a kept bucket in the next ones, and the
#: rows of a kept bucket up to which its values are ranked one by one.
OCTAVE, PARTS, RANKED = 64, 4096, 16_384
#: Above the largest binary exponent of a double, below the smallest.
EXPONENTS = 1025.0, 1075


def quantile_exprs(col: str, probs: list[float], method: str = "exact",
                   accuracy: int = 100_000):
    """Per-column aggregate expressions (methods ``exact`` / ``approx``)."""
    c = F.col(col).cast("double")
    if method == "approx":
        arr = F.percentile_approx(c, list(probs), accuracy)
    else:
        arr = F.percentile(c, F.array(*[F.lit(float(p)) for p in probs]))
    return [arr[i].cast("double") for i in range(len(probs))]


def _leading_bits(x: Column) -> Column:
    """A number that grows with the double ``x``: about its sign, exponent and the first
    bits of its fraction. Zero has a bucket of its own, infinities and NaN too."""
    top, bottom = EXPONENTS
    place = F.floor(F.least(F.log2(F.abs(x)), F.lit(top)) * OCTAVE) + bottom * OCTAVE
    return F.when(F.isnan(x), F.lit(1 << 40)).when(x > 0, place).when(x < 0, -place).when(x == 0, F.lit(0))


def _ends(counts: DataFrame, within: list, order: str) -> DataFrame:
    """Ranks covered by every bucket, ``[_start, _end)`` from 0, among the buckets of ``within``."""
    until = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("_end", F.sum("_n").over(until)).withColumn("_start", F.col("_end") - F.col("_n"))


def _first_pass(long: DataFrame, group: list[str], probs: list[float], moments: bool) -> DataFrame:
    """One row per group and wanted rank (``_i``): the bucket's smallest and largest value,
    its rows ``_n`` and the rank's place in it; all null for a group without values."""
    x = F.col("_x")
    aggs = [F.count(x).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")]
    if moments:
        aggs += [F.avg(x).alias("_avg"), F.var_pop(x).alias("_var")]
    counts = _ends(long.groupBy(*group, _leading_bits(x).alias("_b")).agg(*aggs), group, "_b")
    whole = Window.partitionBy(*group)
    counts = counts.withColumn("_total", F.sum("_n").over(whole))
    kept, sums = ["_total"], [F.max("_total").alias("_total")]
    if moments:
        # moments of the buckets put together, as no second scan of the values is needed
        n, mean = F.col("_n"), F.col("_mean")
        counts = counts.withColumn("_mean", F.sum(n * F.col("_avg")).over(whole) / F.nullif(F.col("_total"), F.lit(0)))
        square = F.sum(n * F.col("_var") + n * (F.col("_avg") - mean) * (F.col("_avg") - mean))
        kept += ["_mean", "_square", "_min", "_max"]
        sums += [F.max("_mean").alias("_mean"), square.alias("_square"), F.min("_lo").alias("_min"), F.max("_hi").alias("_max")]
    wanted = []
    for p in probs:
        for end in (F.floor, F.ceil):
            rank = end((F.col("_total") - 1) * F.lit(float(p)))
            bucket = F.struct("_lo", "_hi", "_n", (rank - F.col("_start")).alias("_at"))
            wanted.append(F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), bucket)))
    one = counts.groupBy(*group).agg(*sums, F.array(*wanted).alias("_wanted"))
    return one.select(*group, *kept, F.posexplode("_wanted").alias("_i", "_w")).select(*group, *kept, "_i", "_w.*")


def _next_pass(long: DataFrame, group: list[str], wanted: DataFrame, parts: int, ranked: int) -> DataFrame:
    """``wanted`` ranks moved to finer buckets: its buckets cut into ``parts`` of equal width, or
    into their values where they hold at most ``ranked`` rows."""
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col("_x")
    kept = wanted.select(*group, "_lo", "_hi", "_n").distinct()
    inside = null_safe_join(long, kept, group).where((x >= lo) & (x <= hi))
    part = F.least(F.floor((x - lo) / (hi - lo) * parts), F.lit(parts - 1)).cast("double")
    bucket = F.when(F.col("_n") <= ranked, x).otherwise(part)
    counts = inside.groupBy(*group, "_lo", "_hi", bucket.alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(x).alias("_lo2"), F.max(x).alias("_hi2"))
    fine = _ends(counts, [*group, "_lo", "_hi"], "_b").drop("_b")
    found = null_safe_join(wanted.drop("_n"), fine, [*group, "_lo", "_hi"]).where(
        (F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_end")))
    return found.withColumns({"_lo": F.col("_lo2"), "_hi": F.col("_hi2"), "_at": F.col("_at") - F.col("_start")}).select(
        *[c for c in wanted.columns if c != "_n"], "_n")


def long_quantiles(long: DataFrame, group: list[str], value: str, probs: list[float],
                   names: list[str], moments: bool = False, parts: int = PARTS,
                   ranked: int = RANKED) -> DataFrame:
    """Distributed exact quantiles of ``value`` per ``group`` of a long frame.

    Returns one row per group with one column per probability; a group whose
    values are all null is kept with null quantiles. ``moments`` adds count, mean, std
    (n-1), min and max from the first pass. NaN is above all numbers.

    Usually two scans of ``long``; three where a kept bucket holds more than ``ranked``
    rows of several values, and never more than seven, as each pass takes 12 bits off
    the 46 that the first leaves. Kept between the scans is one row per group and wanted
    rank, written to the shared folder. ``long`` is read again, so it must not be random.
    """
    group = list(group)
    long = long.select(*group, F.col(value).cast("double").alias("_x"))
    state = stored(_first_pass(long, group, probs, moments), "quantiles")
    settled = F.col("_lo").eqNullSafe(F.col("_hi"))
    while not state.where(~settled).isEmpty():
        moved = _next_pass(long, group, state.where(~settled), parts, ranked)
        state = stored(state.where(settled).unionByName(moved), "quantiles")

    def at(i):
        return F.max(F.when(F.col("_i") == i, F.col("_lo")))

    aggs = [F.max("_total").alias("_total")]
    for j, name in enumerate(names):
        aggs += [at(2 * j).alias(f"_lo_{name}"), at(2 * j + 1).alias(f"_hi_{name}")]
    extra = []
    if moments:
        n = F.col("_total")
        aggs += [F.max(c).alias(c) for c in ("_mean", "_square", "_min", "_max")]
        extra = [n.alias("count"), F.col("_mean").alias("mean"),
                 F.when(n > 1, F.sqrt(F.col("_square") / (n - 1))).alias("std"),
                 F.col("_min").alias("min"), F.col("_max").alias("max")]
    outs = []
    for p, name in zip(probs, names):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi, fr = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), pos - F.floor(pos)
        outs.append(F.when(fr == 0, lo).otherwise((1 - fr) * lo + fr * hi).alias(name))
    return state.groupBy(*group).agg(*aggs).select(*group, *extra, *outs)


def grouped_quantiles(df: DataFrame, group: list[str], cols: list[str], probs: list[float],
                      names: list[str], method: str = "distributed", accuracy: int = 100_000,
                      moments: bool = False) -> DataFrame:
    """Quantiles of each column of ``cols`` per ``group``, in long form:
    ``group..., column, <name per prob>``; ``moments`` (distributed only) as in ``long_quantiles``."""
    group = list(group)
    if method == "distributed":
        long = df.select(*group, F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
            for c in cols])).alias("_kv")).select(*group, "_kv.column", "_kv.value")
        return long_quantiles(long, group + ["column"], "value", probs, names, moments)
    aggs = []
    for c in cols:
        for e, name in zip(quantile_exprs(c, probs, method, accuracy), names):
            aggs.append(e.alias(f"{c}__q__{name}"))
    wide = df.groupBy(*group).agg(*aggs)
    from ..functions.stats import stack_expr
    items = [(c, [f"{c}__q__{n}" for n in names]) for c in cols]
    return wide.select(*group, stack_expr(items, ["column", *names]))
