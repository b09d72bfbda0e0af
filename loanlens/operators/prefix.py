"""DSP1: distributed prefix sums (global running totals) without a
single-task window.

``Window.orderBy`` with no partition moves every row into one task. Here the
rows are range-partitioned and sorted on (group, order) once, so a large group
spreads over many tasks, and stay there: each partition is streamed once, its
running sums kept from batch to batch. Totals per partition and group (at most
``partitions`` rows of a group) give every partition its starting offset, which is
added afterwards; the same small table holds the row that follows a partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint
from .joins import null_safe_join


def _sort_cols(order: list, descending: bool) -> list[Column]:
    out = []
    for o in order:
        c = F.col(o) if isinstance(o, str) else o
        out.append(c.desc() if descending else c.asc())
    return out


def _starts(batch: pa.RecordBatch, group: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """True at rows whose group differs from the row before (``last``: the row before the batch)."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = last is None
    for g in group:
        col = batch.column(g)
        if last is not None:
            col = pa.concat_arrays([last.column(g), col])
        one, two = col[1:], col[:-1]
        differ = pc.fill_null(pc.not_equal(one, two), pc.xor(one.is_null(), two.is_null()))
        if pa.types.is_floating(col.type):        # NaN is one group
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(one), pc.is_nan(two)), False))
        out[len(out) - len(differ):] |= differ.to_numpy(zero_copy_only=False)
    return out


def _running(group: list[str], sums: list[str], ahead: list[str]):
    """Streams a sorted partition: running sums of ``sums`` within each group, and of
    ``ahead`` the value in the next row of the group (null where the partition's part ends)."""
    def run(batches):
        last, carry, held = None, {}, None

        def emit(batch, following, values, is_next):
            # ``following``: per name the values of the next rows, the last one still open
            cols, names = [*batch.columns, *values], [*batch.schema.names, *[f"_l_{x}" for x in sums]]
            for x in ahead:
                nxt, known = following[x]
                if is_next is not None:
                    nxt[-1], known[-1] = is_next[x], True
                cols.append(pa.array(nxt, batch.column(x).type, mask=~known))
                names.append(f"_n_{x}")
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, group, last)
            part = np.cumsum(starts)
            values, plain = [], {}
            for x in dict.fromkeys([*sums, *ahead]):
                plain[x] = pc.fill_null(batch.column(x), 0).to_numpy(zero_copy_only=False)
            for x in sums:
                total = pd.Series(plain[x]).groupby(part).cumsum().to_numpy().copy()
                if not starts[0]:
                    total[part == part[0]] += carry[x]
                carry[x] = total[-1]
                values.append(pa.array(total, pa.float64() if total.dtype.kind == "f" else pa.int64()))
            if held is not None:
                yield emit(*held, None if starts[0] else {x: plain[x][0] for x in ahead})
            following = {x: (np.append(plain[x][1:], 0).astype(plain[x].dtype), np.append(~starts[1:], False))
                         for x in ahead}
            held, last = (batch, following, values), batch.slice(batch.num_rows - 1)
        if held is not None:
            yield emit(*held, None)
    return run


def prefix_sums(df: DataFrame, order: list, sums: list[str], group: list[str] = (),
                descending: bool = False, partitions: int | None = None,
                suffix: str = "_cum", ahead: list[str] = ()) -> DataFrame:
    """Inclusive running sums of ``sums`` along ``order`` within ``group``.

    Rows must be unique on ``group + order`` (aggregate ties first); then the
    result equals ``sum(x) OVER (PARTITION BY group ORDER BY order ROWS
    UNBOUNDED PRECEDING)``, null values counting as 0. Adds ``<x>_cum`` columns and
    the group total ``<x>_total``, and for every name of ``ahead`` (among the
    numeric columns) ``<x>_next``: its value in the group's next row, null at the last.
    Rows are exchanged once. Group columns are atomic values, null a group of its own.
    """
    group, ahead = list(group), list(ahead)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_sort = _sort_cols(order, descending)
    by = [F.col(g).asc() for g in group]
    # Range bounds are sampled per computation, so the sorted rows are written
    # once (reliable checkpoint in the shared folder): the totals and the
    # running sums then read the same partitions, also after a lost executor.
    ranged = reliable_checkpoint(
        df.repartitionByRange(n, *by, *order_sort).sortWithinPartitions(*by, *order_sort)
        .withColumn("_pid", F.spark_partition_id()))

    # per (partition, group) totals and first row: at most n rows per group
    types = {f.name: f.dataType for f in df.schema}
    # a struct is not null where its fields are, so rows with null order values count
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    first = F.max_by if descending else F.min_by
    totals = ranged.groupBy("_pid", *group).agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums], *[first(F.coalesce(x, F.lit(0).cast(types[x])), place).alias(f"_f_{x}") for x in ahead])
    following = Window.partitionBy(*group).orderBy("_pid")
    before = following.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(
        "_pid", *group,
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"{s}_total") for s in sums],
        *[F.lead(f"_f_{x}").over(following).alias(f"_a_{x}") for x in ahead])

    def wide(x):
        return T.DoubleType() if isinstance(types[x], (T.FloatType, T.DoubleType)) else T.LongType()

    schema = T.StructType([*ranged.schema.fields, *[T.StructField(f"_l_{s}", wide(s)) for s in sums],
                           *[T.StructField(f"_n_{x}", types[x]) for x in ahead]])
    # group keys may be null (null groups are kept), so match them null-safely;
    # the offsets side has at most partitions + groups rows
    run = _running(group, list(sums), ahead)
    joined = null_safe_join(ranged.mapInArrow(run, schema), offsets, ["_pid", *group])
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{s}") + F.col(f"_o_{s}")).alias(f"{s}{suffix}") for s in sums],
        *[f"{s}_total" for s in sums],
        *[F.coalesce(f"_n_{x}", f"_a_{x}").alias(f"{x}_next") for x in ahead])


def global_rank(df: DataFrame, order: list, descending: bool = False,
                partitions: int | None = None, name: str = "rank") -> DataFrame:
    """1-based global row number along ``order`` (ties broken by the order
    columns themselves, so include a unique key)."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    out = prefix_sums(ones, order, ["_one"], descending=descending, partitions=partitions)
    return out.withColumnRenamed("_one_cum", name).drop("_one", "_one_total")
