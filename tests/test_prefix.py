"""DSP1: the range-partitioned prefix sum equals a window sum, skew and
null groups included."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loanlens.operators.prefix import global_rank, prefix_sums


def test_prefix_matches_window(spark):
    # one hot group holds most rows; one group key is null
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 == 7, F.lit(None))
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("g"),
        F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = prefix_sums(df, ["o"], ["v"], group=["g"], partitions=16)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.sum("v").over(w)).withColumn(
        "tot", F.sum("v").over(Window.partitionBy("g")))
    j = got.join(ref, on=["o"])
    bad = j.where((F.col("v_cum") != F.col("ref")) | (F.col("v_total") != F.col("tot"))).count()
    assert got.count() == 20000 and bad == 0


def test_descending_and_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("s"))
    r = global_rank(df, ["s"], descending=True, partitions=7)
    rows = {x["s"]: x["rank"] for x in r.collect()}
    assert rows[999] == 1 and rows[0] == 1000
    assert sorted(rows.values()) == list(range(1, 1001))


def test_rows_never_in_single_partition_window(spark):
    """Only the per-partition totals (one row per range partition) meet in a
    single task; the rows themselves are windowed per range partition."""
    df = spark.range(5000).select(F.col("id").alias("o"), F.lit(1).alias("v"))
    out = prefix_sums(df, ["o"], ["v"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the sorted rows are written once (checkpoint) and streamed where they lie: the
    # only exchanges behind it are of totals, one row per range id and group
    assert "hashpartitioning(_pid" in plan
    assert "Scan ExistingRDD" in plan
    # sorts above the rows' stream would be the second exchange's
    stream = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in stream[:stream.index("Scan ExistingRDD")]


def test_hot_group_spreads_over_ranges(spark):
    """The range partitioning DSP1 uses splits a group holding two thirds
    of the rows over many partitions."""
    df = spark.range(50000).select(
        F.when(F.col("id") % 3 == 0, F.lit("cold")).otherwise(F.lit("hot")).alias("g"),
        F.col("id").alias("o"))
    ids = df.repartitionByRange(16, "g", "o").withColumn("_pid", F.spark_partition_id())
    sizes = [r["count"] for r in ids.groupBy("_pid").count().collect()]
    hot_ranges = ids.where("g = 'hot'").select("_pid").distinct().count()
    assert hot_ranges >= 8 and max(sizes) < 50000 / 4


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("partitions", [1, 5])
def test_carry_over_batches_and_partitions(spark, descending, partitions):
    """Sums, totals and next rows against windows, with batches of 7 rows: groups
    inside a batch, over many batches and partitions; null and NaN groups, null values."""
    df = spark.range(400).select(
        F.when(F.col("id") < 200, F.lit(1.5)).when(F.col("id") < 230, F.lit(float("nan")))
        .when(F.col("id") < 260, F.lit(None)).otherwise((F.col("id") % 40).cast("double")).alias("g"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 7 % 401).alias("o"),
        F.col("id").alias("k"), F.when(F.col("id") % 6 > 0, F.col("id") % 5).alias("v"), (F.col("id") / 4).alias("d"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = prefix_sums(df, ["o", "k"], ["v", "d"], group=["g"], descending=descending, partitions=partitions,
                          ahead=["v", "d"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("o", "k")]
    w = Window.partitionBy("g").orderBy(*order)
    v = F.coalesce("v", F.lit(0))
    want = df.select("k", F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("v_cum"),
                     F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("d_cum"),
                     F.sum("v").over(Window.partitionBy("g")).alias("v_total"),
                     F.lead(v).over(w).alias("v_next"), F.lead("d").over(w).alias("d_next")).collect()
    names = ["v_cum", "d_cum", "v_total", "v_next", "d_next"]
    assert {r["k"]: [r[c] for c in names] for r in got} == {r["k"]: [r[c] for c in names] for r in want}


def test_empty_frame(spark):
    out = prefix_sums(spark.range(0).withColumn("g", F.lit("a")), ["id"], ["id"], group=["g"], ahead=["id"])
    assert out.columns == ["id", "g", "id_cum", "id_total", "id_next"] and out.count() == 0
