"""Readers: the loan CSV (the reference's only input) and the ``risk_frame``
stand-in derived from the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RiskSchema

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Inner joins of the four tables. Spark takes the narrow lineitem rows through the part join first and meets
# orders already joined to customer, so that lineitem is shuffled twice at most and its widest form never.
JOINS = """{lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey
                        JOIN {customer} c ON o_custkey = c_custkey
                        JOIN {part} p ON l_partkey = p_partkey"""
SPARK_JOINS = """{lineitem} l JOIN {part} p ON l_partkey = p_partkey
      JOIN ({orders} o JOIN {customer} c ON o_custkey = c_custkey) ON l_orderkey = o_orderkey"""

# One SQL text for Spark and DuckDB but for the order of the joins. ``{lineitem}``-style slots are filled with
# DataFrames in Spark and with the plain view names in DuckDB. Missing values
# are injected by stable hashes of the row key, so both engines agree row by row.
RISK_FRAME_SQL = """
SELECT k, target_flag,
       CASE WHEN target_flag = 1 THEN l_extendedprice * 0.25 + o_totalprice * 0.02 END AS target_amt,
       o_totalprice AS loan,
       CASE WHEN substr(md5('quantity' || k), 1, 2) >= '17' THEN l_quantity END AS quantity,
       acctbal,
       CASE WHEN substr(md5('price' || k), 1, 2) >= '05' THEN p_retailprice END AS retailprice,
       CASE WHEN substr(md5('size' || k), 1, 2) >= '1e' THEN CAST(p_size AS DOUBLE) END AS psize,
       l_discount AS discount,
       CASE WHEN substr(md5('reason' || k), 1, 2) >= '0b' THEN l_linestatus END AS reason,
       CASE WHEN substr(md5('job' || k), 1, 2) >= '0c' THEN c_mktsegment END AS job
FROM (
  SELECT b.*, CASE WHEN (l_quantity > 30 AND l_discount > 0.05 AND substr(md5('n1' || k), 1, 2) >= '40')
                     OR (acctbal IS NULL AND substr(md5('n1' || k), 1, 2) < '80')
                     OR substr(md5('n2' || k), 1, 2) < '0d' THEN 1 ELSE 0 END AS target_flag
  FROM (
    SELECT a.*, CASE WHEN substr(md5('bal' || k), 1, 2) >= '36' THEN c_acctbal END AS acctbal
    FROM (
      SELECT l.*, o.o_totalprice, c.c_mktsegment, c.c_acctbal, p.p_retailprice, p.p_size,
             CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
             CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS k
      FROM [joins]) a) b) t
"""

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def risk_frame_sql_duckdb() -> str:
    """The risk_frame text with plain view names (for DuckDB oracles)."""
    return RISK_FRAME_SQL.replace("[joins]", JOINS).format(lineitem="lineitem", orders="orders",
                                 customer="customer", part="part")


def risk_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared loan stand-in: lineitem joined to orders, customer and part.

    Join strategy is left to Catalyst and AQE: the dimension sides are
    broadcast only while their measured size stays under
    ``spark.sql.autoBroadcastJoinThreshold``; beyond it the joins shuffle on
    their keys. Only the eleven needed source columns reach the scans.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_linestatus")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    return spark.sql(RISK_FRAME_SQL.replace("[joins]", SPARK_JOINS), lineitem=li, orders=o, customer=c, part=p)


# ---------------------------------------------------------------- loan CSV

# The texts that pandas reads as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def hmeq_schema() -> T.StructType:
    # The input file's columns in its order.
    s = RiskSchema.hmeq()
    fields = []
    for c in ("TARGET_BAD_FLAG", "TARGET_LOSS_AMT", "LOAN", "MORTDUE", "VALUE", "REASON",
              "JOB", "YOJ", "DEROG", "DELINQ", "CLAGE", "NINQ", "CLNO", "DEBTINC"):
        if c in s.categorical:
            t = T.StringType()
        elif c in ("TARGET_BAD_FLAG", "LOAN"):
            t = T.IntegerType()
        else:
            t = T.DoubleType()
        fields.append(T.StructField(c, t))
    return T.StructType(fields)


def _parsed(field: T.StructField):
    """A CSV text as the field's type: missing tokens become null, a text that is
    no number (or no whole number, for whole-number fields) fails the read."""
    raw = F.col(f"`{field.name}`")
    text = F.when(raw.isin(*NA_TOKENS), None).otherwise(raw)
    if isinstance(field.dataType, T.StringType):
        return text.alias(field.name)
    number = F.expr(f"try_cast(trim(`{field.name}`) AS DOUBLE)")
    whole = isinstance(field.dataType, (T.IntegerType, T.LongType))
    bad = number.isNull() | (number != F.floor(number) if whole else F.lit(False))
    return (F.when(text.isNull(), None)
            .when(bad, F.raise_error(F.concat(F.lit(f"malformed number in {field.name}: "), raw)))
            .otherwise(number).cast(field.dataType).alias(field.name))


def read_loans_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   key: str = "k", chunk: int = 1_000_000) -> DataFrame:
    """SRC1: header CSV with an explicit schema, read as pandas reads it: its
    missing-value tokens become null in every column, whole numbers may be
    written as 1100.0, and a malformed number fails the read.

    The file has no key, so one is derived from the content: a hash of all
    columns plus a duplicate number. Exact duplicates are first collapsed by
    an aggregate (combined map-side); only groups with duplicates are shuffled
    again, their numbers emitted in chunks spread over tasks, so a hot duplicate
    never lands in one task.
    """
    schema = schema or hmeq_schema()
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    df = (spark.read.schema(texts).option("header", True).option("mode", "FAILFAST").csv(path)
          .select([_parsed(f) for f in schema.fields]))
    cols = [f.name for f in schema.fields]
    h = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
                                         for c in cols]), 256)
    grouped = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", h)
    single = grouped.where("_n = 1").withColumn("_d", F.lit(1))
    chunks = grouped.where("_n > 1").withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk).cast("int"))))
    spread = chunks.repartition("_h", "_j")
    many = spread.withColumn(
        "_d", F.explode(F.sequence(F.col("_j") * chunk + 1,
                                   F.least(F.col("_n"), (F.col("_j") + 1) * chunk).cast("int")))).drop("_j")
    out = single.unionByName(many)
    return out.select(F.concat_ws("-", F.col("_h"), F.col("_d").cast("string")).alias(key), *cols)
