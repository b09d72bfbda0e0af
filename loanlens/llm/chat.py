"""Operator 9: chat formatting after cumulative-snapshot collapse (native).

Logs often hold a conversation again after every turn. Each turn gets a rolling
hash of all turns up to it (128 bits: the exclusive or of hashes of position,
role and text). A conversation whose last hash occurs as the hash of an inner turn of
another one is a prefix of it and goes (anti-join); of conversations equal from first to last turn
the smallest conv_id stays. What remains is rendered with the turn marks of a
chat template.

Defined results: turns are ordered by turn (null last), then role and text hash;
rows equal in all four columns are one turn; a null role renders as "unknown", a
null text as empty; rows without conv_id are one conversation of their own. Conversations
of more than ``PART`` turns are rendered in several rows (part 0, 1, ...), so that
no row has to hold an unbounded conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, table

PART = 1000
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _content(*before) -> Column:
    return F.xxhash64(*before, F.isnull("role"), F.col("role"), F.isnull("text"), F.col("text"))


def turn_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, c1, c2 (hashes of role and text), idx, p1, p2 (rolling hashes), last."""
    narrow = turns.select("conv_id", "turn", "role", _content(F.lit(1)).alias("c1"), _content(F.lit(2)).alias("c2"))
    w = Window.partitionBy("conv_id").orderBy(F.isnull("turn"), "turn", F.col("role").asc_nulls_first(), "c1", "c2")
    same = F.struct(F.isnull("turn"), F.coalesce("turn", F.lit(0)), "c1", "c2")
    once = (narrow.withColumn("s", same).withColumn("b", F.lag("s").over(w))
            .where(F.col("b").isNull() | (F.col("b") != F.col("s"))).drop("b", "s"))
    placed = once.withColumns({"idx": F.row_number().over(w), "last": F.lead(F.lit(1)).over(w).isNull()})
    rolling = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumns({
        f"p{k}": F.bit_xor(F.xxhash64(F.lit(k), "idx", f"c{k}")).over(rolling) for k in (1, 2)}).drop("role")


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that no longer one begins with."""
    place = ["idx", "p1", "p2"]
    ends = hashes.where("last").groupBy(*place).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = hashes.where("not last").select(*place).distinct()
    return ends.join(inner, place, "left_anti").select("conv_id", F.col("idx").alias("n_turns"), "copies")


def format_chats(conversations: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, n_turns, copies and the rendered text of the maximal conversations."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"),
                                 F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    hashes = table(turn_hashes(turns))
    kept = maximal(hashes).withColumnRenamed("conv_id", "kept_id")
    at = (hashes.select("conv_id", "turn", "c1", "c2", "idx")
          .join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).drop("kept_id"))
    at = at.select(F.col("conv_id").alias("k_id"), F.col("turn").alias("k_turn"), F.col("c1").alias("k1"),
                   F.col("c2").alias("k2"), "idx", "n_turns", "copies")
    texts = turns.withColumns({"c1": _content(F.lit(1)), "c2": _content(F.lit(2))})
    both = texts.join(at, texts["conv_id"].eqNullSafe(at["k_id"]) & texts["turn"].eqNullSafe(at["k_turn"])
                      & (texts["c1"] == at["k1"]) & (texts["c2"] == at["k2"]))
    # a set: rows equal in all columns are one turn
    rendered = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"),
                        F.coalesce("text", F.lit("")), F.lit(CLOSE))
    return (both.groupBy("conv_id", F.floor((F.col("idx") - 1) / part).alias("part"), "n_turns", "copies")
            .agg(F.sort_array(F.collect_set(F.struct("idx", rendered.alias("r")))).alias("t"))
            .select("conv_id", "part", F.col("n_turns").cast("long").alias("n_turns"), "copies",
                    F.array_join(F.col("t.r"), "").alias("rendered")))


def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS idx FROM t),
c AS (SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY idx) AS a FROM o GROUP BY conv_id),
e AS (SELECT a, n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY a, n),
k AS (SELECT * FROM e WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.a[1] IS NOT DISTINCT FROM e.a[1] AND c.n > e.n AND c.a[1:e.n] IS NOT DISTINCT FROM e.a))
SELECT k.conv_id, (idx - 1) // {PART} AS part, k.n AS n_turns, k.copies,
  string_agg('{OPEN}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY idx) AS rendered
FROM k JOIN o ON o.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY 1, 2, 3, 4"""
