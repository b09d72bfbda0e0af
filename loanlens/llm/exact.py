"""Operator 13: exact dedup by a persistent digest index (native).

Texts are equal when they are identical without ASCII white space; the SHA-256 of what is
left is their digest. The index is a Parquet table bucketed and sorted by digest, kept
under a folder that outlives the session. A delivery of new rows is reduced to one entry
per digest (copies are combined before the shuffle), a sort-merge anti-join with the index
leaves the digests it has never seen, and the entries are appended in the index's own
buckets, so that neither join nor append shuffles the index. Entries of digests that the
index knows are appended too: they carry the copies and the best row of their delivery,
and the groups of the whole corpus come from the index alone.

The best row of a group has the most code points in its original text, then the smallest
doc_id, the earliest delivery and the first row. ``new_documents`` keeps what earlier deliveries
lack (a delivery cannot take back what an earlier one gave out); ``members`` chooses over all
deliveries.

Groups that hold more than a ``HOT_SHARE`` part of all rows (at most that many groups) are
joined by broadcast; all others meet their rows in a shuffle join.

Defined results: null texts and texts of white space only are empty and equal to each other; rows
equal in id and text are copies, one of which stays; rows without id stay after those
with one; a delivery given again changes nothing; an empty table adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import SPACE, fresh, read_table, table, text_of

BUCKETS = 64
#: A group is hot beyond this part of all rows: so there are at most this many.
HOT_SHARE = 10_000
#: Deliveries in which the query hands the corpus to the index.
DELIVERIES = 2
ENTRY = "digest BINARY, batch BIGINT, chars BIGINT, doc_id BIGINT, row BIGINT, copies BIGINT"


def digest(text: str = "text"):
    """SHA-256 (binary) of the text without ASCII white space."""
    t = text_of(text)
    for c in SPACE:
        t = F.replace(t, F.lit(c), F.lit(""))
    return F.unhex(F.sha2(t, 256))


def digest_rows(docs: DataFrame, batch=0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: doc_id, digest, chars, row (its place in this frame) and the
    delivery, a number or an expression over ``row``. Written, so that the places stay."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), digest(text).alias("digest"),
                       F.length(text_of(text)).cast("long").alias("chars"),
                       F.monotonically_increasing_id().alias("row"))
    return table(rows.withColumn("batch", (F.lit(batch) if isinstance(batch, int) else batch).cast("long")))


def _best(*more: str):
    """The first row of a group: by length, then id, delivery and place (``~`` turns an order round, nulls last)."""
    return F.max(F.struct("chars", *[F.bitwise_not(c).alias(c) for c in ("doc_id", "batch", "row")], *more))


def _best_row(best: str) -> list:
    return [F.col(f"{best}.chars").alias("chars"),
            *[F.bitwise_not(F.col(f"{best}.{c}")).alias(c) for c in ("doc_id", "batch", "row")]]


class DigestIndex:
    """The index kept under ``location``, a folder that all executors share. ``buckets`` counts when
    the index is made; an index that exists keeps its own."""

    def __init__(self, spark: SparkSession, location: str, buckets: int = BUCKETS):
        self.spark, self.location = spark, location.rstrip("/")
        try:
            self.buckets = int(spark.read.text(f"{self.location}/buckets").first()["value"])
        except AnalysisException:
            spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.text(f"{self.location}/buckets")
            self.buckets = buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({ENTRY}) USING parquet CLUSTERED BY (digest) "
                  f"SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/entries'")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """Append the delivery ``batch`` (rows of ``digest_rows``) and return the entries of the digests
        that no earlier delivery holds. A delivery that was cut short or is given again only adds
        what is missing, and returns the same."""
        own = table(rows.groupBy("digest").agg(_best().alias("best"), F.count("*").alias("copies"))
                    .select("digest", *_best_row("best"), "copies").withColumn("batch", F.lit(batch).cast("long")))
        there = self.entries().where(F.col("batch") == batch).select("digest")
        missing = own.join(there.hint("merge"), "digest", "left_anti")
        (missing.select("digest", "batch", "chars", "doc_id", "row", "copies")
         .repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)
        known = self.entries().where(F.col("batch") < batch).select("digest")
        return own.join(known.hint("merge"), "digest", "left_anti")

    def groups(self) -> DataFrame:
        """digest, group_size and the row that stays (keep_id, keep_batch, keep_row) of every digest."""
        every = self.entries().groupBy("digest").agg(_best().alias("best"), F.sum("copies").alias("group_size"))
        return every.select("digest", "group_size", *_best_row("best")).select(
            "digest", "group_size", F.col("doc_id").alias("keep_id"), F.col("batch").alias("keep_batch"),
            F.col("row").alias("keep_row"))


def members(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """``rows`` (of ``digest_rows``, all delivered) with keep_id, group_size and kept."""
    limit = max(1, rows.count() // HOT_SHARE)
    groups = index.groups()
    hot = F.broadcast(table(groups.where(F.col("group_size") > limit)))
    cold = groups.where(F.col("group_size") <= limit)
    out = (rows.join(hot, "digest")
           .unionByName(rows.join(hot, "digest", "left_anti").join(cold.hint("merge"), "digest")))
    kept = (F.col("batch") == F.col("keep_batch")) & (F.col("row") == F.col("keep_row"))
    return out.withColumn("kept", kept).drop("keep_batch", "keep_row")


def new_documents(docs: DataFrame, index: DigestIndex, batch: int) -> DataFrame:
    """The documents of a delivery that neither the index nor the delivery itself holds already, one of
    each group, with all their columns."""
    new = index.add(digest_rows(docs, batch), batch)
    d, i, n = fresh(docs, "keep_digest", "keep_doc", "keep_chars")
    keep = new.select(F.col("digest").alias(d), F.col("doc_id").alias(i), F.col("chars").alias(n))
    both = docs.withColumn(d, digest()).join(keep, d)
    own = both.where(F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.length(text_of()) == F.col(n)))
    # rows equal in id, digest and length: one of them
    one = own.groupBy(d).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(i))
    return one.select(f"{i}.*")


def op13_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus reaches an empty index in ``DELIVERIES`` deliveries."""
    index = DigestIndex(spark, f"{checkpoint_dir(spark)}/digest-index-{uuid.uuid4().hex}")
    rows = digest_rows(read_table(spark, sf_dir, "documents"), F.pmod(F.col("row"), F.lit(DELIVERIES)))
    for batch in range(DELIVERIES):
        index.add(rows.where(F.col("batch") == batch), batch)
    return members(rows, index).select("doc_id", "keep_id", "group_size", "kept",
                                       F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT r, doc_id, length(t) AS chars, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS h FROM d)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
  row_number() OVER best = 1 AS kept, h AS text_sha256
FROM n WINDOW best AS (PARTITION BY h ORDER BY chars DESC, doc_id NULLS LAST, r)"""
