"""Operator 11: exact ranked lexical search by presence-mask grouping.

Items are dealt by hash into blocks of about ``PAIRS`` (item, term) pairs; a block's vocabulary
goes to the workers. One pass over the documents keeps of each its length and the counts of
the block's terms (a written table); document frequencies, N and L are sums over that
table. In the second pass every task takes its rows in blocks of at most ``DOCS`` documents and
holds one bitmap of the block's documents per term. An item's documents are those in
the union of the bitmaps of terms that can lift a document above the item's k-th score so far (the
rest together cannot reach it). They are grouped by their presence mask, the bits of
the terms they hold. A mask's best score is the sum over its terms of the highest
contribution in the block; masks are taken in descending order of that sum, the documents of
a mask scored exactly, until no mask left can reach the k-th score. Each task hands on k
rows an item; the best of them are the answer.

Defined results: null and empty texts hold no term, and no item or document without a term is
ranked; rows of the items' table that share an item_id (or have none) are one item with the terms
of all; repeated documents are ranked each for itself; documents without id come last among equal
scores; a document whose length times N passes 63 bits raises. Very long texts are whole
rows; their counts of the block's terms are at most as many as its vocabulary.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, table, text_of

K = 10
#: (item, term) pairs of a block of items: its vocabulary is held by every worker.
PAIRS = 200_000
#: Documents and (document, term) counts of a block inside a task.
DOCS, POSTINGS = 4096, 1_000_000
NO_ID = (1 << 63) - 1
#: ASCII letters and digits stay (capitals lowered), all other ASCII separates, other bytes stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(FOLD).split()


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of every item."""
    def run(batches):
        for b in batches:
            ids, out_id, out_term = b.column(0), [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = set(terms_of(t))
                out_id += [i] * len(found)
                out_term += found
            yield pa.record_batch([ids.take(pa.array(out_id, pa.int64())),
                                   pa.array(out_term, pa.binary()).cast(pa.string())], ["item_id", "term"])

    rows = items.select(F.col(key).cast("long").alias("item_id"), text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id long, term string").distinct()


def counts_of(docs: DataFrame, vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms of the text, with repeats), ids and tfs (counts of the terms in ``vocabulary``, a
    broadcast list) of the documents that hold a term."""
    def run(batches):
        place = {t.encode(): i for i, t in enumerate(vocabulary.value)}
        for b in batches:
            keep, length, size, ids, tfs = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = terms_of(t)
                if not found:
                    continue
                counts = Counter(found)
                known = counts.keys() & place.keys()
                keep.append(i)
                length.append(len(found))
                size.append(len(known))
                ids += [place[w] for w in known]
                tfs += [counts[w] for w in known]
            cut = pa.array(np.cumsum([0] + size), pa.int32())
            yield pa.record_batch([
                b.column(0).take(pa.array(keep, pa.int64())), pa.array(length, pa.int64()),
                pa.ListArray.from_arrays(cut, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(cut, pa.array(tfs, pa.int64()))], ["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>")


class _Block:
    """Bitmaps and contributions of one block of documents."""

    def __init__(self, n, size, ids, tfs, weight, N, L):
        self.docs = len(n)
        doc = np.repeat(np.arange(self.docs), size)
        m = 10 + (90 * n * N) // L
        gain = weight[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        key = ids.astype(np.int64) * self.docs + doc
        order = np.argsort(key)
        self.key, self.gain = key[order], gain[order]
        terms = ids[order]
        first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.empty(0, np.int64)
        self.row = np.full(len(weight) + 1, -1)
        self.row[terms[first]] = np.arange(len(first))
        self.top = np.maximum.reduceat(self.gain, first) if len(first) else np.empty(0, np.int64)
        bits = np.zeros((len(first), -(-self.docs // 64) * 64), bool)
        bits[self.row[terms], doc[order]] = True
        self.bits = np.packbits(bits, axis=1, bitorder="little")

    def scores(self, terms, docs, holds):
        """Exact scores of documents; ``holds`` tells which term is in which document."""
        out = np.zeros(holds.shape, np.int64)
        t, d = np.nonzero(holds)
        out[t, d] = self.gain[np.searchsorted(self.key, terms[t].astype(np.int64) * self.docs + docs[d])]
        return out.sum(0)

    def search(self, terms, k, floor):
        """Documents and scores that may be among the k best, given the k-th score so far (0: none)."""
        terms = terms[self.row[terms] >= 0]
        top = self.top[self.row[terms]]
        terms, top = terms[top > 0], top[top > 0]
        if not len(terms):
            return None
        order = np.argsort(top, kind="stable")
        terms, top = terms[order], top[order]
        need = np.searchsorted(np.cumsum(top), floor)       # the terms before it cannot reach the floor together
        if need == len(terms):
            return None
        bits = self.bits[self.row[terms]]
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[need:], axis=0), bitorder="little"))
        holds = ((bits[:, docs >> 3] >> (docs & 7).astype(np.uint8)) & 1).astype(bool)
        mask = np.packbits(holds, axis=0, bitorder="little")
        wide = np.zeros((-(-len(mask) // 8) * 8, len(docs)), np.uint8)
        wide[:len(mask)] = mask
        words = np.ascontiguousarray(wide.T).view(np.uint64)
        if words.shape[1] == 1:
            _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
        else:
            _, first, group = np.unique(words, axis=0, return_index=True, return_inverse=True)
        best = top @ holds[:, first]                        # the most a document with this mask can score
        by_mask = np.argsort(-best[group], kind="stable")
        bound = best[group][by_mask]
        found_d, found_s, at, step = [], np.empty(0, np.int64), 0, 4 * k
        while at < len(by_mask) and bound[at] >= max(floor, 1):
            # whole masks, at least ``step`` documents of those that can still reach the floor
            stop = min(at + step, int(np.searchsorted(-bound, -max(floor, 1), side="right")))
            stop = int(np.searchsorted(-bound, -bound[stop - 1], side="right"))
            some = by_mask[at:stop]
            found_s = np.r_[found_s, self.scores(terms, docs[some], holds[:, some])]
            found_d.append(docs[some])
            if len(found_s) >= k:
                floor = max(floor, int(np.partition(found_s, len(found_s) - k)[len(found_s) - k]))
            at, step = stop, step * 4
        if not found_d:
            return None
        found = np.concatenate(found_d)
        good = found_s >= max(floor, 1)
        return found[good], found_s[good]


def _searcher(items: list[np.ndarray], weight: np.ndarray, N: int, L: int, k: int):
    """mapInArrow function: counts -> the k best documents of every item in the task's rows."""
    def run(batches):
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]

        def meet(ids, n, size, terms, tfs):
            if len(n) and 90 * int(n.max()) * N >= 1 << 63:
                raise OverflowError("length times documents beyond 63 bits")
            block = _Block(n, size, terms, tfs, weight, N, L)
            for i, wanted in enumerate(items):
                d, s = best[i]
                found = block.search(wanted, k, int(s[-1]) if len(s) == k else 0)
                if found is not None:
                    d, s = np.r_[d, ids[found[0]]], np.r_[s, found[1]]
                    order = np.lexsort((d, -s))[:k]
                    best[i] = (d[order], s[order])

        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n, sizes = b.column(1).to_numpy(zero_copy_only=False), b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            terms, tfs = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(n):
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, min(lo + DOCS, int(np.searchsorted(ends, before + POSTINGS, side="right"))))
                meet(ids[lo:hi], n[lo:hi], sizes[lo:hi], terms[before:ends[hi - 1]], tfs[before:ends[hi - 1]])
                lo = hi
        for i, (d, s) in enumerate(best):
            if len(d):
                yield pa.record_batch([pa.array(np.full(len(d), i), pa.int32()), pa.array(d, mask=d == NO_ID), pa.array(s)],
                                      ["item", "doc_id", "score"])
    return run


def _search_block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The k best documents per task of the items of one block, as item_id, doc_id, score."""
    spark = docs.sparkSession
    asked = pairs.groupBy("item_id").agg(F.collect_list("term").alias("terms")).toArrow()
    vocabulary = sorted({t for row in asked.column("terms").to_pylist() for t in row})
    place = {t: i for i, t in enumerate(vocabulary)}
    item_ids = asked.column("item_id").to_pylist()
    items = [np.array(sorted(place[t] for t in row), np.int64) for row in asked.column("terms").to_pylist()]
    counts = table(counts_of(docs, spark.sparkContext.broadcast(vocabulary)))
    total = counts.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    N, L = total["N"], total["L"] or 1
    df = np.zeros(len(vocabulary), np.int64)
    held = counts.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).toArrow()
    df[held.column("id").to_numpy()] = held.column("df").to_numpy()
    weight = np.floor(1000.0 * np.log((2.0 * N + 2.0) / (2.0 * df + 1.0))).astype(np.int64)
    found = counts.mapInArrow(_searcher(items, weight, N, L, k), "item int, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(item_ids)), "item int, item_id long")
    return found.join(names, "item").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item."""
    asked = table(item_terms(items))
    blocks = max(1, -(-asked.count() // pairs))
    found = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = _search_block(docs, some, k)
        found = rows if found is None else found.unionByName(rows)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def op11_presence_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS nd, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
      FROM p, s GROUP BY term, nd),
g AS (SELECT p.r, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.t) * nd) // total))) AS g
      FROM p JOIN w USING (term) JOIN d USING (r), s),
c AS (SELECT q.item_id, g.r, sum(g)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY q.item_id, g.r)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM c JOIN d USING (r) WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) QUALIFY row_number() OVER o <= {K}"""
