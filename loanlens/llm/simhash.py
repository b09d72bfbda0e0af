"""Operator 7: SimHash near-duplicates by a binary trie self-join.

Fingerprints: 64 majority bits over the XXH64 hashes of a text's 3-word
shingles. Two fingerprints link at ``max_bits`` or fewer differing bits.

The join walks the binary trie of all distinct fingerprints in pairs of nodes
from the root, adds up differing bits and drops a pair beyond the budget. To
deal it out, the trie is built once per rotation: of ``max_bits + 1`` disjoint
bit blocks two linked fingerprints agree on one, so in the rotation that brings
this block to the top they meet below one node, and the walk there starts at
(node, node) with no bit spent. Each top node is one group of a shuffle; a group
with more than ``GROUP`` leaves is descended further on the cluster, in pairs of
child nodes within the budget, until each pair of nodes is small enough for one
task. Inside a task the walk goes level by level over arrays and keeps a spanning
forest of the links found, so that a dense group costs no pair output. Equal
fingerprints are one leaf throughout. ``graph.components`` joins the links up.

Defined results: null and wordless texts have fingerprint zero and link like any
other; fewer than three words are one shingle; rows repeated in the input are repeated in
the output; null ids take the component of their fingerprint but name none.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read_table, table, text_of
from .graph import components

SHINGLE, MAX_BITS = 3, 2
#: Leaves a task takes as one group (a pair of nodes); larger ones are descended on the cluster.
GROUP = 4096
#: Bits per cluster-side descent, rows per walk in a task, node pairs per step of a walk.
STEP, ROWS, FRONTIER = 6, 200_000, 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()        # bytes: only A-Z change, ASCII white space separates
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*[islice(words, k, None) for k in range(shingle)]))
        n = len(words) - shingle + 1
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for start in range(0, n, 1 << 15):
        part = np.fromiter((h(g, 42) for g in islice(grams, 1 << 15)), "<u8", min(n - start, 1 << 15))
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (tells rows of one id apart) and fp (the 64 bits as a long)."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(t or b"", shingle) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))],
                                  ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _rotated(fp: Column, by: int) -> Column:
    if by == 0:
        return fp
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _prefix(rot: Column, depth: int) -> Column:
    """The first ``depth`` bits, the rest zero."""
    return rot if depth == 64 else F.shiftleft(F.shiftrightunsigned(rot, 64 - depth), 64 - depth)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) among n nodes -> one edge from each linked node to its component's smallest."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        if (a == b).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not (label == label[label]).all():
            label = label[label]
    found = np.flatnonzero(label != np.arange(n))
    return found, label[found]


def trie_links(rot: np.ndarray, start: np.ndarray, side: np.ndarray, top: int, max_bits: int):
    """Links (i, j) within each group of sorted leaves, as a spanning forest.

    rot: unsigned leaves, sorted within group and side; start: True at a group's
    first leaf; side: 0 for the first node's leaves, 1 for the second's (a group
    with one side joins a node with itself). All leaves of a group agree on the
    first ``top`` bits.
    """
    n = len(rot)
    first = np.flatnonzero(start)
    last = np.append(first[1:], n)
    ones = np.concatenate([[0], np.cumsum(side)])
    mid = last - (ones[last] - ones[first])          # side 1 sorts behind side 0
    cross = mid < last
    stack = [(top, first, np.where(cross, mid, last), np.where(cross, mid, first), last,
              np.zeros(len(first), np.int64))]
    links_i, links_j, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while stack:
        depth, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > FRONTIER:
            for part in np.array_split(np.arange(len(a0)), len(a0) // FRONTIER + 1):
                stack.append((depth, a0[part], a1[part], b0[part], b1[part], spent[part]))
            continue
        own = a0 == b0
        live = np.where(own, a1 - a0 > 1, (a1 > a0) & (b1 > b0)) & (spent <= max_bits)
        single = live & ~own & (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[single], b0[single]
        near = np.bitwise_count(rot[i] ^ rot[j]) <= max_bits
        links_i.append(i[near])
        links_j.append(j[near])
        held += int(near.sum())
        if held > 4 * n + FRONTIER:
            i, j = spanning(n, np.concatenate(links_i), np.concatenate(links_j))
            links_i, links_j, held = [i], [j], 0
        live &= ~single
        if depth == 64 or not live.any():
            continue
        a0, a1, b0, b1, spent, own = (x[live] for x in (a0, a1, b0, b1, spent, own))
        bit = (rot >> np.uint64(63 - depth)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        two = ~own                                    # (1, 0) repeats (0, 1) where a node meets itself
        stack.append((depth + 1, np.concatenate([a0, am, a0, am[two]]), np.concatenate([am, a1, am, a1[two]]),
                      np.concatenate([b0, bm, bm, b0[two]]), np.concatenate([bm, b1, b1, bm[two]]),
                      np.concatenate([spent, spent, spent + 1, spent[two] + 1])))
    return spanning(n, np.concatenate(links_i), np.concatenate(links_j))


def _walk(top: int, max_bits: int, width: int):
    """mapInArrow function over rows sorted by (r, depth, a, b, side, rot as unsigned)."""
    def links(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        r, depth, a, b, side, rot = (t.column(c).to_numpy() for c in ("r", "depth", "a", "b", "side", "rot"))
        start = np.ones(len(r), bool)
        start[1:] = False
        for c in (r, depth, a, b):
            start[1:] |= c[1:] != c[:-1]
        rot = rot.view(np.uint64)
        i, j = trie_links(rot, start, side.astype(np.int64), top, max_bits)
        by = (r * width).astype(np.uint64)
        fp = np.where(by == 0, rot, (rot >> by) | (rot << ((np.uint64(64) - by) % np.uint64(64))))
        return pa.record_batch([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], ["a", "b"])

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            t = pa.Table.from_batches(parts).combine_chunks()      # all but the last group, which may go on
            keys = [t.column(c).to_numpy() for c in ("r", "depth", "a", "b")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            if len(new):
                cut = int(new[-1]) + 1
                yield links(t.slice(0, cut).to_batches())
                parts = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if parts:
            yield links(parts)
    return run


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct longs ``fp`` -> (a, b): links that connect exactly the fingerprints
    connected through pairs at ``max_bits`` or fewer differing bits."""
    width = 64 // (max_bits + 1)
    leaves = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(r).alias("r"), _rotated(F.col("fp"), r * width).alias("rot"))
        for r in range(max_bits + 1)])).alias("l")).select("l.*")
    leaves = leaves.withColumn("a", _prefix(F.col("rot"), width))

    def ready(part, depth):
        return part.select("r", F.lit(depth).alias("depth"), "a", "b", "side", "rot")

    large = table(leaves.groupBy("r", "a").agg(F.count("*").alias("n")).where(F.col("n") > GROUP))
    todo = [ready(leaves.join(large.select("r", "a"), ["r", "a"], "left_anti")
                  .withColumns({"b": F.col("a"), "side": F.lit(0)}), width)]
    pairs, depth = large.select("r", "a", F.col("a").alias("b"), F.lit(0).alias("spent")), width
    below = leaves.join(large.select("r", "a"), ["r", "a"], "left_semi").select("r", "rot")
    while not pairs.isEmpty():              # only where a node holds more leaves than one task takes
        deeper = min(64, depth + STEP)
        child = (below.groupBy("r", _prefix(F.col("rot"), deeper).alias("c")).agg(F.count("*").alias("n"))
                 .withColumn("p", _prefix(F.col("c"), depth)))
        one = child.select("r", F.col("p").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"))
        two = child.select("r", F.col("p").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"))
        grown = (pairs.join(one, ["r", "a"]).join(two, ["r", "b"])
                 .withColumn("spent", F.col("spent") + F.bit_count(
                     F.expr(f"shiftrightunsigned(ca ^ cb, {64 - deeper}) & {(1 << (deeper - depth)) - 1}L")))
                 .where((F.col("spent") <= max_bits) & ((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb"))))
                 .withColumn("n", F.when(F.col("ca") == F.col("cb"), F.col("na")).otherwise(F.col("na") + F.col("nb")))
                 .select("r", F.col("ca").alias("a"), F.col("cb").alias("b"), "spent", "n"))
        grown = table(grown)
        small = grown.where((F.col("n") <= GROUP) & ((F.col("a") != F.col("b")) | (F.col("n") > 1)))
        at = below.withColumn("c", _prefix(F.col("rot"), deeper))
        todo.append(ready(at.withColumnRenamed("c", "a").join(small, ["r", "a"])
                          .withColumn("side", F.lit(0)), deeper))
        todo.append(ready(at.withColumnRenamed("c", "b").join(small.where("a <> b"), ["r", "b"])
                          .withColumn("side", F.lit(1)), deeper))
        pairs, depth = grown.where(F.col("n") > GROUP).drop("n"), deeper
    rows = todo[0]
    for t in todo[1:]:
        rows = rows.unionByName(t)
    key = ["r", "depth", "a", "b"]
    # flipping the sign bit sorts longs as unsigned
    rows = (rows.repartition(*key).withColumn("u", F.expr("rot ^ (-9223372036854775807L - 1L)"))
            .sortWithinPartitions(*key, "side", "u").drop("u"))
    return rows.mapInArrow(_walk(width, max_bits, width), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, text_hash, fp, root (smallest fingerprint reachable) and component_id
    (smallest doc_id reachable) per document."""
    prints = table(fingerprints(docs, shingle))
    distinct = table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(link_fingerprints(distinct.select("fp"), max_bits))
    classes = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
               .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(names, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group: the one with the smallest id (of rows that share it, one)."""
    found = near_duplicates(docs, shingle, max_bits)
    keep = (found.groupBy("root").agg(F.min(F.struct(
        F.isnull("doc_id").alias("z"), "doc_id", "text_hash")).alias("k")).select(
            F.col("k.doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash")))
    h, kid, kh = fresh(docs, "text_hash_", "keep_id", "keep_hash")
    keep = keep.select(F.col("keep_id").alias(kid), F.col("keep_hash").alias(kh))
    out = docs.withColumn(h, F.xxhash64("text"))
    out = out.join(keep, out["doc_id"].cast("long").eqNullSafe(keep[kid]) & (out[h] == keep[kh]))
    # rows equal in id and text are one document
    return out.dropDuplicates([kid, kh]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
